"""Chat formatting, archives, HTML extraction, fingerprints and near-duplicates against plain versions."""

import gzip
import html
import html.parser
import io
import itertools
import math
import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from auditloom.llm import archives, chat_format, components, html_density, order_minhash, simhash


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    ids = list(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprints(spark):
    texts = [None, "", " \n", "one", "One two", "a b c d e f", "A  b\tC d e f", "é " * 9, "x" * 30_000, "same same same same same"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, component_id string")
    got = {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in simhash.fingerprints(docs).collect()}
    assert got == {i: plain_print(t) for i, t in enumerate(texts)}
    near = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert near == plain_components(got)


@pytest.mark.parametrize("mean,long_list", [(simhash.MEAN, simhash.LONG), (simhash.MEAN, 8), (1, 3), (1e-9, 2)])
def test_components_of_planted_prints(spark, monkeypatch, mean, long_list):
    """Near prints, and 150 that share six bytes. Short limits split lists by further bytes and half-bytes."""
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(25):
            p = centre
            for bit in rng.sample(range(64), rng.randint(0, 5)):
                p ^= 1 << bit
            prints.append(p)
    centre = rng.getrandbits(64)
    prints += [(centre & 0xFFFFFFFF0000FFFF) | rng.getrandbits(16) << 16 for _ in range(150)] + prints[:5]
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    frame = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    plain = simhash.links
    monkeypatch.setattr(simhash, "links", lambda distinct, name="fp": plain(distinct, name, mean, long_list))
    got = {r["doc_id"]: r["component_id"] for r in simhash.assign(frame).collect()}
    assert got == plain_components(dict(enumerate(prints)))


def test_count_filter():
    """A list's pairs are retained by their tally of shared bytes, whatever their bits."""
    differ = np.array([0x0101010101000000, 0x01010101, 0x0F, 0x1F, 1 << 63 | 1 << 31], np.uint64)
    assert simhash.near_pairs(differ, np.zeros(5, int) + 4, 1).tolist() == [False, True, False, False, False]
    first = [i for i, (m, _) in enumerate(simhash._LEVELS[1]) if m == 0xFF][0]
    second = [i for i, (m, _) in enumerate(simhash._LEVELS[1]) if m == 0xFF00][0]
    assert simhash.near_pairs(differ, np.full(5, first), 1).tolist() == [False, False, False, False, True]
    assert simhash.near_pairs(differ, np.full(5, second), 1).tolist() == [False, False, True, False, False]


def test_spanning_joins_what_pairs_join():
    rng = np.random.default_rng(4)
    u, v = rng.integers(0, 300, 200), rng.integers(0, 300, 200)
    a, b = simhash.spanning(u, v)

    def groups(pairs):
        root = list(range(300))
        for x, y in pairs:
            x, y = root[x], root[y]
            root = [min(x, y) if r in (x, y) else r for r in root]
        return root

    assert groups(zip(u, v)) == groups(zip(a, b)) and len(a) < 300


def test_null_and_repeated_keys(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (None, "only here"), (5, "A  b c d e"), (7, None), (9, "")], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(None, 3), (3, 3), (5, 3), (None, None), (7, 7), (9, 7)} and simhash.near_duplicates(docs).count() == 7
    kept = sorted(simhash.representatives(docs).collect(), key=str)
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 3, 7]


def test_chain_of_components(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 100), (200, 201)], "u long, v long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {201: 200}


def test_near_duplicates_of_an_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_signature(text):
    """Through the same 64-bit hash, in plain loops; every sketch searches the ring from its own point."""
    def signed(x):
        return x - (1 << 64) if x >= 1 << 63 else x

    def hash_longs(*values):  # what the built-in hash does: one value's hash seeds the next
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True) if not isinstance(v, bytes) else v, seed)
        return seed

    words = re.sub(r"([\u4e00-\u9fff\u3040-\u30ff\u0e00-\u0e7f])", r" \1 ", text or "").split()
    if not words:
        return []
    kmers = [(signed(hash_longs(*[w.encode() for w in words[i : i + 3]])) >> 31, i) for i in range(max(1, len(words) - 2))]
    counts, items = {}, []
    for h, i in kmers:
        o = counts[h] = counts.get(h, -1) + 1
        x = xxhash.xxh64_intdigest(o.to_bytes(4, "little"), xxhash.xxh64_intdigest(h.to_bytes(8, "little", signed=True), 42))
        items.append((signed(x) >> 31, i))
    out = []
    for b in range(64):
        point = (b - 32) << 27
        after = sorted(items, key=lambda x: (x[0] < point, x))[:2]
        pair = [h for h, _ in sorted(after, key=lambda x: x[1])]
        out.append(b << 32 | hash_longs(*pair) >> 32)
    return out


def test_signatures_match_plain(spark):
    rng = random.Random(2)
    texts = ["one", "one two", "a b c", "a b c d", "a b a b a b a b a b", "東京都に住む word 人々", " ".join(rng.choice("abcdefgh") for _ in range(400)), " ".join(str(rng.random()) for _ in range(300)), "x" * 50_000]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", order_minhash.signature(F.col("t")).alias("s")).collect()
    for r in got:
        assert r["s"] == plain_signature(texts[r["i"]]), texts[r["i"]][:40]


def test_ties_of_hashes_go_by_position(spark):
    """Equal k-mers differ by their number; equal hashes with different positions keep text order."""
    items = [(5 << 31) | 9, (5 << 31) | 2, (7 << 31) | 1]
    got = spark.createDataFrame([(sorted(items),), (sorted(items[:2]),)], "i array<long>").select(order_minhash._sketches(F.col("i")).alias("s")).collect()
    assert all(len(set(x & 0xFFFFFFFF for x in r["s"])) >= 1 and len(r["s"]) == 64 for r in got)


def test_order_counts_in_short_texts(spark):
    """Of texts of 20 to 100 words, rearranged sentences are less alike than they would be to plain MinHash."""
    rng = random.Random(12)
    rows = []
    for n in (20, 40, 60, 100):
        for k in range(20):
            parts = [[f"w{rng.randrange(10_000)}" for _ in range(5)] for _ in range(n // 5)]
            moved = list(parts)
            while moved == parts:
                rng.shuffle(moved)
            edited = [list(p) for p in parts]
            edited[rng.randrange(len(parts))][2] = "changed"
            rows.append((n, *(" ".join(sum(p, [])) for p in (parts, moved, edited))))
    s = order_minhash.signature
    found = spark.createDataFrame(rows, "n int, a string, b string, c string").select("n", order_minhash.likeness(s(F.col("a")), s(F.col("b"))).alias("moved"), order_minhash.likeness(s(F.col("a")), s(F.col("c"))).alias("edited")).toPandas()
    shared = 3 / 5  # of k-mers lie within sentences
    for n, group in found.groupby("n"):
        assert group.moved.mean() < shared / (2 - shared) * 0.6, n
        assert group.edited.mean() > group.moved.mean() + 0.2, n


def test_with_next(spark):
    rng = random.Random(6)
    texts = [None, "", "a", "ab", "é" * 7, "word " * 3000, " ".join(f"w{rng.randrange(50)}" for _ in range(100)), "a", "tail text of some words"]
    rows = [(i * 7, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, (None, "no id")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in order_minhash.with_next(docs).withColumn("same", order_minhash.likeness(F.col("sig"), F.col("next_sig"))).collect()}
    assert set(got) == {None, *(i for i, _ in rows)}
    order = [*sorted(rows, reverse=True), (None, "no id")]
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        assert got[i]["edited"] == t[: len(t) - half] + following[:half] and got[i]["n_chars"] == len(t)
        assert 0 <= got[i]["same"] <= 1
    assert got[0]["sig"] == got[7]["sig"] == []


def test_with_next_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "abcd"), (1, "abcdef"), (2, "zz")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["edited"]) for r in order_minhash.with_next(docs).collect())
    assert got == [(1, "abczz"), (1, "abzz"), (2, "za")]
    one = order_minhash.with_next(docs.where("doc_id = 2")).first()
    assert one["edited"] == "zz" and order_minhash.with_next(docs.limit(0)).count() == 0


def test_likeness_follows_edits(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(10_000)}" for _ in range(600)]
    slight, half, shuffled = list(base), base[:300] + [f"x{i}" for i in range(300)], list(base)
    for i in range(25, 600, 60):
        slight[i] = "changed"
    rng.shuffle(shuffled)
    rows = spark.createDataFrame([(n, " ".join(base), " ".join(t)) for n, t in (("same", base), ("slight", slight), ("half", half), ("shuffled", shuffled))], "n string, a string, b string")
    got = {r["n"]: r["l"] for r in rows.select("n", order_minhash.likeness(order_minhash.signature(F.col("a")), order_minhash.signature(F.col("b"))).alias("l")).collect()}
    assert got["same"] == 1.0 > got["slight"] > 0.7 > got["half"] > got["shuffled"]


PAGES = [
    ("<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=x>Menu</a></ul></nav><div class='ad'>Buy</div><article><h1>Head &amp; more</h1><p><b>Lead\n text<br></p><p>Two&nbsp;words</p></article><footer>foot</footer></body></html>", "Head & more\nLead text\nTwo words"),
    ("<p>only", "only"),
    ("", ""),
    (None, ""),
    ("plain &lt;text&gt;", "plain <text>"),
    ("<body><main><p>One two three<p>Four<ul><li>i1<li>i2</ul><table><tr><td>c1<td>c2</table></main><section class='comments'><p>reader said</p></section></body>", "One two three\nFour\ni1\ni2\nc1\nc2"),
    ("<body><article><p title='a>b'>x</p><script>if (a < b) '</p>'</script><form><p>mail</p></form><p>y</p></article><aside>side</aside></body>", "x\ny"),
    ("<div class='cookie-notice'>We use cookies</div><div><p>Text body here</p></div>", "Text body here"),
]


@pytest.mark.parametrize("page,want", PAGES)
def test_extract(page, want):
    assert html_density.extract(page or "") == want


def test_names_are_read_whole():
    """Values are no names, parts of words are no words, and no name takes most of a page."""
    two = "<p>First paragraph of the article here.</p><p>Second paragraph of the article.</p>"
    want = "First paragraph of the article here.\nSecond paragraph of the article."
    for attributes in ('id=content style="overflow:hidden"', 'data-role="navigation"', 'class="post related-posts-enabled"', 'class="related-work"', "title='a hidden sidebar'", 'class="comments"'):
        assert html_density.extract(f"<body><nav><a href=x>menu</a></nav><div {attributes}>{two}</div></body>") == want, attributes
    assert html_density.extract(f"<body><article>{two}<p class='related-work'>Related work.</p><div class='share-buttons'>Send on</div><p hidden>x</p></article></body>") == want + "\nRelated work."
    for name in ("ad", "cookie-notice", "siteFooter wrapper", "comments-list", "x related-posts"):
        assert html_density.extract(f"<body><article>{two}</article><div class='{name}'><p>{'Dense words of somebody else. ' * 2}</p></div></body>") == want, name


def test_own_text_above_the_chosen_node():
    page = "<body><div>" + "bare text " * 200 + "<br>more<div>" + ("<p>" + "x y z " * 50 + "</p>") * 3 + "</div></div></body>"
    got = html_density.extract(page)
    assert got.startswith("bare text bare") and got.count("bare text") == 200 and got.count("x y z") == 150


def test_density_removes_what_has_no_name():
    links = "".join(f"<li><a href='/{i}'>Menu entry {i}</a></li>" for i in range(12))
    article = "".join(f"<p>{'A sentence of the article, of some length, stands here. ' * 6}</p>" for _ in range(5))
    page = f"<body><div><ul>{links}</ul></div><div>{article}</div><div><span>More: </span><a href=a>One thing</a> <a href=b>Another thing</a></div><div>{links}</div></body>"
    root, nodes, _ = html_density.parse(page)
    assert not any(n.noise or n.named_noise for n in nodes)
    assert html_density.extract(page) == "\n".join(["A sentence of the article, of some length, stands here. " * 6][0].strip() for _ in range(5))


def test_ties_and_long_pages():
    one = "<div><p>" + "same words here " * 20 + "</p></div>"
    assert html_density.extract(f"<body>{one}{one}</body>").count("\n") == 1  # equal sums: both reach the threshold
    long_page = "<body><article>" + "<p>words of a paragraph</p>" * 30_000 + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article></body>"
    got = html_density.extract(long_page)
    assert got.count("words of a paragraph") == 30_000 and got.endswith("deep")


class PlainTree(html.parser.HTMLParser):
    """A tree of the test pages: paragraphs close paragraphs and what is open in them, as browsers do."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.root = self.at = {"tag": "html", "up": None, "kids": [], "noise": False}
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if tag in ("p", "div", "article", "footer", "nav", "ul", "h1"):
            chain = []
            n = self.at
            while n and n["tag"] != "p" and n["tag"] in ("b",):
                chain.append(n)
                n = n["up"]
            if n and n["tag"] == "p":
                self.at = n["up"]
        node = {"tag": tag, "up": self.at, "kids": [], "noise": tag in ("nav", "footer", "head", "script", "style") or ("class", "ad") in attrs}
        self.at["kids"].append(node)
        if tag not in ("br", "meta", "img"):
            self.at = node

    def handle_endtag(self, tag):
        n = self.at
        while n and n["tag"] != tag:
            n = n["up"]
        if n and n["up"]:
            self.at = n["up"]

    def handle_data(self, data):
        self.at["kids"].append(data)


def plain_extract(page):
    """The published definition, node by node: every count walks the node's whole subtree anew."""
    tree = PlainTree(page)
    inline = {"a", "b", "br", "img"}

    def walk(node, inside=False):
        yield node, inside
        for kid in node["kids"]:
            if isinstance(kid, dict) and kid["tag"] not in ("head", "script", "style"):
                yield from walk(kid, inside or kid["tag"] == "a")

    def counts(node, inside):
        c = lc = t = lt = 0
        for n, in_link in walk(node, inside):
            if n is not node:
                t += 1
                lt += n["tag"] == "a"
            own = sum(len(k) - k.count(" ") - k.count("\n") for k in n["kids"] if isinstance(k, str))
            c += own
            lc += own * in_link
        return c, max(lc, 0), t, lt

    everything = list(walk(tree.root))
    body = next(n for n, _ in everything if n["tag"] == "body")
    body_c, body_lc, _, _ = counts(body, False)
    noise = set()
    for n, _ in everything:
        if n["noise"] or n["up"] is not None and id(n["up"]) in noise:
            noise.add(id(n))
    density = {}
    for n, inside in everything:
        c, lc, t, lt = counts(n, inside)
        base = math.log(c / max(c - lc, 1) * lc + body_lc / max(body_c, 1) * c + math.e)
        density[id(n)] = max(0.0, c / max(t, 1) * math.log(c / max(lc, 1) * max(t, 1) / max(lt, 1)) / math.log(max(base, math.e))) if c else 0.0
    live = lambda n: [k for k in n["kids"] if isinstance(k, dict) and id(k) in density and id(k) not in noise]
    total = {id(n): sum(density[id(k)] for k in live(n) if k["tag"] not in inline) for n, _ in everything}

    def best(node):
        found = node
        for n, _ in walk(node):
            if id(n) not in noise and total[id(n)] > total[id(found)]:
                found = n
        return found

    n = best(body)
    threshold = density[id(n)]
    while n is not body:
        n = n["up"]
        threshold = min(threshold, density[id(n)])
    kept, todo = set(), [body]
    own = set()
    while todo:
        n = todo.pop()
        if id(n) in noise or density[id(n)] < threshold:
            continue
        own.add(id(n))
        kept.update(id(k) for k, _ in walk(best(n)))
        todo += live(n)
    lines = [""]

    def read(node, keep):
        if node["tag"] not in inline:
            lines.append("")
        keep = id(node) in kept or (id(node) in own if node["tag"] not in inline else keep)
        for kid in node["kids"]:
            if isinstance(kid, dict) and id(kid) in density and id(kid) not in noise:
                read(kid, keep)
                if kid["tag"] == "br":
                    lines[-1] += " "
            elif isinstance(kid, str) and keep:
                lines[-1] += kid
        if node["tag"] not in inline:
            lines.append("")

    read(body, False)
    return "\n".join(x for x in (" ".join(line.split()) for line in lines) if x)


PAGES_TABLE = "/root/testdata/sf0.01/pages.parquet"


@pytest.mark.skipif(not os.path.exists(PAGES_TABLE), reason="no test tables")
def test_brute_force_density_on_all_pages():
    for row in pq.read_table(PAGES_TABLE).to_pylist():
        assert html_density.extract(row["html"] or "") == plain_extract(row["html"] or ""), row["page_id"]


@pytest.mark.skipif(not os.path.exists(PAGES_TABLE), reason="no test tables")
def test_pages_without_names():
    """With every telling tag and name taken away, density keeps the article of every page and drops the menu of
    all but the shortest (of a few lines, no denser than their menu)."""
    with_menu = []
    for row in pq.read_table(PAGES_TABLE).to_pylist():
        page = re.sub(r"<(/?)(nav|footer|article)\b", r"<\1div", re.sub(r'\sclass="[^"]*"', "", row["html"] or ""))
        article, got = html_density.extract(row["html"] or "").split("\n"), html_density.extract(page).split("\n")
        menu = re.findall(r"<li><a[^>]*>(.*?)</a>", page)
        assert not Counter(article) - Counter(got)
        if {html.unescape(m) for m in menu} & set(got) - set(article):
            with_menu.append(sum(map(len, article)))
    assert len(with_menu) < 0.05 * 250 and max(with_menu, default=0) < 500


def test_extract_pages(spark):
    rows = [(i, "u", p, "clash") for i, (p, _) in enumerate(PAGES)]
    pages = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string, text string")
    found = html_density.extract_pages(pages).collect()
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in found}
    assert got == {i: (w, len(w)) for i, (_, w) in enumerate(PAGES)} and len(found) == len(PAGES) + 1
    assert html_density.extract_pages(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        html_density.extract_pages(pages, keep=("page_id", "text"))


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    bodies = [b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>\n\nx</p>", b"", b"plain\nhttp://x 0.0.0.0 1 text/html 9\n", b"\xff\xfe\x00"]
    data = archives.arc_version_block(version, "f.arc", "20010203040506") + b"".join(archives.arc_record(version, f"http://x/{i} y", "20010203", b) for i, b in enumerate(bodies))
    got = list(archives.parse_arc(io.BytesIO(data)))
    assert [r.body for r in got] == bodies and got[0].fields["URL"] == "http://x/0%20y" and len(got[0].fields) == len(archives.ARC_FIELDS[version])
    assert archives.warc_date("20010203") == "2001-02-03T00:00:00Z"
    cut = list(archives.parse_arc(io.BytesIO(data[:-2])))
    assert cut[:3] == got[:3] and cut[3].error == "a record cut short"
    few = archives.arc_record(version, "http://y/", "2001", b"body").replace(b" 0.0.0.0 2001 text/html", b"", 1)
    odd = list(archives.parse_arc(io.BytesIO(data + few + archives.arc_record(version, "http://z/", "2001", b"after"))))
    assert odd[:4] == got and odd[4].error == "a header of another number of fields" and odd[5].body == b"after"
    bad = list(archives.parse_arc(io.BytesIO(data + b"http://x 0.0.0.0 2001 text/html many\nrest of it")))
    assert bad[:4] == got and bad[4].error == "a header without a length" and bad[4].lost_bytes >= 10 and len(bad) == 5


def test_convert_files(spark):
    head = archives.arc_version_block(1, "f.arc", "20010203040506")
    data = head + archives.arc_record(1, "http://x/", "20010203040506", b"HTTP/1.0 200 OK\r\n\r\nbody")
    latin = head + archives.arc_record(1, "http://l/", "20010203040506", b"HTTP/1.0 200 OK\r\n\r\ncaf\xe9 \xff\r\n\r\n")
    arcs = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(gzip.compress(data))), ("c", bytearray(b"")), ("d", None), ("e", bytearray(latin)), ("f", bytearray(data[:-3]))], "path string, content binary")
    got = sorted(archives.convert(arcs).collect(), key=lambda r: r["path"])
    assert [(r["path"], r["payload"] and bytes(r["payload"]), r["warc_date"], r["type"], r["error"]) for r in got] == [
        *[(p, b"body", "2001-02-03T04:05:06Z", "response", None) for p in "ab"], ("e", b"caf\xe9 \xff\r\n\r\n", "2001-02-03T04:05:06Z", "response", None), ("f", None, None, None, "a record cut short")
    ]


def test_converted_archives_are_written_and_read(spark, tmp_path):
    """Payloads of any bytes, and repeated records, through WARC files and back."""
    bodies = [b"caf\xe9 \xff", b"x\r\n", b"\r\n\r\n\r\n", b"", b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc", b"caf\xe9 \xff", b"\xef\xbb\xbfbom", bytes(range(256)) * 50]
    head = archives.arc_version_block(2, "f.arc", "20010203040506")
    data = head + b"".join(archives.arc_record(2, f"http://x/{i % 5}", "20010203", b"HTTP/1.0 200 OK\r\n\r\n" + b) for i, b in enumerate(bodies))
    records = archives.convert(spark.createDataFrame([("a", bytearray(data))], "path string, content binary"))
    firsts = records.groupBy("payload_sha1").agg(F.min(F.struct(F.col("ordinal").alias("first_key"), F.col("target_uri").alias("first_uri"), F.col("warc_date").alias("first_date"))).alias("f")).select("payload_sha1", "f.*")
    archives.write_warc(archives.deduplicated(records, firsts), str(tmp_path / "w"), key="ordinal")
    got = {int(r["key"]): r for r in archives.read_warc(spark, str(tmp_path / "w")).collect()}
    assert len(got) == len(bodies) and len({r["record_id"] for r in got.values()}) == len(bodies)
    for i, b in enumerate(bodies):
        assert (got[i]["payload_bytes"], got[i]["payload_digest"], got[i]["error"]) == (len(b), archives.base32_sha1(b), None)
        assert got[i]["refers_to"] == ("0" if i == 5 else None)


def test_damaged_warc():
    good = b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    parts = lambda data: data.split(b"\r\n\r\n")
    errors = lambda data: [(f.get("error"), b) for f, b in archives.parse_warc(parts(data))]
    assert errors(good + good) == [(None, b"ab")] * 2
    assert errors(good.replace(b"ab", b"abcd") + good) == [("a block of another length than declared", b"ab"), (None, b"ab")]
    assert errors(good + good.replace(b": 2", b": 900")) == [(None, b"ab"), ("a record cut short", b"ab\r\n\r\n")]
    assert errors(good.replace(b": 2", b": x") + good) == [("a length that is no number", b""), (None, b"ab")]


def test_warc_round_trip(spark, tmp_path):
    htmls = ["<p>a</p>", None, "", "WARC/1.1\r\n\r\n\r\nx", "<p>a</p>", "é\r\n\r\n", "<p>a</p>", "y" * 300_000]
    rows = [(9 - i, f"http://h/{i}" if i else None, h, "clash", "clash") for i, h in enumerate(htmls)]
    pages = spark.createDataFrame([*rows, (None, "http://n", "<p>a</p>", "", "")], "page_id long, url string, html string, payload string, first_key string")
    records = archives.deduplicated(archives.from_pages(pages), archives.first_payloads(pages))
    archives.write_warc(records, str(tmp_path / "w"))
    found = archives.read_warc(spark, str(tmp_path / "w")).collect()
    got = {int(r["key"]): r for r in found if r["key"]}
    assert [(r["record_type"], r["refers_to"]) for r in found if not r["key"]] == [("response", None)]
    least = {}
    for k, h in sorted((9 - i, h or "") for i, h in enumerate(htmls)):
        r, first = got[k], least.setdefault(h, k)
        assert (r["payload_bytes"], r["payload_digest"]) == (len(h.encode()), archives.base32_sha1(h.encode()))
        assert (r["record_type"] == "revisit", r["refers_to"]) == (first != k, str(first) if first != k else None)


def test_repeated_rows_and_an_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://h", "<p>")] * 3 + [(2, "http://h", "<p>")], "page_id long, url string, html string")
    for name, table in (("r", pages), ("e", pages.limit(0))):
        archives.write_warc(archives.deduplicated(archives.from_pages(table), archives.first_payloads(table)), str(tmp_path / name))
    found = archives.read_warc(spark, str(tmp_path / "r")).collect()
    assert sorted((r["key"], r["record_type"]) for r in found) == [("1", "response")] * 3 + [("2", "revisit")]
    assert len({r["record_id"] for r in found}) == 4 and [r["refers_to"] for r in found if r["key"] == "2"] == ["1"]
    assert archives.read_warc(spark, str(tmp_path / "e")).count() == 0


def test_markers():
    assert chat_format.split_marker("User: hi there") == (2, False, "hi there")
    assert chat_format.split_marker("### Assistant") == (3, True, "")
    assert chat_format.split_marker("[system] be kind") == (1, True, "be kind")
    assert chat_format.split_marker("<|im_start|>user") == (2, True, "")
    assert chat_format.split_marker("### Response:") == (3, True, "")
    assert chat_format.split_marker("user") == (2, False, "")
    assert chat_format.split_marker("A user said") == (0, False, "A user said")
    lines = chat_format.lines_of(["<|im_start|>user\n\nhi\n\n\nA) first<|im_end|>\n\n", None, "## Context"])
    assert [(x.piece, x.text, x.bare, x.blank) for x in lines] == [(0, "<|im_start|>user\nhi", "hi", 0), (0, "A) first", "first", 2), (2, "## Context", "", 0)]


def conversations(n=60, turns=6):
    rng = random.Random(3)
    rows = []
    for c in range(n):
        for t in range(turns):
            role = "user" if t % 2 == 0 else "assistant"
            text = "\n".join(" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randint(2, 8 if role == "user" else 60))) for _ in range(rng.randint(1, 1 if role == "user" else 3)))
            rows.append((c, t, role, text + ("?" if role == "user" else ".")))
    return rows


TURNS = "conv_id long, turn long, role string, text string"


def test_roles_are_recovered(spark):
    rows = conversations() + [(2000, 0, "user", None)]
    raw = chat_format.as_transcripts(spark.createDataFrame(rows, TURNS)).withColumns({c: F.lit("clash") for c in ("before", "last", "chunk", "up")})
    model = chat_format.fit(raw.where("conv_id % 5 <> 0"))
    got = {(r["conv_id"], r["turn_no"]): r for r in chat_format.recover(raw.drop("role"), model).collect()}
    right = [(r["conv_id"], r["turn"]) in got and got[r["conv_id"], r["turn"]]["role"] == r["role"] and got[r["conv_id"], r["turn"]]["text"] == r["said"] for r in raw.where("conv_id < 60").collect()]
    assert np.mean(right) > 0.75
    assert got[0, 0]["rendered"] == f"<|im_start|>user\n{got[0, 0]['text']}<|im_end|>\n"
    assert chat_format.recover(raw.limit(0), model).count() == 0


def test_lines_inside_turns_stay(spark):
    """What looks like a marker inside a turn, and blank lines there, are text of the turn."""
    rows = []
    for c in range(40):
        rows += [(c, 0, "user", "\n### User\nhow is that?\n"), (c, 1, "assistant", "\n### Assistant\nAs follows.\n\nA) first option\nAnswer: 42\na > b holds\nand so on with words\n")]
    raw = spark.createDataFrame(rows, TURNS)
    got = {(r["conv_id"], r["turn_no"]): r["text"] for r in chat_format.recover(raw.drop("role"), chat_format.fit(raw)).collect()}
    assert len(got) == 80 and got[7, 0] == "how is that?" and got[7, 1] == "As follows.\n\nA) first option\nAnswer: 42\na > b holds\nand so on with words"


def test_repeated_rows_and_nulls(spark):
    raw = spark.createDataFrame([(1, 0, "user", "User: a")] * 2 + [(1, 1, "assistant", "Bot: b"), (None, 0, "user", "x"), (2, None, "user", "x"), (3, 0, "user", " \n\t"), (4, 0, "user", "User: " + "long words " * 30_000)], TURNS)
    got = chat_format.recover(raw.drop("role"), chat_format.fit(raw)).collect()
    assert {r["conv_id"] for r in got} == {1, 4} and sum(r["conv_id"] == 1 for r in got) == 3
    assert max(len(r["text"]) for r in got) == len(("long words " * 30_000).strip())


def test_levels_do_not_change_the_turns(spark, monkeypatch):
    """A conversation in chunks of two, whose matrices are multiplied two at a time, has the same turns."""
    rows = [(c, t - 9 * c, "user" if t % 2 == 0 else "assistant", f"turn {t} text" + "?" * (t % 2 == 0)) for c in (0, 1) for t in range(60)]
    raw = chat_format.as_transcripts(spark.createDataFrame(rows, TURNS))
    model = chat_format.fit(raw)
    want = sorted(map(tuple, chat_format.recover(raw, model).collect()))
    monkeypatch.setattr(chat_format, "CHUNK", 2)
    monkeypatch.setattr(chat_format, "FAN", 2)
    assert sorted(map(tuple, chat_format.recover(raw, model).collect())) == want and len(want) > 60


def random_model(rng):
    norm = lambda x: np.log(x / x.sum(-1, keepdims=True))
    return chat_format.RoleModel(norm(rng.random(6)), norm(rng.random((6, 6))), norm(rng.random((6, chat_format.SYMBOLS))))


def test_best_path_of_all_paths():
    """Every path of five lines is scored: the chunked one is the best."""
    rng = np.random.default_rng(5)
    for _ in range(10):
        model = random_model(rng)
        symbols = [int(s) for s in rng.integers(0, chat_format.SYMBOLS, 5)]
        score = lambda p: model.first[p[0]] + sum(model.step[a, b] for a, b in zip(p, p[1:])) + sum(model.seen[a, s] for a, s in zip(p, symbols))  # noqa: E731, B023
        best = max(itertools.product(range(6), repeat=5), key=score)
        parts = [symbols[:2], symbols[2:4], symbols[4:]]
        ends = chat_format.walk([chat_format.transfer(model, p) for p in parts], chat_format.STATES, None)
        assert sum((chat_format.path(model, p, b, e) for p, (b, e) in zip(parts, ends)), []) == list(best)


def test_chunks_do_not_change_the_path():
    rng = np.random.default_rng(1)
    model = random_model(rng)
    symbols = [int(s) for s in rng.integers(0, chat_format.SYMBOLS, 90)]
    whole = chat_format.transfer(model, symbols)
    best = chat_format.path(model, symbols, 6, int(whole[6].argmax()))
    parts = [symbols[i : i + 20] for i in range(0, 90, 20)]
    matrices = [chat_format.transfer(model, p) for p in parts]
    assert np.allclose(chat_format.compose(matrices), whole)
    ends = chat_format.walk(matrices, 6, None)
    assert sum((chat_format.path(model, p, b, e) for p, (b, e) in zip(parts, ends)), []) == best


_ARTICLE = "".join(f"<p>Paragraph number {i} of the article tells something of interest to the reader who came here.</p>" for i in range(4))


@pytest.mark.parametrize("page", [f"<body><form id=aspnetForm><div>{_ARTICLE}</div></form></body>", f"<body><form><h1>T</h1><div>{_ARTICLE}</div></form><p>x</p></body>", f"<body><aside>{_ARTICLE}</aside></body>", f"<body><dialog open>{_ARTICLE}</dialog></body>"])
def test_pages_that_stand_in_one_element(page):
    assert html_density.extract(page).count("Paragraph number") == 4


def test_forms_and_asides_beside_an_article_go():
    page = f"<body><article><h1>T</h1>{_ARTICLE}</article><aside><p>other things to read on this site</p></aside><form>name <input></form></body>"
    assert html_density.extract(page).splitlines()[0] == "T" and "other things" not in html_density.extract(page) and "name" not in html_density.extract(page)


@pytest.mark.parametrize("piece", ["<div>", '<a "', "<p><b><div>", "<!-- ", "<li>", "<ul><li>", "<b>", "<span><div>", "</x>", "<x>word</y>"])
def test_hostile_pages_take_time_in_proportion(piece):
    import time

    def seconds(n):
        began = time.process_time()
        html_density.extract(piece * n)
        return time.process_time() - began

    seconds(100)
    assert seconds(32_000) < 16 * max(seconds(8_000), 0.05)


def test_what_is_never_closed():
    told = [html_density.extract(p) for p in ("text <!-- open", "a > b <!-- open <p>x</p>", "<p>one<p>two < three", "<p>x</p> tail <b", "<p>a <![CDATA[ b")]
    assert told == ["text", "a > b", "one\ntwo < three", "x\ntail <b", "a"]
