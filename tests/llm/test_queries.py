"""The registered queries themselves, through tables of their own, against plain versions of their contracts."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from auditloom.llm import queries

TEXTS = [
    None, "", " \n\t ", "word", "Été ça — naïve word\x1cone", "same text here and there", "same text here and there", "line one\nline one\n \nline two", "don't I'LL we've <|endoftext|> done", "日本語テキスト 😀 е́",
    "the company reports growth in every market of the region and expects further growth in the coming year for all of its products", "x" * 5000, "growth " * 40,
]


def document_rows():
    rng = random.Random(11)
    vocabulary = [f"{a}{b}ing" for a in ("market", "report", "compan", "product", "analys") for b in ("", "s", "ed", "er")] + "the of and for with growth price value stock".split()
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(TEXTS)]
    for i in range(100, 160):
        words = rng.choices(vocabulary, k=rng.randint(5, 120))
        rows.append((i, " ".join(words).capitalize(), "en", "b", 1))
    return rows + [(500 + i, rows[20][1], "en", "b", 1) for i in range(5)]


PAGES = [
    (1, "http://a/", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "", "<p>two ünï</p>"), (4, "HTTP://A/", "<p>two ünï</p>"), (5, "ftp://a/", "<p>three</p>"), (6, "ünï", "HTTP/1.1 200\r\n\r\nof its own"), (7, "http://a b/", None),
    (8, None, ""), (9, "dns:a", "\r\n\r\n"), (10, "https://b/", "x" * 300_000), (11, "mailto:x", "x" * 300_000), (12, "http://a/\nb", "line\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with nulls, repeats and columns whose names clash with results."""
    path = str(tmp_path_factory.mktemp("tables"))
    clash = lambda df: df.withColumns({c: F.lit("clash") for c in ("score", "rank", "n", "key", "payload", "part", "row", "weight")})
    clash(spark.createDataFrame(document_rows(), "doc_id long, text string, lang string, source string, n_chars long")).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(["growth of the market", None, "Market prices and value"])], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    clash(spark.createDataFrame(PAGES, "page_id long, url string, html string")).write.parquet(f"{path}/pages.parquet")
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 16))
    vectors = [(i, (centres[i % 6] + 0.3 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(600)]
    vectors += [(600, vectors[50][1]), (601, vectors[50][1]), (602, None), (603, [0.0] * 16), (604, [float("nan")] + [1.0] * 15), (605, [1.0]), (650, [float("inf")] * 16), (700, [None] + [1.0] * 15), (606, [])]
    clash(spark.createDataFrame(vectors, "vec_id long, embedding array<float>")).withColumn("vector", F.lit(1)).write.parquet(f"{path}/embeddings.parquet")
    return path


def run(spark, folder, name):
    return queries.queries()[name](spark, folder).collect()


def documents():
    return [(r[0], r[1] or "") for r in document_rows()]


def test_op4_any_address(spark, folder):
    got = {r["page_id"]: r for r in run(spark, folder, "op4_warc")}
    firsts = {}
    for i, _, h in PAGES:
        firsts.setdefault((h or "").encode(), i)
    assert len(got) == len(PAGES)
    for i, _, h in PAGES:
        body = (h or "").encode()
        first = firsts[body]
        want = (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if first == i else "revisit", None if first == i else first)
        assert (got[i]["payload_bytes"], got[i]["payload_digest"], got[i]["record_type"], got[i]["refers_to"]) == want, i


def test_op4_stops_at_a_damaged_record(spark):
    from auditloom.llm.archives import sound

    rows = spark.createDataFrame([("A", None), ("B", "cut")], "payload_digest string, error string")
    with pytest.raises(Exception, match="a damaged record: cut"):
        sound(rows).collect()


def test_op6_every_token_once(spark, folder):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = run(spark, folder, "op6_packing")
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, t in documents():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        at = 0
        for r in pieces:
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for rows in by_sequence.values():
        rows.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rows] == [sum(x["length"] for x in rows[:i]) for i in range(len(rows))]
        assert sum(r["length"] for r in rows) <= 2048


def test_op8_as_the_library(spark, folder):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.no_truncation(), tokenizer.no_padding()
    got = {r["doc_id"]: r for r in run(spark, folder, "op8_bpe_encoding")}
    for i, t in documents():
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)))


def test_op9_edits_and_likeness(spark, folder):
    got = {r["doc_id"]: r for r in run(spark, folder, "op9_order_minhash")}
    rows = sorted(documents(), reverse=True)
    same = {}
    for (i, t), (after, u) in zip(rows, [*rows[1:], rows[0]]):
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        prints = lambda x: [x[j : j + 8] for j in range(0, len(x), 8)]
        near = lambda a, b: 1.0 if not a and not b else sum(x == y for x, y in zip(prints(a), prints(b))) / 64
        assert got[i]["near_next"] == pytest.approx(near(got[i]["fingerprint"], got[after]["fingerprint"]))
        assert got[i]["near_edited"] == pytest.approx(near(got[i]["fingerprint"], got[i]["edited_fingerprint"]))
        assert same.setdefault(t, got[i]["fingerprint"]) == got[i]["fingerprint"]


def test_op9_null_ids_come_last(spark, tmp_path):
    rows = [(None, "nobody knows who wrote this text"), (3, "first of all these texts is this"), (1, "last but one of them"), (7, None)]
    spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, with_next int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in run(spark, str(tmp_path), "op9_order_minhash")}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for (i, t), (_, u) in zip(order, [*order[1:], order[0]]):
        t, u = t or "", u or ""
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()


def test_op10_components(spark, folder):
    def fingerprint(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {i: fingerprint(t) for i, t in documents()}
    parent = {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in run(spark, folder, "op10_simhash_near_dedup")}
    assert got == {i: (f"{p:016x}", find(i)) for i, p in prints.items()}


def test_op11_words_and_forms(spark, folder):
    counts = Counter()
    for i, t in documents():
        for w in re.findall("[A-Za-zÀ-ÿ]+", t):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{i}:{w}".encode())
            counts[w if h % 31 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    beside = {w: [v for v in words if near(w, v)] for w in words}
    form = {w: b for w in words if beside[w] and words[b := min(beside[w], key=lambda v: (-words[v], v))] >= 10 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in run(spark, folder, "op11_spelling_variants")}
    assert got == {w: (form.get(w), root(w), n, len(beside[w]), words.get(form.get(w))) for w, n in words.items()}
    assert any(v[3] for v in got.values())


def test_op12_recall_order_and_scores(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    usable = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in rows if r["embedding"] and len(r["embedding"]) == 16 and None not in r["embedding"] and np.isfinite(r["embedding"]).all() and any(r["embedding"])}
    got = {}
    for r in run(spark, folder, "op12_learned_partitions"):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in usable if i % 50 == 0}
    hits = 0
    for q, found in got.items():
        cosine = {i: float(v @ usable[q] / np.sqrt(v @ v) / np.sqrt(usable[q] @ usable[q])) for i, v in usable.items() if i != q}
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        assert all(f[2] == pytest.approx(cosine[f[1]], abs=1e-12) for f in found)
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        hits += len({f[1] for f in found} & set(sorted(cosine, key=lambda i: (-round(cosine[i], 12), i))[:5]))
    assert hits >= 0.9 * 5 * len(got)
    assert [f[1] for f in got[50]][:2] == [600, 601]


def test_op13_weights_and_draw(spark, folder):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    buckets = lambda t: [zlib.crc32(w.encode()) % 10_000 for w in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))]
    held = {i: buckets(t) for i, t in documents()}
    s, t = Counter(b for x in held.values() for b in x), Counter(b for x in ["growth of the market", "Market prices and value"] for b in buckets(x))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    want = {}
    for i, x in held.items():
        weight = sum(map(gain, x)) // len(x) if x else 0
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        want[i] = [len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    fit = sorted((i for i in want if want[i][0] >= 20), key=lambda i: (-want[i][2], i))
    for rank, i in enumerate(fit[: 10 * len(fit) // 100], 1):
        want[i][3] = rank
    got = {r["doc_id"]: [r["n_features"], r["weight"], r["score"], r["rank"]] for r in run(spark, folder, "op13_importance_sampling")}
    assert got == want and any(v[3] for v in got.values())


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "pages", "embeddings", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("op2_quality_rules", "op4_warc", "op5_html_extraction", "op6_packing", "op8_bpe_encoding", "op9_order_minhash", "op10_simhash_near_dedup", "op11_spelling_variants", "op12_learned_partitions", "op13_importance_sampling"):
        assert queries.queries()[name](spark, str(tmp_path)).collect() == [], name
