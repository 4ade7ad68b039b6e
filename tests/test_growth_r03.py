"""Steps whose cost must grow no faster than their input."""

from __future__ import annotations

import re
import time

from pyspark.sql import functions as F

from auditloom.operators import intake


def test_figures_of_a_text_without_numbers_behind_names(spark):
    """Every name used to be followed to the end of the text: quadratic where no digit comes any more."""
    texts = spark.createDataFrame([("PE about 12.5 and PE 7, PE", ), ("PE 3 " + "PE is not told " * 40_000,)], "t string")
    found = intake.figures(F.col("t"), {"pe": r"PE[^0-9]*(\d+\.?\d*)", "growth": r"(\d+)%"})
    began = time.time()
    assert [(r["pe"], r["growth"]) for r in texts.select(*[v.alias(k) for k, v in found.items()]).collect()] == [(["12.5", "7"], []), (["3"], [])]
    assert time.time() - began < 15


def _shuffled(df) -> list[str]:
    """What each shuffle of a plan is by."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("Exchange ")[1] for line in plan.splitlines() if " Exchange " in line]


def test_word_shares_shuffle_texts_not_words(spark):
    """Every word of every report used to go through the shuffle; dealt by report, its texts go once."""
    from auditloom.operators import features

    found = features.word_shares(spark.createDataFrame([(1, "aa bb aa"), (2, "cc"), (1, "bb bb"), (3, "")], "report_id long, content string"))
    by = _shuffled(found)
    assert len(by) == 1 and "word" not in by[0]
    assert sorted(map(tuple, found.collect())) == [(1, 5, 0.6, 1.0), (2, 1, 1.0, 1.0)]


def test_keywords_shuffle_few_words(spark, monkeypatch):
    """Words of most reports meet their weight without a shuffle; with room for one such word the others still count."""
    from auditloom.operators import statistical

    monkeypatch.setattr(statistical, "COMMON", 1, raising=False)
    monkeypatch.setattr(statistical, "stash", lambda df, name: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    found = statistical.keywords(spark.createDataFrame([(1, "aa bb aa"), (2, "aa cc"), (1, "bb"), (3, "aa")], "report_id long, content string"), 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan
    assert sorted((r["report_id"], r["word"], r["tf"], r["rank"]) for r in found.collect()) == [(1, "aa", 2, 2), (1, "bb", 2, 1), (2, "aa", 1, 2), (2, "cc", 1, 1), (3, "aa", 1, 1)]


def test_cleaning_of_texts_without_marks_is_left_out(spark):
    """Each step used to search every text for matches that cannot be there; the outcome is the same as that of the bare steps."""
    from auditloom.functions import text as X

    odd = ["", "a a a", "ab b b c", "xy xy xyz xy", "of of  of\nof end", "a\tb, c,,d", "<b>1</b> &lt;i&gt;x&amp;lt; &foo; <>", "no end <a", "see a@b.cd or www.x.yz 010-12345678", "qQ 1。微信。Qq。ok。QQ", "风险提示 x。y", "𝒜 b 𝒜", "z " * 40 + "k", "u v w u v w u v w u v w", "ha" * 9 + " " + "无" * 5]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "id int, t string")
    t = F.col("t")
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    tags = F.regexp_replace(t, "<[^>]+>", "")
    for e, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        tags = F.replace(tags, F.lit(e), F.lit(c))
    bare = {
        "tags": (X.strip_tags(t), F.regexp_replace(F.regexp_replace(tags, "<[^>]+>", ""), "&[a-zA-Z0-9#]+;", "")),
        "commas": (X.commas_to_spaces(t), F.translate(t, ",", " ")),
        "adverts": (X.without_sentences(t, X.LEXICONS.advertisement), F.array_join(F.filter(F.split(t, "。"), lambda s: ~s.rlike(X.LEXICONS.advertisement)), "。")),
        "contacts": (X.without_contacts(t), F.regexp_replace(t, X.LEXICONS.contact, "")),
        "repeats": (X.without_repeats(t), X.distinct_sentences(F.regexp_replace(F.regexp_replace(t, r"(.)\1{3,}", "$1$1$1"), r"(\S+)(\s+\1){2,}", "$1"))),
        "share": (X.repeats_beyond(words, 0.3), X.top_share(words) > 0.3),
    }
    for r in rows.select("t", *[c.alias(f"{k}{i}") for k, v in bare.items() for i, c in enumerate(v)]).collect():
        for k in bare:
            assert r[f"{k}0"] == r[f"{k}1"], (k, r["t"])
    assert X._spellings("(?i)QQ|微") == ["qq", "qQ", "Qq", "QQ", "微"] and X._spellings("(?i)a.b") == X._spellings("微") == []


def test_views_are_compared_only_where_it_counts(spark, monkeypatch):
    """Comparing summaries took most of the time, though it counts only for views that lie far apart in sentiment."""
    from auditloom.operators import semantic

    rows = [("a", "one two", 1.0, "never", -1.0), ("a", "one two", 1.0, "xx", -0.5), ("b", "same", 0.1, "same", 0.2), ("c", "near", 1.0, "near", -1.0)]
    near = spark.createDataFrame(rows, "report_id string, summary string, s double, view_summary string, view_s double")
    compared = near.withColumn("similarity", semantic.sequence_ratio(F.col("summary"), F.col("view_summary"))).withColumn("gap", semantic.sentiment_gap(F.col("s"), F.col("view_s")))
    wanted = sorted(map(tuple, semantic.view_deviation(compared).select("report_id", "n_views", "score").collect()))
    assert wanted[0][2] > 0 and wanted[1:] == [("b", 1, 0.0), ("c", 1, 0.0)]
    plain = semantic.sequence_ratio
    monkeypatch.setattr(semantic, "sequence_ratio", lambda a, b: F.when(a == "same", F.raise_error(F.lit("compared in vain")).cast("double")).otherwise(plain(a, b)))
    assert sorted(map(tuple, semantic.deviation_score(near).collect())) == wanted


def test_mean_jaccard_makes_each_union_once(spark):
    from auditloom.operators import explain

    found = explain.mean_jaccard([F.col("a"), F.col("b")], [F.col("c"), F.col("d")])
    rows = spark.createDataFrame([(["x", "y"], ["p"], ["y"], []), ([], [], [], []), (["x"], [], ["x", "x"], [])], "a array<string>, b array<string>, c array<string>, d array<string>")
    assert [r[0] for r in rows.select(found).collect()] == [0.25, 0.0, 1.0]
    assert rows.select(found.alias("m"))._jdf.queryExecution().analyzed().toString().count("array_union") == 2


def test_families_share_their_steps(spark, monkeypatch):
    """Reports' stocks, writing features and last bars used to be made anew for each of their readers."""
    from auditloom.plans import family_queries

    kept, plain = [], family_queries.stash
    monkeypatch.setattr(family_queries, "stash", lambda df, name: kept.append(name) or plain(df, name))
    assert family_queries.families(spark, "/root/testdata/sf0.001").columns == ["report_id", "statistical", "behavioral", "market", "semantic"]
    assert {"stocks", "writing", "returns", "base", "recent"} <= set(kept)


def test_packing_remembers_words_not_chunks():
    """Every white-space-separated chunk used to be cut by pattern and remembered, though its words were known."""
    import public_tokenizers

    from auditloom.llm import packing

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = packing.ChunkEncoder(path)
    names = ["ane", "Bor", "ÉTÉ", "dun"]
    chunks = [f"{a},{b}({c})7" for a in names for b in names for c in names]
    assert len(set(chunks)) == 64
    encoder.encode([" ".join(chunks).encode()])
    assert sum(len(x) for x in vars(encoder).values() if isinstance(x, dict)) <= 8


def test_packing_ids_of_odd_texts(monkeypatch):
    """Parts of a block are the library's, whatever stands between them; a text beyond a block is cut at white space."""
    import random

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from auditloom.llm import packing, text_blocks

    path = public_tokenizers.path("word_bpe_49k.json")
    library, encoder, draw = Tokenizer.from_file(path), packing.ChunkEncoder(path), random.Random(5)
    library.no_truncation()
    library.no_padding()
    bits = ["a", "The", "É", "ß", "×", "÷", "ÿ", "'", "'S", "'ll", "<", "<|", "<|endoftext|>", ".", "!?", "23", "²", "ª", "\xa0", "\x85", "\x1c", "\0", "中", "ſ", "é", "😀", "İ", " ", " ", "\n"]
    for limit in (packing.BLOCK_BYTES, 40):
        monkeypatch.setattr(packing, "BLOCK_BYTES", limit)
        for size in (0, 1, 5, 30) * 25:
            texts = ["".join(draw.choice(bits) for _ in range(size)) for _ in range(3)]
            told = [np.array(x.ids, "<u4").tobytes() for x in library.encode_batch_fast(texts, add_special_tokens=False)]
            assert encoder.encode([t.encode() for t in texts]) == told
    monkeypatch.setattr(packing, "span_hashes", lambda data, starts, ends: text_blocks.span_hashes(data, starts, ends) >> np.uint64(63))
    assert encoder.encode([b"some words, some marks; and more of them."]) == [np.array(library.encode("some words, some marks; and more of them.", add_special_tokens=False).ids, "<u4").tobytes()]


def test_toxicity_fit_holds_no_texts(spark, monkeypatch):
    """Fitting tasks used to hold all texts of their cases to find the least of an id; sorted, it comes first."""
    from auditloom.llm import toxicity

    rows = [(i, t) for i in range(60) for t in (f"bad words {i}" if i % 3 == 0 else f"kind words {i}", f"zz {i}")]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    seen, kind = [], type(labels)
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **b: seen.append(self) or plain(self, *a, **b))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), labels)
    assert re.search(r"Sort \[.?__key\S* ASC.*__text\S* ASC", seen[-1]._jdf.queryExecution().analyzed().toString())
    once = toxicity.fit(spark.createDataFrame(rows[::2], "doc_id long, text string"), labels)
    assert model.bias == once.bias and model.index.tolist() == once.index.tolist() and model.weight.tolist() == once.weight.tolist()


def test_alerts_of_a_batch_are_held_in_few_bytes():
    """A metric's rows of a batch and its open alerts used to be Python objects, hundreds of bytes a row."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    from auditloom.streaming import stateful

    class State:
        n = 0

        def getValueState(self, *_):
            return self

        getListState = getValueState

        def exists(self):
            return False

        def appendList(self, rows):
            self.n += len(rows)

        def update(self, value):
            pass

        def listTimers(self):
            return []

    n, state = 200_000, State()
    frames = (pd.DataFrame({"at": np.arange(lo, lo + 10_000) * 1_000_000, "id": np.arange(lo, lo + 10_000), "bad": True}) for lo in range(0, n, 10_000))
    alerts = stateful._Resolution(5, 300)
    alerts.init(state)
    tracemalloc.start()
    try:
        assert sum(len(x) for x in alerts.handleInputRows(("m",), frames, None)) == 0
        assert tracemalloc.get_traced_memory()[1] < 100 * n
    finally:
        tracemalloc.stop()
    assert state.n == n


def test_kept_rows_are_shuffled_once(spark, monkeypatch):
    """All rows used to be shuffled twice, to find repeats and to rank them by key."""
    from auditloom.operators import history
    from auditloom.sources.shared import new_path

    plans, plain = [], history.stash_at
    monkeypatch.setattr(history, "stash_at", lambda df, path: plans.append(_shuffled(df)) or plain(df, path))
    rows, path = spark.createDataFrame([(k, i // 2, k) for k in range(3) for i in range(12)], "k int, i int, v int"), new_path(spark, "kept")
    for _ in range(2):
        history.update(spark, path, rows, "k", ["i"], 4, buckets=4)
    assert [len(x) for x in plans] == [1, 1, 1, 1]
    assert sorted(map(tuple, history.read(spark, path, rows.schema).select("k", "i", "v").collect())) == [(k, i, k) for k in range(3) for i in range(2, 6)]


def test_bpe_walks_words_in_arrays():
    """Every byte of a word that was not known used to take several calls of Python; now a word takes a few."""
    import random
    import sys

    import public_tokenizers

    from auditloom.llm import bpe

    v, draw = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json")), random.Random(6)
    first, second = ([" ".join("".join(draw.choices("abcdeiornst", k=9)) for _ in range(20_000))] for _ in range(2))
    v.encode(first)  # tokens and pairs are told apart when they are first met
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        v.encode(second)
    finally:
        sys.setprofile(None)
    assert calls < 20 * 20_000


def test_bpe_ids_of_odd_texts(monkeypatch):
    """Words told by classes of bytes are the library's, whatever stands beside them; a text beyond a block is cut at
    word borders, and a span of bytes with the hash of another token does no harm."""
    import random

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from auditloom.llm import bpe

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, draw = Tokenizer.from_file(path), random.Random(5)
    bits = ["a", "The", "É", "ß", "×", "÷", "ÿ", "'", "'s", "'ll", "<", "<|", "<|endoftext|>", ".", "!?", "23", "²", "ª", "\xa0", "\x85", "\x1c", "\0", "\x7f", "中", "　", " ", "᠎", "ſ", "é", "слово", "😀", "İ", " ", " ", " ", "\n", "\r\n", "\t", "x" * 70]
    for limit in (bpe.BLOCK_BYTES, 40):
        monkeypatch.setattr(bpe, "BLOCK_BYTES", limit)
        v = bpe.Vocabulary(path)
        for size in (0, 1, 5, 30) * 25:
            texts = ["".join(draw.choice(bits) for _ in range(size)) for _ in range(3)]
            told = [np.array(x.ids, np.int32).tobytes() for x in library.encode_batch_fast(texts, add_special_tokens=False)]
            assert v.encode(texts) == told
        assert v._by_depth([b"the", b"thing"])[0].tolist() == v._one_by_one([b"the", b"thing"])[0].tolist()
    plain, the = bpe.span_hashes, np.frombuffer(b"the", np.uint8)
    wrong = plain(the, np.array([0]), np.array([3]))[0]
    monkeypatch.setattr(bpe, "span_hashes", lambda data, starts, ends: np.where(ends - starts == 3, wrong, plain(data, starts, ends)))
    words = [b"another", b"strange", b"word"]
    assert dict(v.encode_words(words)) == {w: np.array(library.encode(w.decode(), add_special_tokens=False).ids, np.int32).tobytes() for w in words}


def test_bpe_remembers_bounded_bytes(monkeypatch):
    """Stretches without spaces used to be remembered by their number alone, however long they were."""
    import public_tokenizers

    from auditloom.llm import bpe

    monkeypatch.setattr(bpe, "HELD", 10_000)
    v = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    for i in range(40):
        v.encode(["".join(f"{chr(0x4E00 + j)}'{i}" for j in range(200))])
    assert sum(map(len, v.known)) < 20_000
