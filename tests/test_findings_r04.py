"""Segmented texts and their keywords on larger tables."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_segmentation import corpus, plain_lexicon

from auditloom.operators import segmentation, statistical
from auditloom.operators.segmentation import SegmentConfig


def test_places_are_shuffled_as_numbers(spark):
    texts = spark.createDataFrame(corpus(20), "id long, text string")
    config = SegmentConfig()
    found = segmentation.sequence_counts(texts.select("text"), segmentation.of_texts(config), config)
    assert found.schema["words"].dataType.simpleString() == "array<bigint>"
    assert {r["word"] for r in found.where("len = 1").collect()} == {c for _, t in corpus(20) for c in t if c != "，"}


@pytest.mark.parametrize("longest", [1, 2, 7])
def test_words_of_any_length(spark, longest):
    config = SegmentConfig(cohesion=1500, longest=longest)
    rows = [*corpus(), (1000, None), (1001, ""), (1002, "研"), (1003, "研究 ABC")]
    texts = spark.createDataFrame(rows, "id long, text string")
    want, _ = plain_lexicon([t for _, t in rows], config)
    assert {r["word"]: r["weight"] for r in segmentation.text_lexicon(texts, "text", config).collect()} == want


def test_sums_of_many_blocks(monkeypatch):
    """Equal places of any blocks are one, also when they are summed up before all are there."""
    monkeypatch.setattr(segmentation, "ROWS", 20)
    rng = np.random.default_rng(5)
    keys, want = rng.integers(1, 4, (3, 500)), Counter()
    for k in zip(*keys.tolist(), strict=True):
        want[k] += 1
    bucket = segmentation.Bucket(3, 5)
    for lo in range(0, 500, 37):
        part = keys[:, lo : lo + 37]
        bucket.add((part[0], np.ones(part.shape[1], np.int64), pa.array([f"w{x}" for x in part[0]])), part, np.ones((2, part.shape[1]), np.int64))
        assert bucket.size <= 64
    single, triples, pairs = bucket.levels()
    assert {(r["word"], r["n"]) for r in single.to_pylist()} == {(f"w{x}", n) for x, n in Counter(keys[0].tolist()).items()}
    assert {(r["u0"], r["u1"], r["u2"]): r["n"] for r in triples.to_pylist()} == {k: n for k, n in want.items() if n > 1}
    for r in pairs.to_pylist():
        mine = [n for k, n in want.items() if k[:2] == (r["u0"], r["u1"])]
        assert r["n"] == r["first"] == r["inside"] == sum(mine) and r["clogc"] == pytest.approx(sum(n * math.log(n) for n in mine))


def test_units_that_share_a_hash_are_counted_anew(spark, monkeypatch):
    config, salts, real = SegmentConfig(cohesion=1500), [], segmentation.sequence_counts

    def alike(source, cut, config, salt):
        salts.append(salt)
        found = real(source, cut, config, salt)
        return found if salt else found.withColumn("words", F.when(F.col("len") == 1, F.array(F.lit(7).cast("long"))).otherwise(F.col("words")))

    monkeypatch.setattr(segmentation, "sequence_counts", alike)
    texts = spark.createDataFrame(corpus(), "id long, text string")
    got = {r["word"]: r["weight"] for r in segmentation.text_lexicon(texts, "text", config).collect()}
    assert got == plain_lexicon([t for _, t in corpus()], config)[0] and salts == [0, 1]


def test_units_at_a_joint_and_by_pattern():
    runs = [["a bc a", "d"], [], ["bc"], ["é ü"]]
    split, matched = segmentation.told(runs, "[a-zéü]++", " "), segmentation.told(runs, "[a-zéü]++")
    spell = lambda b: [b.words[c].as_py() if c >= 0 else None for c in b.codes.tolist()]
    assert spell(split) == spell(matched) == ["a", "bc", "a", None, "d", None, "bc", None, "é", "ü", None]


def test_blocks_hold_every_text(monkeypatch):
    monkeypatch.setattr(segmentation, "BLOCK", 10)
    texts = pa.array(["abc", None, "d" * 25, "", "efgh", "ij", "klmnop"])
    found = list(segmentation.blocks(texts))
    assert [t for lo, hi in found for t in texts[lo:hi].to_pylist()] == texts.to_pylist() and len(found) > 2
    assert list(segmentation.blocks(texts[:0])) == []


def test_words_are_counted_where_they_are_cut(spark):
    texts = spark.createDataFrame([*corpus(80), (900, None), (901, "12 的"), (902, "毛利率的公司")], "id long, text string")
    config = SegmentConfig(cohesion=1500)
    words = {r["id"]: Counter(r["words"]) for r in segmentation.segment(texts, "id", "text", config).collect()}
    got = segmentation.segment_counts(texts, "id", "text", config).collect()
    assert {r["id"]: Counter(dict(zip(r["word"], r["tf"], strict=True))) for r in got} == words and len(got) == 83


@pytest.mark.parametrize("common", [0, 3, 1000])
def test_keywords_of_counted_words(spark, monkeypatch, common):
    """Equal whatever number of words has its weight sent to tasks."""
    monkeypatch.setattr(statistical, "COMMON", common)
    rng = random.Random(11)
    rows = [(i, f"w{w:02}", rng.randint(1, 4)) for i in range(40) for w in {int(rng.paretovariate(0.6)) % 60 for _ in range(rng.randint(0, 30))}]
    counted = spark.createDataFrame(rows, "report_id long, word string, tf long")
    docs = spark.range(1).select(F.lit(40).cast("long").alias("docs"))
    df, want = Counter(w for _, w, _ in rows), []
    for i in range(40):
        mine = sorted((-n * math.log(40 / df[w]), w, n) for j, w, n in rows if j == i)[:5]
        want += [(i, w, n, round(-x, 9), rank + 1) for rank, (x, w, n) in enumerate(mine)]
    arrays = counted.groupBy("report_id").agg(F.collect_list("word").alias("word"), F.collect_list("tf").alias("tf"))
    got = sorted((r["report_id"], r["word"], r["tf"], round(r["weight"], 9), r["rank"]) for r in statistical.top_counted(arrays, 5, docs).collect())
    assert got == sorted(want)


def test_keywords_of_reports_of_several_texts(spark):
    rows = [(1, ["a", "b"], [1, 2]), (1, ["a", "c"], [4, 1]), (2, ["c"], [1])]
    counted = spark.createDataFrame(rows, "report_id long, word array<string>, tf array<long>")
    got = statistical.top_counted(counted, 2, spark.range(1).select(F.lit(4).cast("long").alias("docs"))).collect()
    assert sorted((r["report_id"], r["rank"], r["word"], r["tf"]) for r in got) == [(1, 1, "a", 5), (1, 2, "b", 2), (2, 1, "c", 1)]


def test_keywords_of_no_words(spark):
    none = spark.createDataFrame([], "report_id long, word array<string>, tf array<long>")
    one = spark.createDataFrame([(1, [], []), (2, ["a"], [3])], none.schema)
    assert [tuple(r) for r in statistical.top_counted(one, 5, spark.range(1).select(F.lit(2).cast("long").alias("docs"))).collect()] == [(2, "a", 3, 3 * math.log(2), 1)]
    assert statistical.top_counted(none, 5, spark.range(1).select(F.lit(0).cast("long").alias("docs"))).collect() == []
