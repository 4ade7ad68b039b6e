"""Segmentation against plain versions, on Chinese texts and edge cases."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from auditloom.operators import segmentation, statistical
from auditloom.operators.segmentation import SegmentConfig

WORDS = "公司 业绩 增长 市场 预计 产品 销售 投资 收入 行业 研究 风险 净利润 股价 需求 技术 新能源 汽车".split()


def corpus(n=300, seed=3):
    rng = random.Random(seed)
    return [(i, "，".join("".join(rng.choices(WORDS, k=rng.randint(2, 6))) for _ in range(rng.randint(1, 5)))) for i in range(n)]


def plain_lexicon(texts, config):
    runs = [re.findall(config.unit, r) for t in texts for r in re.findall(config.run, t or "")]
    counts = Counter(tuple(r[i : i + k]) for r in runs for i in range(len(r)) for k in range(1, config.longest + 2) if i + k <= len(r))
    total = sum(n for w, n in counts.items() if len(w) == 1)
    found = {w: n for w, n in counts.items() if len(w) == 1}
    after, before = {}, {}
    for w, n in counts.items():
        if len(w) > 1:
            after.setdefault(w[:-1], []).append(n)
            before.setdefault(w[1:], []).append(n)

    def entropy(w, beside):
        c = [*beside.get(w, []), counts[w] - sum(beside.get(w, []))]
        return 1000 * (math.log(counts[w]) - sum(x * math.log(x) for x in c if x) / counts[w])

    for w, n in counts.items():
        if 1 < len(w) <= config.longest and n >= config.least_n and min(entropy(w, after), entropy(w, before)) >= config.entropy:
            if min(math.floor(1000 * math.log(n * total / (counts[w[:k]] * counts[w[k:]]))) for k in range(1, len(w))) >= config.cohesion:
                found[w] = n
    return {config.joint.join(w): math.floor(1000 * math.log(n / total)) for w, n in found.items()}, total


def plain_best(units, weights, unknown, longest):
    """The greatest joint weight over all ways to cut the units."""
    if not units:
        return 0
    return max(w + plain_best(units[k:], weights, unknown, longest) for k in range(1, min(longest, len(units)) + 1) if (w := weights.get("".join(units[:k]), unknown if k == 1 else None)) is not None)


def test_chinese_words_are_found(spark):
    config = SegmentConfig(cohesion=1500)
    rows = [*corpus(), (1000, None), (1001, ""), (1002, "ABC 研究 123，12"), (1003, "x" * 100_000)]
    texts = spark.createDataFrame(rows, "id long, text string")
    java = config._replace(run=segmentation._java(config.run), unit=segmentation._java(config.unit))
    found = segmentation.lexicon(segmentation.units(texts, "id", "text", java).select("units"), config)
    want, total = plain_lexicon([t for _, t in rows], config)
    assert {r["word"]: r["weight"] for r in found.collect()} == want
    assert set(WORDS) <= set(want)
    table = segmentation.dictionary(found, config)
    got = {r["id"]: r["words"] for r in segmentation.segmented(texts, table, "id", "text", config).collect()}
    for i, text in rows[:60]:
        runs = re.findall(config.run, text)
        assert "".join(got[i]) == "".join(runs)
        assert set(got[i]) <= set(want)
    assert got[1000] == got[1001] == [] and got[1003] == ["x" * 100_000]
    weigh = lambda words: sum(table.weights.get(w, table.unknown) for w in words)
    for i, text in rows[:40]:
        for run in re.findall(config.run, text):
            best = segmentation.best_path(list(run), table)
            assert weigh(best) == plain_best(list(run), table.weights, table.unknown, table.longest)
    right = sum(w in WORDS for i, _ in rows[:300] for w in got[i])
    assert right > 0.95 * sum(len(got[i]) for i, _ in rows[:300])


def test_given_words_stay_whole_and_stop_words_go(spark):
    rows = [*corpus(100), (500, "毛利率的公司"), (501, "毛利率"), (502, "7 与 12 的 a")]
    texts = spark.createDataFrame(rows, "id long, text string")
    got = {r["id"]: r["words"] for r in segmentation.segment(texts, "id", "text", SegmentConfig(cohesion=1500)).collect()}
    assert "毛利率" in got[500] and "的" not in got[500] and got[501] == ["毛利率"] and got[502] == []


def test_the_dictionary_has_room_for_so_many(spark):
    texts = spark.createDataFrame(corpus(), "id long, text string")
    config = SegmentConfig(cohesion=1500, entries=30)
    java = config._replace(run=segmentation._java(config.run), unit=segmentation._java(config.unit))
    runs = segmentation.units(texts, "id", "text", java).select("units")
    all_words = {r["word"]: r["n"] for r in segmentation.lexicon(runs, config._replace(entries=10**6)).collect()}
    few = {r["word"]: r["n"] for r in segmentation.lexicon(runs, config).collect()}
    cut = sorted(all_words.values(), reverse=True)[30]
    assert few == {w: n for w, n in all_words.items() if n > cut} and len(few) <= 30


def test_an_empty_table_and_equal_paths(spark):
    none = spark.createDataFrame([], "id long, text string")
    assert segmentation.segment(none, "id", "text").collect() == []
    table = segmentation.Dictionary({"甲": -1, "乙": -1, "甲乙": -2}, -9, 2)
    assert segmentation.best_path(["甲", "乙"], table) == ["甲乙"]
    assert segmentation.best_path(["丙"], table) == ["丙"]


def test_keywords_of_segmented_texts(spark):
    texts = spark.createDataFrame(corpus(50), "id long, text string")
    words = segmentation.segment(texts, "id", "text", SegmentConfig(cohesion=1500)).select(F.col("id").alias("report_id"), F.explode("words").alias("word"))
    got = statistical.top_words(words, 3, texts.agg(F.count("id").alias("docs"))).collect()
    held = {}
    for r in words.collect():
        held.setdefault(r["report_id"], Counter())[r["word"]] += 1
    df = Counter(w for c in held.values() for w in c)
    for i, c in held.items():
        want = sorted(((-n * math.log(50 / df[w]), w) for w, n in c.items()))[:3]
        mine = sorted((r["rank"], r["word"], r["weight"]) for r in got if r["report_id"] == i)
        assert [round(x[2], 9) for x in mine] == [round(-x[0], 9) for x in want]


def test_the_dictionary_is_whole(spark):
    texts = spark.range(400_002).select("id", F.concat(F.lit("w"), F.col("id")).alias("text"))
    java = SegmentConfig()._replace(run=segmentation._java(SegmentConfig().run), unit=segmentation._java(SegmentConfig().unit))
    assert segmentation.lexicon(segmentation.units(texts, "id", "text", java).select("units")).count() == 400_002


def test_telling_words_cut_as_all_do(spark):
    config = SegmentConfig(cohesion=1500)
    texts = spark.createDataFrame([*corpus(), (900, "毛利率的公司"), (901, "公司毛利"), (902, "ABC 研究")], "id long, text string")
    java = config._replace(run=segmentation._java(config.run), unit=segmentation._java(config.unit))
    found = segmentation.lexicon(segmentation.units(texts, "id", "text", java).select("units"), config)
    whole, given = segmentation.dictionary(found, config, ["毛利率"]), segmentation.dictionary(segmentation.telling(found, config, ["毛利率"]), config, ["毛利率"], found.where("len = 1").agg(F.sum("n")).first()[0])
    unit = re.compile(config.unit)
    starts = segmentation.first_units(given, config.unit)
    for r in texts.collect():
        for run in re.findall(config.run, r["text"]):
            parts = unit.findall(run)
            assert segmentation.cut_up(parts, given, starts) == segmentation.best_path(parts, whole)
    assert len(given.weights) < len(whole.weights)
