"""Queries that SQL cannot express, against plain Python versions; helpers with edge cases."""

import difflib
import json
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.functions import text as X
from auditloom.operators import explain, features, forest, fusion, intake, learning, monitor, quantiles, semantic, similarity, statistical
from auditloom.plans import registry
from auditloom.plans.tables import NEGATIVE, POSITIVE
from auditloom.sources import files

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain_tokens(text):
    return [w for w in re.findall(r"\w+", text or "") if len(w) > 1 and not w.isdecimal()]


def plain_sentiment(text):
    words = plain_tokens(text)
    return (sum(w in POSITIVE for w in words) - sum(w in NEGATIVE for w in words)) / len(words) if words else 0.0


def plain_summary(text, keywords=POSITIVE + NEGATIVE):
    sentences = [s.strip(" \t\n\r\x0b\x0c") for s in re.split("[.!?]", text or "")]
    sentences = [s for s in sentences if len(s) > 10]
    best = max(sentences, key=lambda s: (sum(k in s for k in keywords), -sentences.index(s)), default=text or "")
    return best[:100] + "..." if len(best) > 100 else best


def plain_deviation(turn, views):
    """``turn`` and ``views``: (summary, sentiment)."""
    similar = sum(difflib.SequenceMatcher(None, turn[0], v[0]).ratio() for v in views) / len(views)
    gap = sum(abs(turn[1] - v[1]) / 2 for v in views) / len(views)
    return similar, gap, min((1 - similar) * (gap + 0.5), 1.0) if similar < 0.4 and gap > 0.5 else 0.0


@tables
def test_view_deviation(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    told = {(r["conv_id"], r["turn"], r["role"]): (plain_summary(r["text"]), plain_sentiment(r["text"])) for r in rows}
    got = {r["report_id"]: r for r in registry.queries()["view_deviation"](spark, SF).collect()}
    n = 0
    for (c, t, role), turn in told.items():
        views = [told[k] for k in sorted((k for k in told if k[0] == c and k[2] == role and k[1] < t), key=lambda k: -k[1])[:5]]
        assert (f"{c}-{t}" in got) == bool(views)
        if views:
            n += 1
            similar, gap, score = plain_deviation(turn, views)
            r = got[f"{c}-{t}"]
            assert (r["n_views"], r["similarity"], r["gap"], r["score"]) == (len(views), pytest.approx(similar, abs=2e-6), pytest.approx(gap, abs=2e-6), pytest.approx(score, abs=2e-6))
    assert n > 20
    worst = {r["report_id"]: r["score"] for r in registry.queries()["historical_deviation"](spark, SF).collect()}
    for (c, t, role), turn in told.items():
        scores = []
        for mine in ({k for k in told if k[0] == c and k[2] == role and k[1] < t}, {k for k in told if k[0] == c and k[1] < t}):
            views = [told[k] for k in sorted(mine, key=lambda k: -k[1])[:5]]
            scores += [plain_deviation(turn, views)[2]] if views else []
        assert worst.get(f"{c}-{t}") == (pytest.approx(max(scores), abs=2e-6) if scores else None)


def test_long_texts_are_compared_whole(spark):
    same = "Common beginning of both texts. " * 20
    rows = [("k", 0, same + "the the the and of one ending."), ("k", 1, same + "die les de of another end altogether.")]
    c = spark.createDataFrame(rows, "key string, i int, text string").withColumn("s", semantic.view_summary(F.col("text"), ("ending", "altogether"), end="[.!?]"))
    assert sorted(r["s"] for r in c.collect()) == ["die les de of another end altogether", "the the the and of one ending"]


def test_recent_views_edges(spark):
    reports = spark.createDataFrame([("a", "k", 10), ("b", "k", 0), ("c", "x", 5)], "report_id string, key string, t long").withColumn("ts", F.timestamp_seconds("t"))
    views = spark.createDataFrame([("k", f"v{i}", i) for i in range(12)] + [("k", "w9", 9)], "key string, view_id string, t long").select("key", "view_id", F.timestamp_seconds("t").alias("view_ts"))
    got = sorted(r["view_id"] for r in semantic.recent_views(reports, views, k=3).collect())
    assert got == ["v8", "v9", "w9"]
    assert semantic.last_views(views, 2).count() == 2


def test_fold_weights(spark):
    rng = random.Random(5)
    rows = [(g, i, *(rng.choice([None, rng.random()]) for _ in range(4)), rng.random()) for g in "ab" for i in range(150)] + [("a", 7, 0.1, 0.2, 0.3, 0.4, 0.5), ("c", 0, 0.5, 0.5, 0.5, 0.5, None)]
    frame = spark.createDataFrame(rows, "group string, at long, statistical double, behavioral double, market double, semantic double, score double")
    got = {r["group"]: [r[f] for f in fusion.FAMILIES] for r in fusion.fold_weights(frame.dropDuplicates(["group", "at"])).collect()}
    kept = {}
    for r in frame.dropDuplicates(["group", "at"]).collect():
        kept.setdefault(r["group"], []).append(r)
    for g in "ab":
        w = [0.25] * 4
        for r in sorted(kept[g], key=lambda r: r["at"]):
            w = [min(1.5, max(0.1, x + (0 if r[f] is None else 0.1 * (0.5 - abs(r[f] - r["score"]))))) for x, f in zip(w, fusion.FAMILIES)]
            w = [x / sum(w) for x in w]
        assert got[g] == pytest.approx(w)
    assert set(got) == {"a", "b"}


def test_counterfactuals(spark):
    rows = [(i, float(i % 50 + 1), 900.0 + i) for i in range(60)] + [(100, 0.0, 0.0)]
    frame = spark.createDataFrame(rows, "k long, a double, b double")
    got = {r["k"]: r for r in similarity.counterfactuals(frame, "k", ["a", "b"], 1000.0, iterations=40).collect()}
    keys = {r["k"]: r["h"] for r in frame.select("k", F.xxhash64(F.lit(42), F.col("k").cast("string")).alias("h")).collect()}
    for k, a, b in rows:
        best = [a, b]
        for step in range(40):
            f = similarity.climb_step(np.array([keys[k]], np.int64).view(np.uint64), step, 2, 2)[0]
            trial = [x * y for x, y in zip(best, f)]
            if abs(sum(trial) - 1000) < abs(sum(best) - 1000):
                best = trial
        r = got[k]
        assert (r["before"], r["after"], r["a_to"], r["b_to"]) == pytest.approx((a + b, sum(best), *best))
        assert abs(r["after"] - 1000) <= abs(r["before"] - 1000)
    factors = similarity.climb_step(np.arange(1000, dtype=np.uint64), 3, 5, 2)
    assert ((factors != 1).sum(axis=1) == 2).all() and factors.min() >= 0.8 and factors.max() <= 1.2 and abs(factors[factors != 1].mean() - 1) < 0.02


def test_diverse_choice(spark):
    rng = random.Random(2)
    factors = [(rng.choice([0.8, 1.0, 1.2]), rng.choice([0.9, 1.0, 1.1])) for _ in range(7)]
    rows = [(i, rng.uniform(1, 9), rng.uniform(-5, 5)) for i in range(30)]
    sets = explain.candidates(spark.createDataFrame(rows, "k long, a double, b double"), "k", ["a", "b"], factors)
    got = {r["k"]: r["chosen"] for r in explain.diverse(sets, "k", ["a", "b"], 4).collect()}
    far = lambda p, q: sum(abs(x - y) / (abs(x) + abs(y) + 1e-6) for x, y in zip(p, q))
    for k, a, b in rows:
        ex = {i: (a * f, b * g) for i, (f, g) in enumerate(factors)}
        chosen = [min(ex, key=lambda i: (sum(x != y for x, y in zip(ex[i], (a, b))), i))]
        while len(chosen) < 4:
            chosen.append(min((i for i in ex if i not in chosen), key=lambda i: (-min(far(ex[i], ex[c]) for c in chosen), i)))
        assert got[k] == chosen
    assert explain.diverse(sets.limit(1), "k", ["a", "b"], 20).first()["chosen"].__len__() == 7


def test_isolation_forest_ranks_like_plain_trees(spark):
    """Against plain trees of the same kind, grown from another seed: the same rows stand out."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(300, 3)), rng.normal(size=(12, 3)) * 0.3 + 6])
    frame = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double, c double")
    got = {r["id"]: r["score"] for r in forest.outliers(frame, "id", ["a", "b", "c"], trees=60, sample=128, contamination=0.04).collect()}
    z = (x - x.mean(0)) / x.std(0)

    def depth(v, part, level):
        if level == 7 or len(part) <= 1:
            n = len(part)
            return level + (2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2))
        j = rng.integers(3)
        lo, hi = part[:, j].min(), part[:, j].max()
        cut = rng.uniform(lo, hi)
        return depth(v, part[(part[:, j] < cut) == (v[j] < cut)], level + 1)

    plain = {i: np.mean([depth(z[i], z[rng.choice(len(z), 128, replace=False)], 0) for _ in range(30)]) for i in [*range(0, 300, 12), *range(300, 312)]}
    order = sorted(plain, key=plain.get)
    assert set(order[:12]) == set(sorted(plain, key=lambda i: -got[i])[:12]) == set(range(300, 312))
    assert np.corrcoef([plain[i] for i in order], [-got[i] for i in order])[0, 1] > 0.9


@tables
def test_sentences_once(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    import hashlib

    got = {r["report_id"]: r["digest"] for r in registry.queries()["dedup_sentences"](spark, SF).collect()}
    space = " \t\n\r\x0b\x0c"
    for r in rows:
        t = re.sub(r"(.)\1{3,}", r"\1\1\1", r["text"] or "")
        t = re.sub(r"([^ \t\n\x0b\x0c\r]+)([ \t\n\x0b\x0c\r]+\1){2,}", r"\1", t)
        parts = [p.strip(space) for p in t.split(".")]
        assert got[r["doc_id"]] == hashlib.md5(".".join(dict.fromkeys(p for p in parts if p)).encode()).hexdigest(), r["doc_id"]


def plain_clean(text):
    t = re.sub("<[^>]+>", "", text or "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        t = t.replace(entity, char)
    t = re.sub("&[a-zA-Z0-9#]+;", "", re.sub("<[^>]+>", "", t))
    t = re.sub("[\U00010000-\U0010ffff]", "", t)
    t = re.sub("[​-‏ -  -⁯﻿]", "", re.sub("[\x00-\x1f\x7f-\x9f]", "", t))
    t = re.sub(r"[ \t\x0b\x0c\r]+", " ", t).replace(",", " ")
    for pattern in ("(?i)免责声明|风险提示|投资建议|市场有风险|投资需谨慎|本报告|仅供参考", "(?i)广告|推广|扫码|微信|QQ|电话|邮箱|网址|链接"):
        t = "。".join(s for s in t.split("。") if not re.search(pattern, s))
    t = re.sub(r"([0-9]{3,4}[- ]?[0-9]{7,8})|([A-Za-z0-9_]+@[A-Za-z0-9_]+\.[A-Za-z0-9_]+)|(www\.[A-Za-z0-9_]+\.[A-Za-z0-9_]+)", "", t)
    t = re.sub(r"(.)\1{3,}", r"\1\1\1", t)
    t = re.sub(r"([^ ]+)( +\1){2,}", r"\1", t)
    t = "。".join(dict.fromkeys(p.strip() for p in t.split("。") if p.strip())).strip(" ")
    return t if not t or t[-1] in "。！？…" else t + "。"


@tables
def test_full_cleaning(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, "<b>报告</b>，内容 广告扫码。重复重复重复。句子。句子。&lt;x&gt; 010-12345678"), (-3, "")], "doc_id long, text string")
    for r in docs.union(extra).select("doc_id", "text", X.clean(F.col("text")).alias("cleaned")).collect():
        assert r["cleaned"] == plain_clean(r["text"]), r["doc_id"]


def test_percentiles(spark):
    rng = np.random.default_rng(1)
    for values in (rng.normal(size=3000).tolist(), [5.0] * 40, [1.0, 2.0], rng.integers(0, 4, 500).astype(float).tolist(), [0.0] * 900 + rng.normal(size=100).tolist()):
        frame = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
        for few in (1, 10, 20_000):
            got = quantiles.percentiles(frame, "v", (0.0, 0.05, 0.5, 0.95, 1.0), bins=16, few=few)
            assert got == pytest.approx(np.percentile(values, [0, 5, 50, 95, 100]).tolist())
    assert quantiles.percentiles(frame.where("false"), "v", (0.5,)) == [None]


def test_numbering(spark):
    rows = [("a", i * 7 % 101, i) for i in range(101)] + [("b", 0, i) for i in range(5)]
    got = monitor.numbered(spark.createDataFrame(rows, "m string, t int, id int").repartition(7), "m", ["t", "id"]).collect()
    for m in "ab":
        mine = sorted((r["t"], r["id"], r["i"]) for r in got if r["m"] == m)
        assert [i for _, _, i in mine] == list(range(1, len(mine) + 1))


@tables
def test_statistical_scores_read_the_texts_twice(spark):
    """One reading makes the features, which are written; the plan of the scores has one scan of texts, for the words."""
    from auditloom.plans.report_queries import statistical_scores

    plan = statistical_scores(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 1


def test_self_novelty_is_novelty_against_itself(spark):
    docs = spark.createDataFrame([(1, "aa bb cc aa"), (2, "bb dd"), (3, ""), (4, None), (5, "ee ee")], "report_id long, content string")
    words = statistical.vocabulary(docs).where("n > 1")
    a = {tuple(r) for r in statistical.vocabulary_novelty(docs, words).collect()}
    assert a == {tuple(r) for r in statistical.self_novelty(docs).collect()}


def test_searches_are_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=6)], int(rng.integers(3))) for i in range(90)] + [(200, [0.0] * 6, 1), (300, None, 1)]
    frame = spark.createDataFrame(rows, "id long, vector array<float>, label int")
    x = {i: (np.array(v, np.float32).astype(float), y) for i, v, y in rows if v}
    cos = lambda a, b: 0.0 if not a.any() or not b.any() else float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    targets = frame.where("id % 20 = 0")
    got = similarity.nearest(frame, targets, 4, 2).collect()
    for t in (i for i in x if i % 20 == 0):
        for same, k in ((True, 4), (False, 2)):
            want = sorted(((-cos(x[t][0], v), i) for i, (v, y) in x.items() if i != t and (y == x[t][1]) == same))[:k]
            mine = sorted((r["rank"], r["id"], r["similarity"]) for r in got if r["target"] == t and r["same_class"] == same)
            assert [s for _, _, s in mine] == pytest.approx([-s for s, _ in want]) and (len({s for s, _ in want}) < k or [i for _, i, _ in mine] == [i for _, i in want])
    small = similarity._scored(frame, targets, "cosine", lambda s, i, a, t, b: {"target": np.repeat(t, len(i)), "id": np.tile(i, len(t)), "v": s.ravel()}, "target long, id long, v double", block=16, target_block=2)
    assert small.dropDuplicates(["target", "id"]).count() == small.count() == 6 * 91


def test_adaptation(spark):
    names = spark.createDataFrame([("a", 0.89), ("b", 0.95), ("c", 0.05)], "name string, threshold double")
    rows = [("FALSE_POSITIVE", 0)] * 4 + [("CORRECT", 1)] * 6 + [("MISSED", 40)] * 90
    given = spark.createDataFrame(rows, "feedback_type string, days int").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) - F.col("days") * 86400))
    as_of = F.timestamp_seconds(F.lit(1_700_000_000))
    assert {r["name"]: round(r["adapted"], 6) for r in learning.adapt_thresholds(names, given, as_of).collect()} == {"a": 0.9, "b": 0.9, "c": 0.1}
    low = {r["name"]: round(r["adapted"], 6) for r in learning.adapt_thresholds(names, given, as_of, 60).collect()}
    assert low == {"a": 0.84, "b": 0.9, "c": 0.1}
    assert spark.range(1).select(semantic.answer_score(F.lit("nothing named")).alias("a"), semantic.answer_score(F.lit(None).cast("string")).alias("b")).first().asDict() == {"a": 0.0, "b": None}


def test_sinks_and_states(spark, tmp_path):
    path = str(tmp_path / "s")
    assert files.load_state(spark, path, "a long").count() == 0
    files.save_state(spark.range(3).withColumnRenamed("id", "a"), path)
    assert files.load_state(spark, path, "a long").count() == 3
    files.reset_state(spark, path, "a long")
    assert files.load_state(spark, path, "a long").count() == 0
    for text in ("one", "two"):
        files.write_text_safely(spark.createDataFrame([(text,)], "value string"), str(tmp_path / "t"), str(tmp_path / "backup"))
    assert (spark.read.text(str(tmp_path / "t")).first()[0], spark.read.text(str(tmp_path / "backup")).first()[0]) == ("two", "one")
    results = spark.createDataFrame([(1, "success", 0.5), (2, "failed", None)], "id long, status string, score double")
    files.export_results(results, str(tmp_path / "csv"), ["id", "score"])
    files.export_results(results, str(tmp_path / "json"), [], "json")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1 and spark.read.json(str(tmp_path / "json")).count() == 2
    files.save_collected(results, str(tmp_path / "c"), "bars", F.lit("2024-01-01").cast("timestamp"))
    assert spark.read.json(str(tmp_path / "c")).first()["metadata"]["source"] == "bars"
    for large, name in ((1, "results"), (1000, "rows")):
        files.save_batch(results, str(tmp_path / f"b{large}"), "run", large)
        assert spark.read.json(f"{tmp_path}/b{large}/run/{name}").count() == 2 and spark.read.json(f"{tmp_path}/b{large}/run/summary").first()["successful"] == 1
    assert files.read_reports(spark, [{"content": "x"}]).first()["content"] == "x"


def test_files_and_folders(spark, tmp_path):
    (tmp_path / "a.txt").write_text("行业研究报告 2025年1月3日 买入评级")
    (tmp_path / "b.txt").write_text("  ")
    (tmp_path / "c.json").write_text("{bad")
    listed = {r["name"]: r["suffix"] for r in files.list_files(spark, str(tmp_path)).collect()}
    assert listed == {"a.txt": ".txt", "b.txt": ".txt", "c.json": ".json"}
    done = {r["path"].rsplit("/", 1)[-1]: r for r in files.process_files(spark, str(tmp_path), lambda b: str(len(json.loads(b))), "c.json").collect()}
    assert not done["c.json"]["ok"] and "Expecting" in done["c.json"]["result"]
    converted, report = files.convert_folder(spark, str(tmp_path), F.lit("2024-01-01"))
    assert converted.count() == 1 and {r["status"]: r["n"] for r in report.collect()} == {"converted": 1, "failed": 1}


def test_intake_edges(spark):
    row = spark.range(1).select(
        intake.request_problems(F.lit(None).cast("string"), F.array(F.lit(2.0)), F.lit(1), F.lit(1), F.lit("x")).alias("a"), intake.intake_quality({"theme": F.lit(None).cast("boolean")}, F.lit(1500), F.lit(6000)).alias("q"),
        intake.named(F.lit("市场风险与政策风险")).alias("n"), intake.figures(F.lit("PE为12.5倍，增长 20%，收入3亿"))["pe_ratios"].alias("pe"), intake.key_stocks(F.lit("汽车 宇通客车")).alias("k"),
    ).first()
    assert row["a"] == "content,thresholds,range,action" and row["q"] == 25 and row["n"] == ["市场风险", "政策风险"] and row["pe"] == ["12.5"]
    assert [tuple(x) for x in row["k"]] == [("1.2", "汽车", "宇通客车")]
    nested = spark.sql("select named_struct('x', 1.0005D) as s, array(2.5D) as a, map('k', 0.12345D) as m, 'text' as t")
    got = intake.rounded(nested, 2).first()
    assert (got["s"]["x"], got["a"], got["m"], got["t"]) == (1.0, [2.5], {"k": 0.12}, "text")
    f = features.metadata_features(F.lit(None).cast("string"), F.lit(None).cast("array<string>"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("行业研究"))
    assert list(spark.range(1).select(*[v.alias(k) for k, v in f.items()]).first()) == [0, 0, 0, 0, 0, 0, 0, 0.5, 2]
    assert X is not None
