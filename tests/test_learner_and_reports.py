"""The learner's turn, answers, processors, records and reports against plain versions."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F
from test_plain_versions import plain_deviation, plain_sentiment, plain_summary

from auditloom.operators import explain, features, learner, processors, semantic, summaries
from auditloom.plans import registry
from auditloom.plans.tables import WORDS

SF = "/root/testdata/sf0.001"
SETS = "version int, threshold double, weight_statistical double, weight_behavioral double, weight_market double, weight_semantic double"


def plain_performance(rows, s):
    hits = [(a * s[1] + b * s[2] + c * s[3] + d * s[4] >= s[0], t) for a, b, c, d, t in rows]
    n, tp = len(hits), sum(h and t for h, t in hits)
    fp, fn = sum(h and not t for h, t in hits), sum(t and not h for h, t in hits)
    f1 = 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0
    return {"accuracy": (n - fp - fn) / n, "f1_score": f1, "false_positive_rate": fp / (n - tp - fn) if n - tp - fn else 0.0, "fp": fp / n, "fn": fn / n}


def plain_turn(rows, s, trigger):
    now = plain_performance(rows, s)
    sets = {"CURRENT": s}
    for name in summaries.STRATEGIES.get(trigger, ("THRESHOLDS",)):
        t, *w = s
        if name == "THRESHOLDS":
            t = min(0.9, t + 0.05) if now["fp"] > 0.3 else max(0.1, t - 0.05) if now["fn"] > 0.2 else t
        elif trigger == "PERFORMANCE_DEGRADATION" and name == "ENSEMBLE":
            w[3] = min(0.4, w[3] + 0.05)
            w = [x / sum(w) for x in w]
        sets[name] = (t, *w)
    told = {}
    for name, new in sets.items():
        after = plain_performance(rows, new)
        gains = [(after[m] - now[m]) * (1 if more else -1) for m, _, more in summaries.OBJECTIVES]
        gain = sum(g / max(now[m], 0.001) * k for g, (m, k, _) in zip(gains, summaries.OBJECTIVES)) / 3
        sure = min(1.0, max(0.0, gain + 0.5)) * (1.2 if all(g > 0 for g in gains) else 1)
        told[name] = (gain, min(1.0, sure))
    fit = [(-g, n) for n, (g, c) in told.items() if n != "CURRENT" and g > 0 and c >= 0.6]
    return sets, told, min(fit)[1] if fit else "CURRENT"


@pytest.mark.parametrize("trigger,threshold", [("PERFORMANCE_DEGRADATION", 0.8), ("PERFORMANCE_DEGRADATION", 0.2), ("FEEDBACK_ACCUMULATION", 0.5), ("BY_HAND", 0.75)])
def test_a_turn_and_the_way_back(spark, trigger, threshold):
    rng = random.Random(threshold)
    rows = [(rng.random() / 2 + t / 2, rng.random(), rng.random(), rng.random() / 2 + t / 2, t) for t in (rng.random() < 0.4 for _ in range(300))]
    detections = spark.createDataFrame([(*r[:4], bool(r[4])) for r in rows], "statistical double, behavioral double, market double, semantic double, truth boolean")
    history = spark.createDataFrame([(0, threshold, 0.25, 0.25, 0.25, 0.25)], SETS)
    turn = learner.tried(detections, learner.current(history), trigger)
    got = {r["strategy"]: r for r in turn.collect()}
    sets, told, chosen = plain_turn(rows, (threshold, 0.25, 0.25, 0.25, 0.25), trigger)
    assert set(got) == set(sets) and [s for s, r in got.items() if r["chosen"]] == [chosen]
    for name, (gain, sure) in told.items():
        assert got[name]["improvement"] == pytest.approx(gain) and got[name]["confidence"] == pytest.approx(sure)
    after = learner.applied(history, turn)
    assert after.count() == (1 if chosen == "CURRENT" else 2)
    newest = learner.current(after).first()
    assert [newest["threshold"], newest["weight_semantic"]] == pytest.approx([sets[chosen][0], sets[chosen][4]])
    back = learner.rolled_back(after)
    assert learner.current(back).first()["threshold"] == pytest.approx(threshold)
    assert back.count() == (1 if chosen == "CURRENT" else 3)


def test_answers(spark):
    rows = [("信息源异常", 0.9, 0.1, "neutral"), ("可靠性：低", 0.6, 0.1, "neutral"), ("中等，一般", 0.3, 0.5, "neutral"), ("很差", 0.1, 0.9, "neutral"), (" POSITIVE 良好", 0.1, 0.2, "positive"), ("消极", 0.1, 0.1, "negative"), ("积极而消极", 0.1, 0.1, "positive"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "t string, source double, consistency double, sentiment string")
    t = F.col("t")
    got = df.select("*", semantic.answer(t, "source").alias("a"), semantic.answer(t, "consistency").alias("b"), semantic.answer(t, "sentiment_analysis")["label"].alias("c"), semantic.answer(t, "other").alias("d"), semantic.answer(t, "anomaly_pre_detection").alias("e")).collect()
    for r in got:
        assert (r["a"], r["b"], r["c"]) == (r["source"], r["consistency"], r["sentiment"])
    assert tuple(got[4]["d"]) == ("positive 良好", 0.5) and tuple(got[0]["e"]) == ("anomaly", 0.8) and got[-1]["d"] is None


def test_processors(spark):
    df = spark.createDataFrame([(1, "a report of some length", "x"), (2, None, "y"), (3, " ", None)], "id long, content string, lang string")
    known = processors.standard()
    known.register("upper", lambda d: F.upper("lang"))
    got = {(r["id"], r["processor"]): r for r in known.run(df, "id", ["quality_check", "upper", "feature_extraction"]).collect()}
    assert len(got) == 9 and got[1, "upper"]["result"] == '{"value":"X"}' and got[3, "upper"]["error"] == "no result"
    assert json.loads(got[1, "feature_extraction"]["result"])["value"] == {"char_count": 23, "word_count": 4}
    assert not got[2, "quality_check"]["success"]
    with pytest.raises(ValueError, match="nothing"):
        known.run(df, "id", ["nothing"])


def test_records(spark):
    record = {"basic_info": {"title": "T", "institution": "I", "publish_date": "2024-01-02"}, "core_content": {"main_logic": ["a", "b"], "risk_warning": "r"}, "deep_analysis": {"analysis_summary": {"key_insights": ["k"]}}, "investment_advice": {"rating": "买入"}, "meta_info": {"success": True}}
    df = spark.createDataFrame([(1, json.dumps(record)), (2, "{}"), (3, '{"core_content": {"main_logic": "one text"}}')], "id long, t string").select("id", F.parse_json("t").alias("data"))
    got = {r["id"]: r for r in features.record_features(df, "id").collect()}
    assert (got[1]["texts"]["title"], got[1]["texts"]["main_logic"], got[1]["texts"]["key_insights"], got[1]["texts"]["stock_name"]) == ("T", "a b", "k", "")
    assert (got[1]["categories"]["rating"], got[1]["categories"]["success"], got[1]["meta"]["publish_date"]) == ("买入", "true", "2024-01-02")
    assert got[3]["texts"]["main_logic"] == "one text" and set(got[2]["texts"]) == {""}


def test_a_set_without_change_is_reported(spark):
    rows = spark.createDataFrame([(1, 2.0, 3.0)], "k long, a double, b double")
    sets = explain.candidates(rows, "k", ["a", "b"], ((1.0, 1.0),))
    compared = explain.comparison(sets, "k", ["a", "b"], lambda f: f["a"] * f["b"])
    assert tuple(compared.first()) == (1, 0, "", 0.0, 1.0, 0.0)
    assert tuple(explain.comparison_summary(compared, "k").first()) == (1, 1, 0.0, 1.0, "")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_fusion_with_views(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()
    told = {r["doc_id"]: (plain_summary(r["text"]), plain_sentiment(r["text"])) for r in rows}
    at = lambda i: (i % 720, str(i))
    by_source = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append(r["doc_id"])
    got = {r["report_id"]: r for r in registry.queries()["fusion_with_views"](spark, SF).collect()}
    assert len(got) == len(rows)
    rules = {r["report_id"]: r for r in semantic.rules(spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("report_id"), F.col("text").alias("content")), WORDS).collect()}
    some = 0
    for r in rows:
        i = r["doc_id"]
        # Views of the report's own moment are before it, too: a view counts as earlier if it is not later.
        earlier = sorted((j for j in by_source.get(r["source"], []) if at(j)[0] < at(i)[0]), key=at)[-5:] if r["source"] is not None else []
        if not any(at(j)[0] == at(i)[0] for j in by_source.get(r["source"], []) if j != i) and got[i]["n_views"] == len(earlier) and earlier:
            some += 1
            similar, gap, score = plain_deviation(told[i], [told[j] for j in earlier])
            assert got[i]["deviation"] == pytest.approx(score, abs=2e-6)
        x = rules[i]
        semantic_score = 0.3 * x["contradiction"] + 0.3 * got[i]["deviation"] + 0.2 * x["source"] + 0.2 * x["consistency"]
        assert got[i]["semantic"] == pytest.approx(semantic_score, abs=3e-6)
        assert got[i]["score"] == pytest.approx((got[i]["statistical"] + got[i]["semantic"]) / 2, abs=3e-6)
    assert some > 100
