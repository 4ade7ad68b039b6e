"""Percentiles of keys and windows, forests that are kept, histories brought up to date, contrastive loss, number spans,
running sums by ranges: against plain versions."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.functions.spans import apart, number_spans
from auditloom.operators import evaluation, forest, history, monitor, quantiles


def test_percentiles_of_keys(spark):
    rng = random.Random(2)
    rows = [("hot", float(rng.randint(0, 50))) for _ in range(3000)] + [("one", 7.0), ("two", 1.0), ("two", 2.0), (None, 3.0), (None, 5.0), ("null", None), ("nan", float("nan"))]
    got = {r["k"]: (r["n"], r["p"]) for r in quantiles.by_key(spark.createDataFrame(rows, "k string, v double"), "k", "v", (0.0, 0.05, 0.5, 0.333, 1.0)).collect()}
    held = {}
    for k, v in rows:
        if v is not None and v == v:
            held.setdefault(k, []).append(v)
    assert set(got) == set(held)
    for k, values in held.items():
        assert got[k][0] == len(values)
        np.testing.assert_allclose(got[k][1], np.quantile(values, (0.0, 0.05, 0.5, 0.333, 1.0)))
    assert quantiles.by_key(spark.createDataFrame([], "k string, v double"), "k", "v", (0.5,)).collect() == []


def test_sketches_merge_to_any_window(spark):
    rng = np.random.default_rng(1)
    values = rng.lognormal(size=40_000)
    rows = spark.createDataFrame([("m", int(i % 48), float(v)) for i, v in enumerate(values)], "metric string, h int, value double").withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("h") * 3600))
    kept = quantiles.sketches(rows, ["metric"], "ts", "value")
    assert kept.count() == 48
    shares = (0.01, 0.25, 0.5, 0.75, 0.99)
    whole = quantiles.from_sketches(kept, ["metric"], shares).first()
    day = quantiles.from_sketches(kept.where("hour < timestamp '2024-01-02'"), ["metric"], shares).first()
    for found, mine in ((whole, values), (day, values[np.arange(40_000) % 48 < 24])):
        assert found["n"] == len(mine)
        assert all(abs((mine <= q).mean() - s) <= 3 * quantiles.rank_error() for q, s in zip(found["p"], shares))


def test_a_forest_is_kept_and_scored_without_python(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, *map(float, rng.normal(size=3)), 1.0) for i in range(500)] + [(900, 8.0, 8.0, 8.0, 1.0), (901, None, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, same double")
    names = ["a", "b", "c", "same"]
    grown = forest.grow(df, "id", names, trees=20, sample=64)
    forest.save(grown, str(tmp_path / "forest"))
    scored = forest.score(df, forest.load(spark, str(tmp_path / "forest")), 6)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    got = {r["id"]: r["score"] for r in scored.collect()}
    nodes = {(r["tree"], r["node"]): r for r in grown.nodes.collect()}
    scale = {r["name"]: r for r in grown.scale.collect()}
    assert got[901] is None and got[900] > np.mean([s for s in got.values() if s is not None])
    for i, *x in rows[:60]:
        z = [(v - scale[n]["mean"]) / scale[n]["std"] if scale[n]["std"] > 0 else 0.0 for n, v in zip(names, x)]
        total = 0.0
        for t in range(20):
            node = nodes[t, 0]
            while node["feature"] >= 0:
                node = nodes[t, node["left"] if z[node["feature"]] < node["cut"] else node["right"]]
            total += node["length"]
        assert got[i] == pytest.approx(2 ** (-total / 20 / grown.average))
    assert forest.outliers(df.limit(0), "id", names).collect() == []


def test_a_history_writes_only_what_it_touches(spark, tmp_path):
    path, rng, held = str(tmp_path / "kept"), random.Random(6), {}
    schema = "k string, at int, v int"
    assert history.read(spark, path, schema).collect() == []
    stamps = lambda: {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("bucket=")}
    for turn in range(4):
        keys = [f"k{rng.randint(0, 30)}" for _ in range(3)]
        rows = [(k, 100 * turn + j, rng.randint(0, 9)) for k in keys for j in range(rng.randint(1, 6))]
        rows = list({(k, a): (k, a, v) for k, a, v in rows}.values())
        before = stamps() if turn else {}
        touched = history.update(spark, path, spark.createDataFrame(rows, schema), "k", ["at"], 4, 16)
        after = stamps()
        assert {d for d in after if after[d] != before.get(d)} == {f"bucket={b}" for b in touched}
        for r in rows:
            held.setdefault(r[0], {})[r[1]] = r
        want = sorted(r for m in held.values() for r in sorted(m.values(), key=lambda r: r[1])[-4:])
        assert sorted(tuple(r) for r in history.read(spark, path, schema).select("k", "at", "v").collect()) == want
        history.update(spark, path, spark.createDataFrame(rows, schema), "k", ["at"], 4, 16)  # again, to no effect
        assert sorted(tuple(r) for r in history.read(spark, path, schema).select("k", "at", "v").collect()) == want
    assert history.update(spark, path, spark.createDataFrame([], schema), "k", ["at"], 4, 16) == []


@pytest.mark.parametrize("block", [7, 512])
def test_contrastive_loss_of_all_pairs(spark, block):
    rng = np.random.default_rng(8)
    rows = [(i, i % 3, int(rng.integers(3)), (rng.normal(size=4) if i % 10 else np.zeros(4)).tolist()) for i in range(90)] + [(200, 9, 1, [1.0, 0.0, 0.0, 0.0])]
    got = {r["batch"]: r for r in evaluation.contrastive(spark.createDataFrame(rows, "id long, batch int, label int, vector array<double>"), "id", 1.2, block).collect()}
    for b in (0, 1, 2, 9):
        mine = [(y, np.array(v) / max(np.linalg.norm(v), 1e-12)) for _, batch, y, v in rows if batch == b]
        total = sum(((p - q) ** 2).sum() if y == z else max(0.0, 1.2 - np.linalg.norm(p - q)) ** 2 for i, (y, p) in enumerate(mine) for z, q in mine[i + 1 :])
        assert got[b]["n"] == len(mine) and got[b]["contrastive"] == pytest.approx(total / max(len(mine) * (len(mine) - 1) / 2, 1))


def test_number_spans(spark):
    texts = ["营收 12.5 亿元，增长15.3%，目标价 30元，2024年 3倍", "市盈率 20.5倍 3万元 5 万股", "", None, "😀 7%"]
    got = [r["s"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(number_spans(F.col("t")).alias("s")).collect()]
    told = lambda s: [(x["kind"], x["value"], x["text"]) for x in s]
    assert told(got[0]) == [("money_yi", 12.5, "12.5 亿元"), ("money_yuan", 30.0, "30元"), ("percentage", 15.3, "15.3%"), ("multiple", 3.0, "3倍"), ("target_price", 30.0, "目标价 30"), ("year", 2024.0, "2024年")]
    assert all(t[x["start"] : x["end"]] == x["text"] for t, s in zip(texts, got) if t for x in s)
    assert got[2] == got[3] == [] and [(x["start"], x["end"]) for x in got[4]] == [(2, 4)]
    single = spark.createDataFrame([(texts[0],), (texts[1],)], "t string").select(number_spans(F.col("t"), overlaps=False).alias("s")).collect()
    assert ("target_price", 30.0, "目标价 30") in told(single[0]["s"]) and ("money_yuan", 30.0, "30元") not in told(single[0]["s"])
    rng = random.Random(1)
    for _ in range(200):
        found = [(0.0, "", "", a, a + rng.randint(1, 5)) for a in (rng.randint(0, 20) for _ in range(8))]
        kept = apart(found)
        assert all(x is y or x[4] <= y[3] or y[4] <= x[3] for x in kept for y in kept)
        for s in found:
            assert s in kept or any(s[3] < k[4] and k[3] < s[4] and k[4] - k[3] >= s[4] - s[3] for k in kept)


def test_running_sums_by_ranges(spark):
    rng = random.Random(9)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randint(0, 3)}", rng.randint(0, 40), i, rng.randint(0, 3)) for i in range(800)]
    got = monitor.running(spark.createDataFrame(rows, "k string, t int, id int, v long"), "k", ["t", "id"], F.col("v"), "n").collect()
    sums = {}
    for k, _, i, v in sorted(rows):
        sums[k] = sums.get(k, 0) + v
        assert next(r["n"] for r in got if r["id"] == i) == sums[k] if i % 50 == 0 else True
    assert len(got) == 800 and math.isclose(sum(sums.values()), sum(r[3] for r in rows))
