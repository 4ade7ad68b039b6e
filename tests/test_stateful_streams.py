"""Streams with state against plain replays, in one batch and in several."""

import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from auditloom.operators import monitor
from auditloom.streaming import monitoring, stateful

SECOND = 1_000_000


def written(spark, path, rows, schema, files=4):
    """Rows in order of time, in several files that are read one a batch."""
    step = -(-len(rows) // files)
    for i in range(0, len(rows), step):
        df = spark.createDataFrame(rows[i : i + step], schema)
        df.withColumn("ts", F.timestamp_micros("ts")).coalesce(1).write.mode("append").parquet(path)
    return path


def events(n=400, seed=5):
    rng = random.Random(seed)
    at, rows = 1_700_000_000 * SECOND, []
    for i in range(n):
        at += rng.randint(1, 120) * SECOND
        rows.append((rng.choice("ab"), f"k{rng.randint(0, 8)}", at, i, rng.choice([1.0, 1.0, 1.0, 1.0, 9.0])))
    return rows


def plain_cache(rows, lifetime, capacity):
    held, out = {}, {}
    for shard, key, at, i, _ in rows:
        mine = held.setdefault(shard, OrderedDict())
        if key in mine and at - mine[key][0] < lifetime * SECOND:
            out[i] = (shard, True, mine[key][1])
            continue
        mine.pop(key, None)
        mine[key] = (at, i)
        if len(mine) > capacity:
            mine.popitem(last=False)
        out[i] = (shard, False, i)
    return out


def plain_resolutions(rows, last=5, age=300):
    out = {}
    for name in "ab":
        mine = [(at, i, value >= 5) for m, _, at, i, value in rows if m == name]
        until = max(at for _, _, at, _, _ in rows)
        for at, i, bad in mine:
            if bad:
                due = at + age * SECOND
                fine = lambda t: len(x := [b for s, _, b in mine if at < s <= t][-last:]) == last and not any(x)
                times = [t for t in sorted({due, *[s for s, _, _ in mine if s > due]}) if t <= until and fine(t)]
                if times:
                    out[i] = (name, at, times[0])
    return out


@pytest.mark.parametrize("files", [1, 4])
def test_cache_in_batches(spark, tmp_path, files):
    rows = events()
    path = written(spark, str(tmp_path / "in"), [r[:4] for r in rows], "shard string, key string, ts long, id long", files)
    stream = spark.readStream.schema("shard string, key string, ts timestamp, id long").option("maxFilesPerTrigger", 1).parquet(path)
    with stateful.state_on_disk(spark):
        got = monitoring.run_once(stateful.cached(stream, lifetime=900, capacity=4), "cache").collect()
    assert {r["id"]: (r["shard"], r["hit"], r["result_id"]) for r in got} == plain_cache(rows, 900, 4)
    assert len(got) == len(rows)


@pytest.mark.parametrize("files", [1, 4])
def test_resolutions_in_batches(spark, tmp_path, files):
    rows = events()
    named = [(r[0], r[4], r[2], r[3]) for r in rows]
    path = written(spark, str(tmp_path / "in"), named, "metric string, value double, ts long, id long", files)
    thresholds = spark.createDataFrame([("a", 5.0, 8.0), ("b", 5.0, 8.0)], "metric string, warning double, critical double")
    want = plain_resolutions(rows)
    told = lambda df: {r["id"]: (r["metric"], r["at"], r["done"]) for r in df.select("id", "metric", F.unix_micros("ts").alias("at"), F.unix_micros("resolved_ts").alias("done")).collect()}
    table = spark.read.parquet(path)
    assert told(monitor.resolutions(table, thresholds)) == want
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)
    with stateful.state_on_disk(spark):
        assert told(monitoring.run_once(stateful.resolutions(stream, thresholds), "resolved")) == want


def test_an_alert_resolves_without_a_next_value(spark, tmp_path):
    start = 1_700_000_000
    rows = [("a", v, (start + s) * SECOND, i) for i, (v, s) in enumerate([(9.0, 0), (1.0, 10), (1.0, 20), (1.0, 30), (1.0, 40), (1.0, 50)])]
    rows.append(("b", 1.0, (start + 400) * SECOND, 9))  # another metric moves time on
    path = written(spark, str(tmp_path / "in"), rows, "metric string, value double, ts long, id long", 2)
    thresholds = spark.createDataFrame([("a", 5.0, 8.0), ("b", 5.0, 8.0)], "metric string, warning double, critical double")
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    with stateful.state_on_disk(spark):
        got = monitoring.run_once(stateful.resolutions(stream, thresholds), "alone").select("id", F.unix_seconds("resolved_ts").alias("s")).collect()
    assert [tuple(r) for r in got] == [(0, start + 300)]


def test_old_alerts_go_if_resolved(spark):
    rows = [(1, "2024-01-01 00:00:00", True), (2, "2024-01-01 00:00:00", False), (3, "2024-02-01 00:00:00", True)]
    df = spark.createDataFrame(rows, "id int, ts string, resolved boolean").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r["id"] for r in monitor.retained(df, F.lit("2024-02-10").cast("timestamp")).collect()) == [2, 3]
    assert sorted(r["id"] for r in monitor.retained(df.drop("resolved"), F.lit("2024-02-10").cast("timestamp")).collect()) == [3]
