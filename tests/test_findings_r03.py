"""Faults that showed on odd inputs and larger tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from auditloom.functions import text as X
from auditloom.operators import learning, monitor, similarity


def test_resolutions_have_no_frame_to_the_end(spark):
    """Such a frame is summed up anew for every row, so that time grows with the square of a metric's values."""
    rows = spark.createDataFrame([("a", 9.0, 1_000_000 * i, i) for i in range(9)], "metric string, value double, ts long, id long").withColumn("ts", F.timestamp_micros("ts"))
    found = monitor.resolutions(rows, spark.createDataFrame([("a", 5.0, 8.0)], "metric string, warning double, critical double"))
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()


def test_feature_weights_of_many_wrong_cases(spark):
    """0.9 to the number of cases is zero from 7 100 of them; the weights' ratio is not."""
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "feature string, weight double")
    wrong = spark.range(16_001).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("feature"), F.lit(0.9).alias("importance"))
    got = {r["feature"]: r["adapted"] for r in learning.adjust_feature_weights(weights, wrong).collect()}
    assert got == pytest.approx({"a": 4 * 0.9 / 3.9, "b": 4 * 3 / 3.9}, rel=1e-12)


def test_feature_weights_that_are_all_zero_stay(spark):
    weights = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "feature string, weight double")
    got = learning.adjust_feature_weights(weights, spark.createDataFrame([("a", 0.9)], "feature string, importance double")).collect()
    assert {r["feature"]: r["adapted"] for r in got} == {"a": 0.0, "b": 0.0}


def test_rounded_numbers_as_text(spark):
    values = [-0.0, 0.0, -0.004, -0.006, 0.004, 12.5, -3.25, 1e7, 12345678.125, -98765432.1, 999999999.99, 1e15, 1e16, -3e17, None]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(X.number_text(F.col("v"), 2)).collect()]
    assert got == [duckdb.execute("select round(?::double, 2)::varchar", [v]).fetchall()[0][0] for v in values]


def test_whole_numbers_in_texts(spark):
    texts = ["56.1", "56.5", "-2.5", ".5", "5.", "1e2", "5e-1", "9e9", "1_0", "1__0", "0x1F", "0b11", " 7\t", "+4", "--4", "1.e1", "0x", "", ".", "nan", "12d", "٣", "-0.4", "0xFFFFFFFFFFFFFFFFFF", None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(X.whole_number(F.col("t"))).collect()]
    assert got == [duckdb.execute("select try_cast(? as integer)", [t]).fetchall()[0][0] for t in texts]


def test_a_task_holds_a_block_of_samples(spark):
    samples = spark.range(40_000).select("id", F.array(F.col("id").cast("double")).alias("vector"), F.lit(0).alias("label"))
    sizes = lambda s, ids, labels, targets, target_labels: {"target": targets, "n": [len(ids)] * len(targets)}
    got = similarity._scored(samples, samples.where("id < 3"), "cosine", sizes, "target long, n long").groupBy("target").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()
    assert [r["n"] for r in got] == [40_000] * 3 and max(r["most"] for r in got) < 20_000
