"""Streams of metrics (metric, ts, value, id): alerts, daily counts, sessions; streams with state are in ``stateful``."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.operators import monitor
from auditloom.sources.shared import new_path


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """A stream of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def alert_stream(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Rows beyond their threshold: the batch operator, which keeps no state."""
    return monitor.alerts(metrics, thresholds)


def daily_counts(metrics: DataFrame, late: str = "1 hour") -> DataFrame:
    """(metric, day, n, mean) by event time; rows later than the watermark are dropped."""
    grouped = metrics.withWatermark("ts", late).groupBy("metric", F.window("ts", "1 day").alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select("metric", F.to_date("w.start").alias("day"), "n", "mean")


def trailing_counts(metrics: DataFrame, days: int = 30, late: str = "1 hour") -> DataFrame:
    grouped = metrics.withWatermark("ts", late).groupBy("metric", F.window("ts", f"{days} days", "1 day").alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("metric", F.col("w.end").alias("until"), "n")


def sessions(activity: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    grouped = activity.withWatermark("ts", late).groupBy("author", F.session_window("ts", gap).alias("s"))
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("author", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that is available, written to Parquet in the shared folder and read back. In ``complete`` mode the last
    batch, which holds every group, takes the place of those before; a batch that is run again writes the same files."""
    spark, schema = stream.sparkSession, stream.schema
    out, progress = new_path(spark, name), new_path(spark, f"{name}-progress")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema(schema).option("recursiveFileLookup", True)
    try:
        return found.parquet(out)
    except AnalysisException:  # no batch at all
        return spark.createDataFrame([], schema)
