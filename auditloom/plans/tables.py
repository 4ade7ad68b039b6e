"""The test tables in the shape that the operators expect, and the word lists that occur in them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.config import LEXICONS
from auditloom.sources.shared import hadoop

#: The tables hold no Chinese, so queries pass words that occur.
POSITIVE, NEGATIVE = ("the", "and", "der", "que"), ("of", "die", "les", "de")
NUMBERS = (r"(\d+\.?\d*)",)
WORDS = replace(
    LEXICONS, positive=POSITIVE, negative=NEGATIVE, polar_positive=("the ", "der ", "que "), polar_negative=("of ", "die ", "les "), contradiction=(" but ", " not ", " nicht ", " mais ", " pero ", " that "),
    uncertainty=("erer", "anti", "enen", "thin", "onha", "tion", "ieu"), source_patterns=("from [a-z]+ by", "ist [a-z]+ der", "par [a-z]+ la"), formal=("tion", "ung", "ment"), casual=("ing", "ich", "oi"), sentence_end="[.!?]", disclaimer="(?i)license|copyright|rights",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table that is still dealt out; so much is shuffled at most, on any cluster.
SMALL = 64 << 20


def spread(spark: SparkSession, path: str) -> DataFrame:
    """A table whose rows are dealt to all cores if it is small: a small file is often one row group, which is one task
    however the file is split. Larger tables are read as they lie."""
    df = spark.read.parquet(path)
    target, files = hadoop(spark, path)
    return df.repartition(spark.sparkContext.defaultParallelism) if files.getContentSummary(target).getLength() <= SMALL else df


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark, f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("report_id"), F.coalesce("text", F.lit("")).alias("content"), F.col("source").alias("author"), "lang", (F.timestamp_seconds(F.lit(1704067200) + F.pmod("doc_id", F.lit(720)) * 3600)).alias("ts"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("stock"), F.col("l_shipdate").cast("timestamp").alias("date"), "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / F.col("l_quantity")).alias("close"), F.col("l_quantity").alias("volume"))


TIES = ("l_orderkey", "l_linenumber")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), F.col("ts").cast("timestamp").alias("ts"), "value", F.col("event_id").alias("id"), F.col("user_id").alias("author"))


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open, high, low, close and volume of each stock and day."""
    b = bars(spark, sf_dir).withColumn("k", F.struct("l_orderkey", "l_linenumber"))
    return b.groupBy("stock", F.to_date("date").alias("date")).agg(F.min_by("close", "k").alias("open"), F.max("close").alias("high"), F.min("close").alias("low"), F.max_by("close", "k").alias("close"), F.sum("volume").alias("volume"))
