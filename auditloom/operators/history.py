"""The last rows of every key as a table that is brought up to date in place: an update reads and writes only the
partitions whose keys it touches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditloom.sources.shared import exists, forget, new_path, stash_at


def update(spark: SparkSession, path: str, rows: DataFrame, key: str, order: Sequence[str], keep: int, buckets: int = 64) -> list[int]:
    """Adds ``rows`` to the table under ``path``, which holds the ``keep`` last rows of every key in the order given, and
    returns the partitions written.  Rows that are there already (by key and order) are not added again, so an update may
    be repeated.  The new state of the touched partitions is written aside before it takes the place of the old."""
    number = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    # Ranked by key first, rows that cannot be among the last are left out before the shuffle, and those that are there
    # twice, which have one rank, lie in one partition.
    last = lambda df: df.withColumn("__back", F.dense_rank().over(newest)).where(F.col("__back") <= keep).drop("__back").dropDuplicates([key, *order])
    fresh_at, made_at = new_path(spark, "fresh"), new_path(spark, "history")
    fresh = stash_at(last(rows).withColumn("bucket", number), fresh_at)
    touched = sorted(r["bucket"] for r in fresh.select("bucket").distinct().collect())  # no more than there are buckets
    if touched:
        both = fresh
        if exists(spark, path):
            both = fresh.unionByName(spark.read.schema(fresh.schema).parquet(path).where(F.col("bucket").isin(touched)))
        made = stash_at(last(both), made_at)
        made.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        forget(spark, made_at)
    forget(spark, fresh_at)
    return touched


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows kept; none before the first update."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path).drop("bucket")
