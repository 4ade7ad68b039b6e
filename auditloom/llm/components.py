"""Connected components of an edge table, by alternating large-star and small-star steps.

A node with very many links is no burden to one task: least neighbours are taken over (node, salt) first and
go back to the edges by the same pair.  After each round the edges go to the shared folder and those of the
round before are removed from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.stash import forget, new_path, stash_at

#: Rows of one key are dealt to so many tasks.
SALTS = 64


def with_least(rows: DataFrame, key: str, value: str, name: str, other: str) -> DataFrame:
    """``rows`` with the least ``value`` of all rows of the same ``key``, in a column ``name``.  However many rows
    share a key, they meet only in the ``SALTS`` parts that the hash of ``other`` deals them to."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(other), F.lit(SALTS)))
    parts = salted.groupBy(key, "__salt").agg(F.min(value).alias("__part"))
    least = parts.groupBy(key).agg(F.min("__part").alias(name))
    spread = parts.select(key, "__salt").join(least, key)
    return salted.join(spread, [key, "__salt"]).drop("__salt")


def _state(edges: DataFrame) -> tuple:
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v; bigint) to (node, root): the smallest node that each linked node reaches.
    Nodes without a link to another are not returned."""
    spark = edges.sparkSession
    path = new_path(spark, "edges")
    edges = stash_at(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), path)
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, "u", "v", "m", "v").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()
        small = with_least(large, "u", "v", "m", "v").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        old, path = path, new_path(spark, "edges")
        edges = stash_at(small.select("e.*").where("u <> v").distinct(), path)
        before, state = state, _state(edges)
        forget(spark, old)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
