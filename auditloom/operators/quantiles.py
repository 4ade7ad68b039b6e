"""Percentiles without bringing values together: of a whole column by histograms that narrow the ranges of the wanted
ranks until few values are left in them, of every key by counting on over ranges, and of any window, to within a stated
error, by sketches that merge."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.sources.shared import stash

#: Bins of a histogram, and so many values of one range may come to the driver.
BINS, FEW = 4096, 20_000


def ranked(values: DataFrame, column: str, ranks: Sequence[int], n: int, lo: float, hi: float, bins: int = BINS, few: int = FEW) -> dict[int, float]:
    """The values at ``ranks`` (from 0) in ascending order; all ``n`` values lie from ``lo`` to ``hi``."""
    c, found = F.col(column), {}
    todo = [(lo, hi, 0, n, sorted(set(ranks)))]
    while todo:
        lo, hi, before, n, wanted = todo.pop()
        if lo == hi:
            found |= dict.fromkeys(wanted, lo)
            continue
        inside = values.where(c.between(lo, hi)).select(c.alias("v"))
        if n <= few:
            held = sorted(r["v"] for r in inside.collect())
            found |= {k: held[k - before] for k in wanted}
            continue
        place = F.least(F.floor((F.col("v") - lo) / ((hi - lo) / bins)), F.lit(bins - 1))
        for r in sorted(inside.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()):
            mine = [k for k in wanted if before <= k < before + r["n"]]
            if mine:
                todo.append((r["lo"], r["hi"], before, r["n"], mine))
            before += r["n"]
    return found


def percentiles(values: DataFrame, column: str, shares: Sequence[float], bins: int = BINS, few: int = FEW) -> list[float | None]:
    """The percentiles at ``shares``, between neighbours by the line; None without values. Nulls don't count."""
    known = values.where(F.col(column).isNotNull())
    n, lo, hi = known.agg(F.count(column), F.min(column), F.max(column)).first()
    if not n:
        return [None] * len(shares)
    at = [s * (n - 1) for s in shares]
    held = ranked(known, column, [k for p in at for k in (math.floor(p), math.ceil(p))], n, lo, hi, bins, few)
    return [float(held[math.floor(p)] * (1 - (p - math.floor(p))) + held[math.ceil(p)] * (p - math.floor(p))) for p in at]


def by_key(values: DataFrame, key: str, column: str, shares: Sequence[float]) -> DataFrame:
    """(key, n, p): exact percentiles at ``shares`` of every key, between neighbours by the line, in an array.  Equal
    values are counted first; the counts are dealt by ranges of key and value, and each range counts on from those
    before it, so that a key with most of the rows is spread over tasks.  Nulls and NaN don't count."""
    known = values.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))
    counted = known.groupBy(F.col(key).alias("k"), F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ranged = stash(counted.repartitionByRange("k", "v").withColumn("part", F.spark_partition_id()), "ranges")
    parts = ranged.groupBy("k", "part").agg(F.sum("c").alias("c"))
    ends = parts.select("k", "part", (F.sum("c").over(Window.partitionBy("k").orderBy("part")) - F.col("c")).alias("before"), F.sum("c").over(Window.partitionBy("k")).alias("n"))
    upto = F.sum("c").over(Window.partitionBy("k", "part").orderBy("v"))
    placed = ranged.withColumn("upto", upto).join(ends.withColumnRenamed("k", "k2").withColumnRenamed("part", "part2"), F.col("k").eqNullSafe(F.col("k2")) & (F.col("part") == F.col("part2")))
    # Ranks from 0: a value holds those from ``first`` to ``last``.
    first, last = F.col("before") + F.col("upto") - F.col("c"), F.col("before") + F.col("upto") - 1
    at = [F.lit(float(s)) * (F.col("n") - 1) for s in shares]
    holds = lambda rank: F.when((first <= rank) & (rank <= last), F.col("v"))
    ends_of = [c for i, p in enumerate(at) for c in (F.max(holds(F.floor(p))).alias(f"lo{i}"), F.max(holds(F.ceil(p))).alias(f"hi{i}"))]
    found = placed.groupBy("k").agg(F.max("n").alias("n"), *ends_of)
    part = [p - F.floor(p) for p in at]
    made = [F.col(f"lo{i}") * (1 - part[i]) + F.col(f"hi{i}") * part[i] for i in range(len(at))]
    return found.select(F.col("k").alias(key), "n", F.array(*made).alias("p"))


#: Size of a sketch: with 99 % probability the rank of what it gives is off by no more than ``rank_error``.
SKETCH = 400


def rank_error(size: int = SKETCH) -> float:
    return 2.296 / size**0.9723


def sketches(rows: DataFrame, by: Sequence[str], ts: str, column: str, unit: str = "hour", size: int = SKETCH) -> DataFrame:
    """(by, unit, sketch): a mergeable sketch of the values of every key and hour (or another unit), of fixed size
    whatever the number of values.  To be kept as a table, to which new hours are added."""
    return rows.where(F.col(column).isNotNull()).groupBy(*by, F.date_trunc(unit, ts).alias(unit)).agg(F.kll_sketch_agg_double(F.col(column).cast("double"), F.lit(size)).alias("sketch"))


def from_sketches(kept: DataFrame, by: Sequence[str | Column], shares: Sequence[float]) -> DataFrame:
    """(by, n, p): percentiles of whatever sketches fall together, without the values."""
    merged = kept.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    names = [c for c in merged.columns if c != "sketch"]
    return merged.select(*names, F.kll_sketch_get_n_double("sketch").alias("n"), F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, shares))).alias("p"))
