"""Isolation forests that are kept: grown on a bounded sample, written as a table of nodes, read back, and walked in
column expressions, so that scoring stays in the JVM and takes no shuffle."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.operators.quantiles import percentiles
from auditloom.sources.shared import new_path, stash

_NODES = "tree int, node int, feature int, cut double, `left` int, `right` int, length double"
_SCALE = "place int, name string, mean double, std double"


class Forest(NamedTuple):
    """``nodes``: a row a node (a leaf has feature -1 and the length of the path to it); ``scale``: mean and population
    std a feature; ``average``: the path length that scores one half.  All of a size that the fit bounds."""

    nodes: DataFrame
    scale: DataFrame
    average: float


def average_path(n: int) -> float:
    """The mean length of an unsuccessful search among ``n`` rows."""
    return 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def _scaled(rows: DataFrame, names: list[str], scale: list) -> DataFrame:
    standard = [F.when(F.lit(s["std"]) > 0, (F.col(s["name"]) - s["mean"]) / (s["std"] or 1.0)).otherwise(F.lit(0.0)).alias(n) for n, s in zip(names, scale, strict=True)]
    return rows.select(*standard)


def grow(rows: DataFrame, key: str, names: list[str], trees: int = 100, sample: int = 256, seed: int = 42) -> Forest:
    """A forest on standardised columns. Every tree sees ``sample`` rows of a bounded draw by hash of the key."""
    spark = rows.sparkSession
    stats = rows.agg(F.count(F.lit(1)).alias("rows"), *[f(n).alias(f"{s}{i}") for i, n in enumerate(names) for s, f in (("mean", F.avg), ("std", F.stddev_pop))]).first()
    scale = [{"place": i, "name": n, "mean": float(stats[f"mean{i}"] or 0.0), "std": float(stats[f"std{i}"] or 0.0)} for i, n in enumerate(names)]
    # Only about as many rows as are wanted are put in order.
    most, span = trees * sample, 1 << 30
    share = min(span, -(-2 * most * span // max(stats["rows"], 1)))
    hashed = rows.withColumn("__h", F.xxhash64(F.lit(seed), F.col(key))).where(F.pmod("__h", F.lit(span)) < share)
    drawn = _scaled(hashed.orderBy(F.pmod("__h", F.lit(span)), "__h", key).limit(most), names, scale)
    x = np.array([[float("nan") if v is None else v for v in r] for r in drawn.collect()], float).reshape(-1, len(names))
    x = x[np.isfinite(x).all(axis=1)]
    rng, size = np.random.default_rng(seed), min(sample, len(x))
    limit = int(np.ceil(np.log2(max(size, 2))))
    nodes: list[tuple] = []

    def add(tree: int, part: np.ndarray, depth: int) -> int:
        at = len(nodes) - start
        nodes.append((tree, at, -1, 0.0, -1, -1, depth + average_path(len(part))))
        if depth == limit or len(part) <= 1:
            return at
        j = int(rng.integers(part.shape[1]))
        lo, hi = part[:, j].min(), part[:, j].max()
        if lo < hi:
            border = float(rng.uniform(lo, hi))
            below = part[:, j] < border
            left, right = add(tree, part[below], depth + 1), add(tree, part[~below], depth + 1)
            nodes[start + at] = (tree, at, j, border, left, right, 0.0)
        return at

    for tree in range(trees if len(x) else 0):
        start = len(nodes)
        add(tree, x[rng.choice(len(x), size, replace=False)], 0)
    return Forest(spark.createDataFrame(nodes, _NODES), spark.createDataFrame([tuple(s.values()) for s in scale], _SCALE), max(average_path(size), 1e-9))


def save(forest: Forest, path: str) -> None:
    """Three tables under ``path``."""
    spark = forest.nodes.sparkSession
    forest.nodes.coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    forest.scale.coalesce(1).write.mode("overwrite").parquet(f"{path}/scale")
    spark.createDataFrame([(forest.average,)], "average double").write.mode("overwrite").parquet(f"{path}/size")


def load(spark: SparkSession, path: str) -> Forest:
    return Forest(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/scale"), spark.read.parquet(f"{path}/size").first()["average"])


def _walked(tree: Column, x: Column, depth: int) -> Column:
    """The path length of ``x`` (an array of features) in a tree, whose nodes are arrays side by side."""

    def step(node: Column, _: Column) -> Column:
        feature = F.get(tree["feature"], node)
        return F.when(feature < 0, node).when(F.get(x, feature) < F.get(tree["cut"], node), F.get(tree["left"], node)).otherwise(F.get(tree["right"], node))

    return F.get(tree["length"], F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step))


def score(rows: DataFrame, forest: Forest, depth: int = 8) -> DataFrame:
    """``rows`` with ``score``: one half is usual, more is easier to isolate; null where a feature is null. ``depth`` is
    the greatest depth of a tree: the logarithm of the sample's size. The forest is one row of bounded size."""
    names = ["feature", "cut", "left", "right", "length"]
    side = F.sort_array(F.collect_list(F.struct("node", *names)))
    tree = forest.nodes.groupBy("tree").agg(side.alias("n")).select("tree", F.struct(*[F.col(f"n.{c}").alias(c) for c in names]).alias("nodes"))
    one = tree.agg(F.transform(F.sort_array(F.collect_list(F.struct("tree", "nodes"))), lambda t: t["nodes"]).alias("__trees"))
    scale = [r.asDict() for r in forest.scale.orderBy("place").collect()]  # a row a feature
    x = F.array(*[F.when(F.lit(s["std"]) > 0, (F.col(s["name"]).cast("double") - s["mean"]) / (s["std"] or 1.0)).otherwise(F.when(F.col(s["name"]).isNotNull(), 0.0)) for s in scale])
    joined = rows.withColumn("__x", x).crossJoin(F.broadcast(one))  # one row
    total = F.aggregate("__trees", F.lit(0.0), lambda acc, t: acc + _walked(t, F.col("__x"), depth))
    mean = total / F.greatest(F.size("__trees"), F.lit(1))
    known = ~F.exists("__x", lambda v: v.isNull())
    return joined.withColumn("score", F.when(known, F.pow(F.lit(2.0), -mean / forest.average))).drop("__x", "__trees")


def outliers(rows: DataFrame, key: str, names: list[str], trees: int = 100, sample: int = 256, contamination: float = 0.2, seed: int = 42, path: str | None = None) -> DataFrame:
    """(key, score, is_outlier): a forest is grown, kept under ``path`` and read back; outliers lie above the exact
    percentile of all scores."""
    spark = rows.sparkSession
    path = path or new_path(spark, "forest")
    save(grow(rows, key, names, trees, sample, seed), path)
    depth = int(np.ceil(np.log2(max(sample, 2))))
    # A narrow row costs hundreds of steps, so few bytes are much work: rows are dealt to all cores.
    cores = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    scored = stash(score(rows.select(key, *names).repartition(cores), load(spark, path), depth).select(key, "score"), "scores")
    border = percentiles(scored, "score", (1 - contamination,))[0]
    return scored.withColumn("is_outlier", F.lit(False) if border is None else F.col("score") > border)
