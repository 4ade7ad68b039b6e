"""Nearest samples, attribution and outliers over feature vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce as fold

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _scored(samples: DataFrame, targets: DataFrame, measure: str, reduce: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], dict], schema: str, block: int = 16_384, target_block: int = 4096) -> DataFrame:
    """All samples against all targets (id, vector, label), a block of each at a time: ``reduce`` makes few rows of a
    slice of targets with a block of samples. Every block of one table meets every block of the other in a task, so that
    a task holds two blocks and the likenesses of a slice, however many samples there are."""
    # Every column gets a name of its own, as both tables may come from one.
    known = samples.where("vector is not null").select(F.col("id").alias("sample"), F.col("vector").cast("array<double>").alias("x"), F.col("label").alias("sample_label"))
    wanted = targets.where("vector is not null").select(F.col("id").alias("target"), F.col("vector").cast("array<double>").alias("y"), F.col("label").alias("target_label"))
    n_blocks, n_target_blocks = max(1, -(-known.count() // block)), max(1, -(-wanted.count() // target_block))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = known.withColumn("s1", part("sample", n_blocks)).withColumn("t1", F.explode(F.sequence(F.lit(0), F.lit(n_target_blocks - 1))))
    right = wanted.withColumn("t2", part("target", n_target_blocks)).withColumn("s2", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        x, y = np.stack(a["x"].to_numpy()), np.stack(b["y"].to_numpy())
        found = []
        for lo in range(0, len(b), 128):
            part_ = y[lo : lo + 128]
            if measure == "cosine":
                norms = np.linalg.norm(part_, axis=1)[:, None] * np.linalg.norm(x, axis=1)
                similarity = np.divide(part_ @ x.T, norms, out=np.zeros((len(part_), len(x))), where=norms > 0)
            else:
                similarity = 1 / (1 + np.sqrt(np.stack([((x - v) ** 2).sum(axis=1) for v in part_])))
            found.append(pd.DataFrame(reduce(similarity, a["sample"].to_numpy(), a["sample_label"].to_numpy(), b["target"].to_numpy()[lo : lo + 128], b["target_label"].to_numpy()[lo : lo + 128])))
        return pd.concat(found)

    return left.groupBy("t1", "s1").cogroup(right.groupBy("t2", "s2")).applyInPandas(meet, schema)


def nearest(samples: DataFrame, targets: DataFrame, k: int = 5, contrasting: int = 3, measure: str = "cosine") -> DataFrame:
    """(target, id, same_class, similarity, rank): the samples (id, vector, label) most similar to each target, k of its
    class and ``contrasting`` of others, by ``cosine`` or ``euclidean``; ties go to the lesser id. Each block keeps as
    many, and these are ranked together."""

    def best(similarity, ids, labels, target_ids, target_labels):
        rows = {"target": [], "id": [], "same_class": [], "similarity": []}
        for s, target, label in zip(similarity, target_ids, target_labels):
            for same, n in ((True, k), (False, contrasting)):
                mine = np.flatnonzero(((labels == label) == same) & (ids != target))
                top = mine[np.lexsort((ids[mine], -s[mine]))[:n]]
                rows["target"] += [target] * len(top)
                rows["id"] += ids[top].tolist()
                rows["same_class"] += [same] * len(top)
                rows["similarity"] += s[top].tolist()
        return rows

    found = _scored(samples, targets, measure, best, "target long, id long, same_class boolean, similarity double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("target", "same_class").orderBy(F.desc("similarity"), "id")))
    return ranked.where(F.col("rank") <= F.when(F.col("same_class"), k).otherwise(contrasting))


def statistics(samples: DataFrame, targets: DataFrame, measure: str = "cosine") -> DataFrame:
    """Per target and class (its own or another): n, mean, max, min and sample std of the similarities of all samples,
    from the sums of every block."""

    def sums(similarity, ids, labels, target_ids, target_labels):
        rows = {c: [] for c in ("target", "same_class", "n", "total", "squares", "max", "min")}
        for s, target, label in zip(similarity, target_ids, target_labels):
            for same in (True, False):
                mine = s[((labels == label) == same) & (ids != target)]
                if len(mine):
                    for c, v in zip(rows, (target, same, len(mine), mine.sum(), (mine * mine).sum(), mine.max(), mine.min())):
                        rows[c].append(v)
        return rows

    parts = _scored(samples, targets, measure, sums, "target long, same_class boolean, n long, total double, squares double, max double, min double")
    found = parts.groupBy("target", "same_class").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.max("max").alias("max"), F.min("min").alias("min"))
    spread = F.when(F.col("n") > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col("squares") - F.col("total") * F.col("total") / F.col("n")) / (F.col("n") - 1))))
    return found.select("target", "same_class", "n", (F.col("total") / F.col("n")).alias("mean"), "max", "min", spread.alias("std"))


def confidence(found: DataFrame, scale: float = 1.2) -> DataFrame:
    """(target, n, confidence) of ``nearest`` rows: the mean similarity, less for under five samples. A target without
    any sample, which has no row here, is sure to a tenth."""
    row = found.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.avg("similarity").alias("mean"))
    return row.select("target", "n", F.least(F.col("mean") * F.least(F.col("n") / 5, F.lit(1.0)) * scale, F.lit(1.0)).alias("confidence"))


def long_features(rows: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(key, feature, value)."""
    return rows.unpivot([key], [F.col(n).cast("double").alias(n) for n in names], "feature", "value")


def additive_importance(values: DataFrame, key: str) -> DataFrame:
    """Of the additive model that sums a row's numbers: Shapley value (baseline: half of each), gradient, and the
    effect of dropping a feature. These are exact, so no sampling is needed."""
    total = F.sum(F.abs("value")).over(Window.partitionBy(key))
    found = values.withColumn("shapley", F.col("value") / 2).withColumn("gradient", F.lit(1.0)).withColumn("drop_effect", F.col("value"))
    return found.withColumn("share", F.when(total == 0, F.lit(0.0)).otherwise(F.abs("value") / total))


def sampled_shapley(rows: DataFrame, key: str, names: list[str], model: Callable[[dict[str, Column]], Column], samples: int = 20, seed: int = 42) -> DataFrame:
    """Monte-Carlo Shapley values of any model that is a column expression over its features: for each sample, a
    hashed order of the features; a feature's effect is what the model gains when it turns from its baseline (half of
    its value) to itself with those before it turned already."""
    replicated = rows.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    place = {n: F.xxhash64(F.lit(seed), F.col(key), F.col("sample"), F.lit(n)) for n in names}
    found = []
    for n in names:
        turned = {m: F.when(place[m] < place[n], F.col(m)).otherwise(F.col(m) / 2) for m in names if m != n}
        found.append((model(turned | {n: F.col(n)}) - model(turned | {n: F.col(n) / 2})).alias(n))
    effects = replicated.select(key, *found).groupBy(key).agg(*[F.avg(n).alias(n) for n in names])
    return effects.unpivot([key], names, "feature", "shapley")


def aggregate_importance(found: DataFrame) -> DataFrame:
    """(feature, value) a method: mean and confidence a feature, the most important first."""
    row = found.groupBy("feature").agg(F.avg("value").alias("importance"), F.stddev_samp("value").alias("std"))
    sure = F.greatest(F.lit(0.1), 1 - F.coalesce("std", F.lit(0.0)) / (F.abs("importance") + 1e-6))
    return row.select("feature", "importance", sure.alias("confidence")).orderBy(F.desc("importance"), "feature")


def change_distance(a: Column, b: Column) -> Column:
    """|a - b| over |a| + |b|; 0 where both are 0."""
    total = F.abs(a) + F.abs(b)
    return F.when(total == 0, F.lit(0.0)).otherwise(F.abs(a - b) / total)


def plausibility(changed: Column, n: Column) -> Column:
    return F.greatest(F.lit(0.1), 1 - changed / n)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit numbers of any, by which draws are the same wherever a row is computed."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def climb_step(keys: np.ndarray, step: int, width: int, limit: int) -> np.ndarray:
    """The factors (rows x features) of one trial: of ``limit`` features with the least draws one of 0.8 to 1.2, of the
    others 1. Draws are hashes of the row's key, the step and the feature."""
    at = _mixed(keys[:, None] + np.uint64(step * 2 * width) + np.arange(2 * width, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15))
    u = (_mixed(at) >> np.uint64(11)) / float(1 << 53)
    chosen = np.argsort(u[:, :width], axis=1, kind="stable").argsort(axis=1) < limit
    return np.where(chosen, 0.8 + 0.4 * u[:, width:], 1.0)


def counterfactuals(rows: DataFrame, key: str, names: list[str], target: float, iterations: int = 100, limit: int = 3, seed: int = 42) -> DataFrame:
    """A minimal alteration of each row by seeded hill climbing, under the additive model: up to ``limit`` features are
    scaled by 0.8 to 1.2 and kept if the score comes nearer to ``target``. (key, before, after, n_changed, names...)."""

    def climb(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = frame[names].to_numpy(float)
            best, keys = x.copy(), frame["__h"].to_numpy(np.int64).view(np.uint64)
            for step in range(iterations):
                trial = best * climb_step(keys, step, len(names), min(limit, len(names)))
                nearer = np.abs(trial.sum(1) - target) < np.abs(best.sum(1) - target)
                best[nearer] = trial[nearer]
            yield pd.DataFrame({key: frame[key], "before": x.sum(1), "after": best.sum(1), "n_changed": (best != x).sum(1), **{f"{n}_to": best[:, i] for i, n in enumerate(names)}})

    kind = rows.schema[key].dataType.simpleString()
    ends = ", ".join(f"`{n}_to` double" for n in names)
    return rows.select(key, *names, F.xxhash64(F.lit(seed), F.col(key).cast("string")).alias("__h")).mapInPandas(climb, f"`{key}` {kind}, before double, after double, n_changed long, {ends}")


def mixed_similarity(a: dict[str, Column], b: dict[str, Column], kinds: dict[str, str], weights: dict[str, float] | None = None) -> Column:
    """The weighted mean over features: numbers by relative distance, lists by Jaccard, strings by the share of one's
    characters that the other has, over the greater length."""

    def one(x: Column, y: Column, kind: str) -> Column:
        if kind == "number":
            top = F.greatest(F.abs(x), F.abs(y))
            return F.when(top == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(x - y) / top))
        if kind == "list":
            return F.when(F.size(F.array_union(x, y)) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))
        shared = F.size(F.filter(F.split(x, ""), lambda c: (c != "") & F.contains(y, c)))
        longest = F.greatest(F.length(x), F.length(y))
        return F.when(longest == 0, F.lit(1.0)).otherwise(shared / longest)

    w = weights or {k: 1.0 for k in kinds}
    return fold(lambda p, q: p + q, [one(a[k], b[k], kind) * w[k] for k, kind in kinds.items()]) / sum(w[k] for k in kinds)


def matches(x: Column, y: Column, within: float = 0.1) -> Column:
    """Numbers that differ by no more than a tenth of the greater."""
    return F.abs(x - y) <= within * F.greatest(F.abs(x), F.abs(y))
