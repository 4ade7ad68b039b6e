"""Evaluation of scored rows: losses over logits, summaries of scores, newest rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def log_softmax(logits: Column) -> Column:
    """Log probabilities of an array of logits, shifted by their greatest first."""
    shifted = F.transform(logits, lambda x: x - F.array_max(logits))
    total = F.log(F.aggregate(shifted, F.lit(0.0), lambda acc, x: acc + F.exp(x)))
    return F.transform(shifted, lambda x: x - total)


def losses(rows: DataFrame, key: str, gamma: float = 2.0, smoothing: float = 0.1) -> DataFrame:
    """(key, cross_entropy, focal, smoothed) of rows (label from 0, logits array<double>); null for a label without a logit."""
    scored = rows.select(key, "label", log_softmax(F.col("logits")).alias("lp"))
    flat = -F.aggregate("lp", F.lit(0.0), lambda acc, x: acc + x) / F.size("lp")
    found = scored.select(key, (-F.get("lp", F.col("label"))).alias("ce"), flat.alias("flat"))
    focal = F.pow(1 - F.exp(-F.col("ce")), F.lit(gamma)) * F.col("ce")
    return found.select(key, F.col("ce").alias("cross_entropy"), focal.alias("focal"), ((1 - smoothing) * F.col("ce") + smoothing * F.col("flat")).alias("smoothed"))


#: Fixed value: what stands for the contrastive part of the anomaly loss where no features are at hand.
CONTRAST = 0.1


def weighted_losses(rows: DataFrame, key: str, weight: Callable[[Column], Column], tasks: tuple[float, float]) -> DataFrame:
    """(key, weighted, anomaly, multi_task): cross-entropy by class weight, that with a tenth of the contrastive part, and
    the plain and the weighted one brought together by the weights of two tasks."""
    ce = -F.get(log_softmax(F.col("logits")), F.col("label"))
    found = rows.select(key, ce.alias("ce"), (ce * weight(F.col("label"))).alias("weighted"))
    return found.select(key, "weighted", (F.col("weighted") + 0.1 * CONTRAST).alias("anomaly"), (tasks[0] * F.col("ce") + tasks[1] * F.col("weighted")).alias("multi_task"))


def contrastive(rows: DataFrame, key: str, margin: float = 1.0, block: int = 512) -> DataFrame:
    """(batch, n, same, other, contrastive) of rows (key, batch, label, vector): the mean over all pairs of a batch of the
    squared distance of unit vectors of one class, and of the square of what distances of different classes lack of
    ``margin``.  The first follows from the sums of the classes; for the second, blocks of a batch meet two at a time, so
    that a batch may be of any size.  A zero vector stays zero."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x * x))
    unit = rows.select(F.col(key).alias("key"), "batch", "label", F.col("vector").cast("array<double>").alias("vector")).withColumn("norm", F.greatest(norm, F.lit(1e-12)))
    unit = unit.select("key", "batch", "label", F.transform("vector", lambda x: x / F.col("norm")).alias("vector"))
    spread = unit.select("batch", "label", F.posexplode("vector").alias("place", "x"))
    sums = spread.groupBy("batch", "label", "place").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")).groupBy("batch", "label").agg(F.sum(F.col("s") * F.col("s")).alias("s"), F.sum("q").alias("q"))
    sizes = unit.groupBy("batch", "label").agg(F.count(F.lit(1)).alias("n"))
    same = sizes.join(sums, ["batch", "label"]).groupBy("batch").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("q") - F.col("s")).alias("same"))

    blocks = unit.groupBy("batch").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("key", "vector"), F.col("blocks")).cast("int")
    dealt = unit.join(blocks, "batch").withColumn("mine", mine).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("batch", F.least("mine", "theirs").alias("low"), F.greatest("mine", "theirs").alias("high"), "mine", "label", "vector")

    def lacking(frame: pd.DataFrame) -> pd.DataFrame:
        low, high = frame["low"].iloc[0], frame["high"].iloc[0]
        a, b = frame[frame["mine"] == low], frame[frame["mine"] == high]
        total = 0.0
        if len(a) and len(b):
            x, y = np.stack(a["vector"].to_numpy()), np.stack(b["vector"].to_numpy())
            squared = np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0)
            lack = np.maximum(margin - np.sqrt(squared), 0) ** 2 * (a["label"].to_numpy()[:, None] != b["label"].to_numpy()[None, :])
            total = float(lack.sum()) / (2 if low == high else 1)
        return pd.DataFrame({"batch": [frame["batch"].iloc[0]], "other": [total]})

    kind = rows.schema["batch"].dataType.simpleString()
    other = dealt.groupBy("batch", "low", "high").applyInPandas(lacking, f"batch {kind}, other double").groupBy("batch").agg(F.sum("other").alias("other"))
    pairs = F.greatest(F.col("n") * (F.col("n") - 1) / 2, F.lit(1))
    return same.join(other, "batch").select("batch", "n", "same", "other", ((F.col("same") + F.col("other")) / pairs).alias("contrastive"))


def anomaly_loss(rows: DataFrame, key: str, weight: Callable[[Column], Column], margin: float = 1.0, share: float = 0.1) -> DataFrame:
    """(batch, n, classification, contrastive, loss) of rows (key, batch, label, logits): the weighted cross-entropy of a
    batch, a mean by weight, and a share of its contrastive part over the logits."""
    ce = -F.get(log_softmax(F.col("logits")), F.col("label"))
    per = rows.select("batch", ce.alias("ce"), weight(F.col("label")).alias("w")).groupBy("batch").agg((F.sum(F.col("ce") * F.col("w")) / F.sum("w")).alias("classification"))
    pairs = contrastive(rows.select(key, "batch", "label", F.col("logits").alias("vector")), key, margin)
    return pairs.join(per, "batch").select("batch", "n", "classification", "contrastive", (F.col("classification") + share * F.col("contrastive")).alias("loss"))


def last_mean(rows: DataFrame, key: str, value: str, order: Sequence[str], window: int) -> DataFrame:
    """(key, n, mean): how many values a key has, and the mean of its last ``window``."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("back", back).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("back") <= window, F.col(value))).alias("mean"))


def summary(scored: DataFrame, score: str = "score", above: float = 0.5) -> DataFrame:
    """One row: count, share above the threshold, mean, population std, least and greatest score."""
    s = F.col(score)
    return scored.agg(F.count(F.lit(1)).alias("n"), F.avg((s > above).cast("double")).alias("anomaly_ratio"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), F.min(s).alias("least"), F.max(s).alias("greatest"))


def newest(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The newest row of each key with the number of its rows; one aggregation, combined before the shuffle."""
    others = [c for c in rows.columns if c not in (key, *order)]
    found = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(*order, *others)).alias("r"))
    return found.select(key, "n", "r.*")
