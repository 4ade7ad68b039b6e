"""Fusion of the detector families' scores: columns statistical, behavioral, market and semantic, null where a
family is not available."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.config import THRESHOLDS
from auditloom.functions.scalars import clamp, level

FAMILIES = ("statistical", "behavioral", "market", "semantic")


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def available() -> Column:
    return _sum([F.col(f).isNotNull().cast("int") for f in FAMILIES])


def weighted_average(weights: tuple[float, ...] = THRESHOLDS.family_weights) -> Column:
    total = _sum([F.when(F.col(f).isNotNull(), w).otherwise(0.0) for f, w in zip(FAMILIES, weights)])
    return F.when(total > 0, _sum([F.coalesce(F.col(f) * w, F.lit(0.0)) for f, w in zip(FAMILIES, weights)]) / total).otherwise(0.0)


def votes(above: float = 0.5) -> Column:
    return _sum([F.coalesce((F.col(f) > above).cast("int"), F.lit(0)) for f in FAMILIES])


def majority_vote() -> Column:
    return F.when(available() > 0, votes() / available()).otherwise(0.0)


def spread() -> Column:
    """The population standard deviation of the available scores."""
    n = F.greatest(available(), F.lit(1))
    mean = _sum([F.coalesce(F.col(f), F.lit(0.0)) for f in FAMILIES]) / n
    return F.sqrt(_sum([F.coalesce((F.col(f) - mean) * (F.col(f) - mean), F.lit(0.0)) for f in FAMILIES]) / n)


def dynamic_threshold(base: Column, quality: Column, accuracy: Column | None = None) -> Column:
    """``base`` moved by how well the detectors agree, by data quality and, if known, by past accuracy."""
    factors = [1 - F.least(F.col("spread"), F.lit(0.5)), quality, *([accuracy] if accuracy is not None else [])]
    return clamp(base + _sum([0.1 * (f - 0.5) for f in factors]))


def data_quality(content: Column, has_stocks: Column, has_author: Column) -> Column:
    """1 less a fifth for each missing field, less for short texts and for no stocks."""
    n = F.length(F.coalesce(content, F.lit("")))
    missing = (n == 0).cast("int") + (~has_stocks).cast("int") + (~has_author).cast("int")
    return clamp(1 - 0.2 * missing - F.when(n < 100, 0.3).when(n < 500, 0.1).otherwise(0.0) - F.when(~has_stocks, 0.2).otherwise(0.0))


def confidence(score: Column) -> Column:
    """The mean of agreement and of distance from the middle."""
    agreement = 1 - 2 * F.least(F.col("spread"), F.lit(0.5))
    intensity = F.when(score > 0.5, F.least(score * 2, F.lit(1.0))).otherwise(F.greatest(F.lit(0.5), score * 2))
    return clamp((agreement + intensity) / 2)


def interval(score: Column) -> tuple[Column, Column]:
    half = F.when(available() < 2, F.lit(0.0)).otherwise(1.96 * F.col("spread") / F.sqrt(available().cast("double")))
    return clamp(score - half), clamp(score + half)


def risk(score: Column, sure: Column) -> Column:
    return F.when((score >= 0.8) & (sure >= 0.8), "CRITICAL").when((score >= 0.6) & (sure >= 0.7), "HIGH").when((score >= 0.4) & (sure >= 0.6), "MEDIUM").when(score >= 0.2, "LOW").otherwise("MINIMAL")


def alerts(score: Column) -> Column:
    """Names joined by commas. Agreement of scores cannot be told from one report, so nothing is ever validated."""
    return F.concat_ws(",", F.when(score >= 0.8, F.lit("IMMEDIATE")), F.when(votes() >= 3, F.lit("CONSENSUS")))


def key_families(above: float = 0.4) -> Column:
    return F.concat_ws(",", *[F.when(F.col(f) > above, F.lit(f)) for f in FAMILIES])


def fuse(scores: DataFrame, weights: tuple[float, ...] = THRESHOLDS.family_weights) -> DataFrame:
    """``scores`` with score, vote, spread, level, confidence, interval, risk, alerts, key families, explanation."""
    s = F.col("score")
    found = scores.withColumn("spread", spread()).withColumn("score", weighted_average(weights)).withColumn("vote", majority_vote())
    found = found.withColumn("level", level(s)).withColumn("confidence", confidence(s))
    low, high = interval(s)
    found = found.withColumns({"low": low, "high": high, "risk": risk(s, F.col("confidence")), "alerts": alerts(s), "key_families": key_families(), "is_anomalous": s > 0.5})
    return found.withColumn("explanation", F.substring(F.format_string("score %.3f, level %s, families %s", s, F.col("level"), F.col("key_families")), 1, 500))


def fold_weights(history: DataFrame, start: tuple[float, ...] = THRESHOLDS.family_weights) -> DataFrame:
    """Weights per ``group`` after all its detections in order (``at``): each moves by a tenth of how well its family
    agreed with the whole beyond one half, within [0.1, 1.5], and all are scaled to sum 1.  Every step needs the one
    before, so a group's rows go through one task, sorted outside memory; it holds four numbers, whatever their count."""
    kind = history.schema["group"].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, weights = None, None
        made = lambda: pa.RecordBatch.from_pydict({"group": [group], **{f: [w] for f, w in zip(FAMILIES, weights)}})
        for batch in batches:
            groups, scores, *families = [c.to_pylist() for c in batch.columns]
            for g, score, *parts in zip(groups, scores, *families):
                if weights is None or g != group:
                    if weights is not None:
                        yield made()
                    group, weights = g, list(start)
                moved = [min(1.5, max(0.1, w + (0.0 if p is None else 0.1 * (0.5 - abs(p - score))))) for w, p in zip(weights, parts)]
                weights = [m / sum(moved) for m in moved]
        if weights is not None:
            yield made()

    ordered = history.where(F.col("score").isNotNull()).repartition("group").sortWithinPartitions("group", "at").select("group", "score", *FAMILIES)
    return ordered.mapInArrow(fold, f"`group` {kind}, " + ", ".join(f"{f} double" for f in FAMILIES))
