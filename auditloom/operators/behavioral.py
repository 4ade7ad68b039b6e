"""Behavioural detectors over author activity: (author, ts), stocks per report, and market events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.config import LEXICONS, THRESHOLDS
from auditloom.functions import text as X
from auditloom.functions.scalars import attach, days_between, ratio_score, weighted

DAY = 86400


def daily_counts(activity: DataFrame) -> DataFrame:
    """(author, day, n)."""
    return activity.groupBy("author", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def frequency_baseline(daily: DataFrame) -> DataFrame:
    """Per author, of the days with activity: days, mean, std and percentiles of the daily count."""
    shares = (0.25, 0.5, 0.75, 0.9, 0.95)
    found = daily.groupBy("author").agg(F.count(F.lit(1)).alias("days"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"), F.percentile("n", F.array(*map(F.lit, shares))).alias("p"))
    return found.select("author", "days", "mean", "std", *[F.get("p", F.lit(i)).alias(f"p{int(100 * s)}") for i, s in enumerate(shares)])


def trailing_counts(activity: DataFrame, days: int = THRESHOLDS.frequency_days) -> DataFrame:
    """``activity`` with ``trailing``: the author's rows of the last ``days`` days, both ends included."""
    over = Window.partitionBy("author").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-days * DAY * 1_000_000, 0)
    return activity.withColumn("trailing", F.count(F.lit(1)).over(over))


def frequency_anomaly(activity: DataFrame, baseline: DataFrame) -> DataFrame:
    """The rate over the trailing calendar days against the mean of active days."""
    found = trailing_counts(activity).join(baseline.select("author", "mean"), "author")
    r = F.col("trailing") / THRESHOLDS.frequency_days / F.greatest(F.col("mean"), F.lit(1e-6))
    return found.withColumn("ratio", r).withColumn("score", ratio_score(F.col("ratio"), THRESHOLDS.frequency_ratio)).withColumn("is_anomaly", F.col("score") > 0)


def timing_anomaly(reports: DataFrame, events: DataFrame, hours: int = THRESHOLDS.timing_hours) -> DataFrame:
    """Reports (report_id, ts, stock) near events (event_id, ts, stock) of a shared stock: (report_id, n_events, score).
    An event meets only the reports of its own and the neighbouring time buckets, so each join key is a stock and a bucket."""
    span = hours * 3600
    left = reports.select("report_id", "stock", F.unix_timestamp("ts").alias("t"))
    left = left.withColumn("n_stocks", F.count(F.lit(1)).over(Window.partitionBy("report_id"))).withColumn("bucket", F.floor(F.col("t") / span))
    right = events.select("event_id", "stock", F.unix_timestamp("ts").alias("u")).withColumn("bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("u") / span) + d)))
    pairs = left.join(right, ["stock", "bucket"]).where(F.abs(F.col("t") - F.col("u")) <= span)
    per = pairs.groupBy("report_id", "event_id").agg(F.count(F.lit(1)).alias("overlap"), F.min("n_stocks").alias("n_stocks"), F.min(F.abs(F.col("t") - F.col("u"))).alias("apart"))
    score = ((1 - F.col("apart") / span) + F.col("overlap") / F.greatest(F.col("n_stocks"), F.lit(1))) / 2
    best = per.groupBy("report_id").agg(F.count(F.lit(1)).alias("n_events"), F.max(score).alias("score"))
    every = reports.select("report_id").distinct().join(best, "report_id", "left")
    filled = every.select("report_id", F.coalesce("n_events", F.lit(0)).alias("n_events"), F.coalesce("score", F.lit(0.0)).alias("score"))
    return filled.withColumn("is_anomaly", F.col("score") > THRESHOLDS.timing)


def focus_shift(reports: DataFrame, focus: DataFrame) -> DataFrame:
    """Reports (report_id, stock): the share of stocks that ``focus`` (stock) lacks."""
    marked = reports.distinct().join(focus.select("stock").distinct().withColumn("known", F.lit(True)), "stock", "left")
    found = marked.groupBy("report_id").agg(F.count(F.lit(1)).alias("n_stocks"), F.count_if(F.col("known").isNull()).alias("n_new")).withColumn("ratio", F.col("n_new") / F.col("n_stocks"))
    return found.withColumn("score", F.least(F.col("ratio") / THRESHOLDS.focus, F.lit(1.0))).withColumn("is_anomaly", F.col("ratio") > THRESHOLDS.focus)


def top_focus(reports: DataFrame, k: int = 20) -> DataFrame:
    """The k stocks of most reports, ties by the stock."""
    return reports.groupBy("stock").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "stock").limit(k)


def writing_features(reports: DataFrame, end: str = LEXICONS.sentence_end) -> DataFrame:
    """(report_id, n_sentences, mean_sentence, n_paragraphs)."""
    sentences = X.pieces(F.col("content"), end)
    return reports.select("report_id", F.size(sentences).alias("n_sentences"), X.mean_length(sentences).alias("mean_sentence"), F.size(X.pieces(F.col("content"), r"\n")).alias("n_paragraphs"))


def writing_anomaly(features: DataFrame, baseline: DataFrame) -> DataFrame:
    """``baseline``: one row of mean and std of both features; a std of 0 passes."""
    z = lambda c: F.when(F.col(f"{c}_std") > 0, F.abs(F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std"))
    part = lambda c: F.when(z(c) > THRESHOLDS.writing_z, F.least(z(c) / THRESHOLDS.writing_z - 1, F.lit(1.0))).otherwise(0.0)
    found = attach(features, baseline).withColumn("score", F.greatest(part("mean_sentence"), part("n_paragraphs")))
    return found.select("report_id", "mean_sentence", "n_paragraphs", "score", (F.col("score") > 0).alias("is_anomaly"))


def writing_baseline(features: DataFrame) -> DataFrame:
    return features.agg(*[f(c).alias(f"{c}_{n}") for c in ("mean_sentence", "n_paragraphs") for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def author_intervals(activity: DataFrame, days: int = 90) -> DataFrame:
    """Per author: rows, and mean, std and least of the whole days between neighbours, as of each author's last row."""
    ordered = Window.partitionBy("author").orderBy("ts", "id")
    last = F.max("ts").over(Window.partitionBy("author"))
    recent = activity.withColumn("last", last).where(F.unix_timestamp("ts") >= F.unix_timestamp("last") - days * DAY)
    gaps = recent.withColumn("gap", days_between(F.col("ts"), F.lag("ts").over(ordered)))
    return gaps.groupBy("author").agg(F.count(F.lit(1)).alias("n"), F.avg("gap").alias("gap_mean"), F.stddev_pop("gap").alias("gap_std"), F.min("gap").alias("gap_min")).withColumn("frequent", F.coalesce(F.col("gap_mean") < 7, F.lit(False)))


def activity_profile(activity: DataFrame) -> DataFrame:
    """Per author of (author, ts, stock, industry): rows, days, stocks, industries, and stocks a row."""
    found = activity.groupBy("author").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.to_date("ts")).alias("days"), F.countDistinct("stock").alias("n_stocks"), F.countDistinct("industry").alias("n_industries"))
    return found.withColumn("diversity", F.col("n_stocks") / F.col("n"))


def with_event(events: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """``events`` and one more, whose id is the number of those before; columns without a value are null."""
    new = events.agg(F.count(F.lit(1)).alias(key))
    return events.unionByName(new.select(key, *[v.alias(k) for k, v in values.items()]), allowMissingColumns=True)


def total(scored: DataFrame) -> DataFrame:
    """``behavioral_score`` of timing, frequency, focus and writing columns."""
    return scored.withColumn("behavioral_score", weighted([F.coalesce(F.col(c), F.lit(0.0)) for c in ("timing", "frequency", "focus", "writing")], THRESHOLDS.behavioral_weights))
