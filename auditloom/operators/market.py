"""Market detectors over price bars (stock, date, close, volume, and tie-break columns) and predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.config import THRESHOLDS
from auditloom.functions.scalars import clamp, ratio_score, weighted

YEAR = 252


def _order(ties: Sequence[str]) -> Window:
    return Window.partitionBy("stock").orderBy("date", *ties)


def with_returns(bars: DataFrame, ties: Sequence[str] = (), window: int = 20) -> DataFrame:
    """``bars`` with ``ret`` (0 for a stock's first bar) and, from the ``window``-th bar on, yearly ``volatility``."""
    order = _order(ties)
    before = F.lag("close").over(order)
    found = bars.withColumn("ret", F.when(before.isNull() | (before == 0), F.lit(0.0)).otherwise((F.col("close") - before) / before))
    rolling = order.rowsBetween(1 - window, 0)
    return found.withColumn("volatility", F.when(F.count(F.lit(1)).over(rolling) == window, F.stddev_pop("ret").over(rolling) * F.sqrt(F.lit(float(YEAR)))))


def last_bars(bars: DataFrame, n: int, ties: Sequence[str] = ()) -> DataFrame:
    """Each stock's last n bars, with ``back``: 1 for the last."""
    order = Window.partitionBy("stock").orderBy(F.desc("date"), *[F.desc(t) for t in ties])
    return bars.withColumn("back", F.row_number().over(order)).where(F.col("back") <= n)


def baseline(returns: DataFrame, least: int = 30) -> DataFrame:
    """Per stock of at least ``least`` bars: mean, std and percentiles of return and volume."""
    shares = F.array(*map(F.lit, (0.05, 0.95)))
    made = [f(c).alias(f"{c}_{n}") for c in ("ret", "volume") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("p", lambda c: F.percentile(c, shares)))]
    found = returns.groupBy("stock").agg(F.count(F.lit(1)).alias("n"), *made).where(F.col("n") >= least)
    return found.select("stock", "n", *[F.col(f"{c}_{s}") if s in ("mean", "std") else F.get(F.col(f"{c}_p"), F.lit(s == "p95").cast("int")).alias(f"{c}_{s}") for c in ("ret", "volume") for s in ("mean", "std", "p5", "p95")])


def return_anomaly(returns: DataFrame, base: DataFrame, ties: Sequence[str] = ()) -> DataFrame:
    """(stock, recent, score): the mean of the last 30 returns against the baseline."""
    recent = last_bars(returns, 30, ties).groupBy("stock").agg(F.avg("ret").alias("recent"))
    dev = F.abs(F.col("recent") - F.col("ret_mean"))
    hit = (dev > 3 * F.col("ret_std")) | (F.abs("recent") > 0.05)
    score = F.when(hit, F.least(F.greatest(dev / F.greatest(3 * F.col("ret_std"), F.lit(1e-6)), F.abs("recent") / 0.05), F.lit(1.0))).otherwise(0.0)
    return recent.join(base, "stock").select("stock", "recent", score.alias("score"))


def volume_anomaly(returns: DataFrame, base: DataFrame, ties: Sequence[str] = ()) -> DataFrame:
    """(stock, ratio, score): the mean of the last 10 volumes over the baseline's."""
    recent = last_bars(returns, 10, ties).groupBy("stock").agg(F.avg("volume").alias("recent"))
    return recent.join(base, "stock").select("stock", (F.col("recent") / F.greatest(F.col("volume_mean"), F.lit(1e-6))).alias("ratio")).withColumn("score", ratio_score(F.col("ratio"), 3.0))


def price_trend(bars: DataFrame, ties: Sequence[str] = (), n: int = 14) -> DataFrame:
    """(stock, trend): the slope of the last n closes over their mean; null for fewer bars."""
    last = last_bars(bars, n, ties)
    found = last.groupBy("stock").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("close", -F.col("back").cast("double")).alias("slope"), F.avg("close").alias("mean"))
    return found.select("stock", F.when(F.col("n") == n, F.col("slope") / F.when(F.col("mean") != 0, F.col("mean"))).alias("trend"))


def trend_deviation(trend: Column, direction: Column) -> Column:
    """What of the trend runs against the predicted direction (up, down, neutral)."""
    return F.when(direction == "up", F.greatest(-trend, F.lit(0.0))).when(direction == "down", F.greatest(trend, F.lit(0.0))).otherwise(F.abs(trend))


def trend_anomaly(trends: DataFrame, reports: DataFrame) -> DataFrame:
    """Reports (report_id, stock, direction) against their stocks' trends: the greatest deviation's score."""
    dev = trend_deviation(F.col("trend"), F.col("direction"))
    found = reports.join(trends, "stock").groupBy("report_id").agg(F.max(dev).alias("deviation"))
    return found.select("report_id", "deviation", F.when(F.col("deviation") > 0.2, F.least(F.col("deviation") / 0.2, F.lit(1.0))).otherwise(0.0).alias("score"))


def with_accuracy(predictions: DataFrame) -> DataFrame:
    """``error`` and ``accuracy`` of (predicted, actual)."""
    error = F.abs(F.col("predicted") - F.col("actual")) / F.greatest(F.abs("actual"), F.lit(1e-6))
    return predictions.withColumn("error", error).withColumn("accuracy", F.greatest(F.lit(0.0), 1 - F.col("error")))


def accuracy_stats(scored: DataFrame, order: Sequence[str], last: int = 100, recent: int = 10) -> DataFrame:
    """One row of the last 100 accuracies: n, mean, std, slope over their order, mean of the last 10, drop and score.
    Only the last rows reach the ranking: the limit is a top-k."""
    latest = scored.orderBy(*[F.desc(c) for c in order]).limit(last)
    ranked = latest.withColumn("back", F.row_number().over(Window.orderBy(*[F.desc(c) for c in order])))
    row = ranked.agg(F.count(F.lit(1)).alias("n"), F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("std"), F.regr_slope("accuracy", -F.col("back").cast("double")).alias("trend"), F.avg(F.when(F.col("back") <= recent, F.col("accuracy"))).alias("recent"))
    return row.withColumn("drop", F.col("mean") - F.col("recent")).withColumn("score", clamp(F.col("drop"))).withColumn("is_anomaly", F.col("drop") > 0.3)


def validate_bars(bars: DataFrame) -> DataFrame:
    """``bars`` (open, high, low, close) with ``problems``: names of what is wrong, joined by commas."""
    c = F.col
    checks = {
        "missing": c("open").isNull() | c("high").isNull() | c("low").isNull() | c("close").isNull(), "high_low": c("high") < F.greatest("open", "close"),
        "low_high": c("low") > F.least("open", "close"), "not_positive": F.least("open", "high", "low", "close") <= 0,
    }
    return bars.withColumn("problems", F.concat_ws(",", *[F.when(v, F.lit(k)) for k, v in checks.items()]))


def series_problems(bars: DataFrame) -> DataFrame:
    """Per stock: bars, distinct dates, duplicates."""
    return bars.groupBy("stock").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("date").alias("n_dates")).withColumn("has_duplicates", F.col("n") > F.col("n_dates"))


def order_problems(bars: DataFrame, arrival: Sequence[str]) -> DataFrame:
    """Per stock, of its bars as they came in: n, dates before the one that came before, and equal ones."""
    before = F.lag("date").over(Window.partitionBy("stock").orderBy(*arrival))
    marked = bars.withColumn("before", before)
    return marked.groupBy("stock").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("date") < F.col("before")).alias("n_unsorted"), F.count_if(F.col("date") == F.col("before")).alias("n_equal"))


def coverage_days(bars: DataFrame) -> DataFrame:
    return bars.groupBy("stock").agg(F.datediff(F.max("date"), F.min("date")).alias("days"))


def total(scored: DataFrame) -> DataFrame:
    return scored.withColumn("market_score", weighted([F.coalesce(F.col(c), F.lit(0.0)) for c in ("returns", "volumes", "accuracy_drop", "trend")], THRESHOLDS.market_weights))
