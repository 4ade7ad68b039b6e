"""Monitoring over a metric table (metric, ts, value, id): thresholds, alerts, health, trends, drift, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.scalars import trend_class
from auditloom.operators.quantiles import by_key
from auditloom.sources.shared import stash


def violation(value: Column, warning: Column, critical: Column, upper: bool | Column = True) -> Column:
    """CRITICAL or WARNING beyond a threshold, else null; ``upper``: whether thresholds are upper bounds."""
    beyond = lambda bound: F.when(F.lit(upper) if isinstance(upper, bool) else upper, value >= bound).otherwise(value <= bound)
    return F.when(beyond(critical), "CRITICAL").when(beyond(warning), "WARNING")


def alerts(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Rows of ``metrics`` beyond their metric's threshold (metric, warning, critical), with ``severity``.
    Works on a stream too; the table of thresholds has a row a metric name."""
    joined = metrics.join(thresholds, "metric", "left")
    return joined.withColumn("severity", violation(F.col("value"), F.col("warning"), F.col("critical"))).where(F.col("severity").isNotNull())


def latest(metrics: DataFrame) -> DataFrame:
    """The newest value of each metric, ties by id."""
    found = metrics.groupBy("metric").agg(F.max(F.struct("ts", "id", "value")).alias("m"))
    return found.select("metric", "m.ts", "m.value")


def health(metrics: DataFrame, thresholds: DataFrame, newest: int = 5) -> DataFrame:
    """One row: the state of the newest metrics (CRITICAL, WARNING, CAUTION, HEALTHY)."""
    recent = latest(metrics).orderBy(F.desc("ts"), "metric").limit(newest).join(thresholds, "metric", "left")
    row = recent.withColumn("severity", violation(F.col("value"), F.col("warning"), F.col("critical"))).agg(F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.count_if(F.col("severity") == "WARNING").alias("warnings"))
    return row.withColumn("health", F.when(F.col("critical") > 0, "CRITICAL").when(F.col("warnings") > 2, "WARNING").when(F.col("warnings") > 0, "CAUTION").otherwise("HEALTHY"))


def running(rows: DataFrame, by: str, order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` up to each of them, within ``by`` in the order given. Rows are dealt by ranges of
    that order, so that a key with most of the rows is spread over tasks; each range then counts on from those before it."""
    ranged = stash(rows.withColumn("__v", value).repartitionByRange(by, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(by, "__part").agg(F.sum("__v").alias("__n"))
    before = sums.select(by, "__part", (F.sum("__n").over(Window.partitionBy(by).orderBy("__part")) - F.col("__n")).alias("__before"))
    upto = Window.partitionBy(by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = ranged.withColumn("__i", F.sum("__v").over(upto))
    return inside.join(before, [by, "__part"]).withColumn(name, F.col("__before") + F.col("__i")).drop("__part", "__before", "__i", "__v")


def numbered(rows: DataFrame, by: str, order: list[str], name: str = "i") -> DataFrame:
    """``rows`` with their number (from 1) within ``by`` in the order given, by ranges."""
    return running(rows, by, order, F.lit(1).cast("long"), name)


def trends(metrics: DataFrame) -> DataFrame:
    """Per metric: n, slope over the order of time, mean, std, class, change from the first value."""
    ordered = numbered(metrics.select("metric", "ts", "id", "value"), "metric", ["ts", "id"]).withColumn("i", F.col("i").cast("double"))
    found = ordered.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("value", "i").alias("slope"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min_by("value", "i").alias("first"), F.max_by("value", "i").alias("last"))
    found = found.withColumn("trend", trend_class(F.col("n"), F.col("slope"), F.col("mean"), F.col("std")))
    return found.withColumn("change", F.col("last") - F.col("first")).withColumn("percent_change", F.when(F.col("first") != 0, 100 * (F.col("last") - F.col("first")) / F.abs("first")))


def ends(metrics: DataFrame, k: int = 10, least: int = 20) -> DataFrame:
    """Per metric of at least ``least`` points: the means of the first and of the last k. Each end is a top-k, of which
    every task keeps its own k before any row moves."""
    found = metrics.groupBy("metric").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    for name, order in (("first_mean", ("ts", "id")), ("last_mean", (F.desc("ts"), F.desc("id")))):
        end = metrics.select("metric", "ts", "id", "value").withColumn("rank", F.row_number().over(Window.partitionBy("metric").orderBy(*order))).where(F.col("rank") <= k)
        found = found.join(end.groupBy("metric").agg(F.avg("value").alias(name)), "metric")
    return found


def drift(metrics: DataFrame, share: float = 0.8, as_of: Column | None = None, hours: int = 24) -> DataFrame:
    """``ends``, whether the last lie below ``share`` of the first; of the hours before ``as_of`` alone, where it is given."""
    inside = metrics if as_of is None else metrics.where((F.col("ts") <= as_of) & (F.unix_micros(F.col("ts").cast("timestamp")) >= F.unix_micros(as_of) - hours * 3_600_000_000))
    return ends(inside).withColumn("drifted", F.col("last_mean") < share * F.col("first_mean"))


def period_report(metrics: DataFrame, as_of: Column, days: tuple[int, ...] = (1, 7, 30, 90)) -> DataFrame:
    """(days, metric, n, mean, least, greatest, before, change): every metric over the last days up to ``as_of``, and its
    mean's change against as many days before them. A row counts in the few periods that it falls in; one shuffle."""
    age = (F.unix_micros(as_of) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86_400_000_000
    spans = F.filter(F.array(*map(F.lit, days)), lambda d: age < 2 * d)
    rows = metrics.where(F.col("ts") <= as_of).select("metric", "value", age.alias("age"), F.explode(spans).alias("days"))
    now = F.col("age") < F.col("days")
    row = rows.groupBy("days", "metric").agg(F.count_if(now).alias("n"), *[f(F.when(now, F.col("value"))).alias(n) for n, f in (("mean", F.avg), ("least", F.min), ("greatest", F.max))], F.avg(F.when(~now, F.col("value"))).alias("before"))
    return row.where("n > 0").withColumn("change", F.when(F.col("before") != 0, (F.col("mean") - F.col("before")) / F.abs("before")))


def detail(metrics: DataFrame) -> DataFrame:
    """Per metric: count, mean, std, least, greatest and exact quartiles."""
    found = metrics.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    quartiles = by_key(metrics, "metric", "value", (0.25, 0.5, 0.75)).select("metric", "p")
    return found.join(quartiles, "metric", "left").select("metric", "n", "mean", "std", "min", "max", *[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(("q25", "median", "q75"))])


def autoresolve(alerts_: DataFrame, metrics: DataFrame, as_of: Column, age: int = 300, last: int = 5) -> DataFrame:
    """Alerts (alert_id, metric, ts, warning) with ``resolved``: older than ``age`` seconds and the last five later
    values of their metric all below the warning. Later values are ranked once a metric, so an alert meets only the
    metric's last five rows."""
    order = Window.partitionBy("metric").orderBy(F.desc("ts"), F.desc("id"))
    tail = metrics.withColumn("back", F.row_number().over(order)).where(F.col("back") <= last).select("metric", F.col("ts").alias("m_ts"), "value")
    joined = alerts_.join(tail, "metric", "left")
    later = F.col("m_ts") > F.col("ts")
    found = joined.groupBy("alert_id", "metric", "ts", "warning").agg(F.count_if(later).alias("n_later"), F.count_if(later & (F.col("value") < F.col("warning"))).alias("n_fine"))
    old = F.unix_timestamp(as_of) - F.unix_timestamp("ts") > age
    return found.withColumn("resolved", old & (F.col("n_later") == last) & (F.col("n_fine") == last))


def summary(metrics: DataFrame, baselines: DataFrame) -> DataFrame:
    """Per metric: mean, sum, last less first, and the mean's distance from its baseline (metric, baseline)."""
    found = metrics.groupBy("metric").agg(F.avg("value").alias("mean"), F.sum("value").alias("total"), (F.max_by("value", F.struct("ts", "id")) - F.min_by("value", F.struct("ts", "id"))).alias("change"))
    return found.join(baselines, "metric", "left").withColumn("vs_baseline", F.col("mean") - F.col("baseline"))


def error_rate(metrics: DataFrame) -> DataFrame:
    """Running share of errors (is_error) in order of time, by day: counts a day, then sums over days."""
    daily = metrics.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_error").alias("errors"))
    over = Window.orderBy("day")  # a row a day
    return daily.select("day", "n", "errors", (F.sum("errors").over(over) / F.sum("n").over(over)).alias("running_rate"))


def retained(rows: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Rows of the last days; older ones stay if they are alerts that are not resolved."""
    old = F.unix_timestamp("ts") < F.unix_timestamp(as_of) - days * 86400
    return rows.where(~old | ~F.col("resolved")) if "resolved" in rows.columns else rows.where(~old)


def snapshot(metrics: DataFrame, names: list[str]) -> DataFrame:
    """One row, a column a name: the newest value of each metric; null for one without values."""
    return latest(metrics).groupBy().pivot("metric", names).agg(F.first("value"))


def histogram(metrics: DataFrame, width: float) -> DataFrame:
    """Per metric and bin of a fixed width: count, least and greatest value."""
    return metrics.groupBy("metric", F.floor(F.col("value") / width).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("greatest"))


def resolutions(metrics: DataFrame, thresholds: DataFrame, last: int = 5, age: int = 300) -> DataFrame:
    """(metric, id, ts, resolved_ts) of the alerts that are resolved by the end of ``metrics``: ``age`` seconds after the
    alert if the newest ``last`` values are fine then, else with the first value that makes them so. One sort a metric."""
    judged = metrics.join(thresholds, "metric").select("metric", "id", F.unix_micros("ts").alias("at"), (F.col("value") >= F.col("warning")).alias("bad"))
    order = Window.partitionBy("metric").orderBy("at", "id")
    runs = judged.withColumn("run", F.sum(F.col("bad").cast("int")).over(order))
    fine = runs.withColumn("fine", F.row_number().over(Window.partitionBy("metric", "run").orderBy("at", "id")) - F.when(F.col("run") > 0, 1).otherwise(0))
    until = metrics.agg(F.unix_micros(F.date_trunc("millisecond", F.max("ts"))).alias("until"))
    due = fine.where("bad").select("metric", "id", (F.col("at") + age * 1_000_000).alias("time"), F.col("at").alias("alert"), F.lit(None).cast("int").alias("fine"))
    points = fine.select("metric", "id", F.col("at").alias("time"), F.lit(None).cast("long").alias("alert"), "fine").unionByName(due)
    over = Window.partitionBy("metric").orderBy("time", F.col("alert").isNotNull(), "id")
    back = Window.partitionBy("metric").orderBy(F.desc("time"), F.desc(F.col("alert").isNotNull()), F.desc("id"))
    upto = (Window.unboundedPreceding, Window.currentRow)  # grows row by row; a frame to the end would be summed up anew for each
    now = F.last("fine", ignorenulls=True).over(over.rowsBetween(*upto))
    later = F.min(F.when(F.col("fine") == last, F.col("time"))).over(back.rowsBetween(*upto))
    found = points.withColumns({"now": now, "later": later}).where(F.col("alert").isNotNull())
    resolved = F.when(F.col("now") < last, F.col("later")).when(F.col("time") <= until.scalar(), F.col("time"))
    return found.select("metric", "id", F.timestamp_micros("alert").alias("ts"), F.timestamp_micros(resolved).alias("resolved_ts")).where("resolved_ts is not null")
