"""Summaries of runs, detectors, metrics and feedback, recommendations, histories and caps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.operators.fusion import FAMILIES
from auditloom.operators.monitor import latest, numbered


def families(fused: DataFrame) -> DataFrame:
    """(family, available, mean, anomalous) of fused scores, a row a family."""
    rows = fused.unpivot(["report_id"], list(FAMILIES), "family", "score")
    return rows.groupBy("family").agg(F.count("score").alias("available"), F.avg("score").alias("mean"), F.count_if(F.col("score") > 0.5).alias("anomalous"))


def run_statistics(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Of runs (status, is_anomalous, seconds): totals, rates, throughput and times; rates of nothing are 0."""
    ok = F.col("status") == "success"
    row = runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("successful"), F.count_if(ok & F.col("is_anomalous")).alias("anomalous"),
        *[f(F.when(ok, F.col("seconds"))).alias(n) for n, f in (("mean_time", F.avg), ("least_time", F.min), ("greatest_time", F.max), ("total_time", F.sum))],
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return row.withColumns({"success_rate": share("successful", "total"), "anomaly_rate": share("anomalous", "successful"), "per_second": share("successful", "total_time")})


def half_trend(first: Column, second: Column) -> Column:
    """INCREASING or DECREASING where the halves' means differ by more than a tenth, else STABLE, as without a first half
    or with one whose mean is 0."""
    change = F.try_divide(second - first, first)
    return F.when(change > 0.1, "INCREASING").when(change < -0.1, "DECREASING").otherwise("STABLE")


def resource_report(metrics: DataFrame, newest: int = 60) -> DataFrame:
    """Per metric: newest value, mean of all and of the newest, least, greatest, and the trend of the halves of the newest."""
    ordered = numbered(metrics.select("metric", "ts", "id", "value"), "metric", ["ts", "id"])
    n = ordered.groupBy("metric").agg(F.count(F.lit(1)).alias("n"))
    placed = ordered.join(n, "metric").withColumn("back", F.col("n") - F.col("i"))
    half = F.least(F.col("n"), F.lit(newest)) - F.floor(F.least(F.col("n"), F.lit(newest)) / 2)  # the second half is the larger
    recent = F.col("back") < newest
    row = placed.groupBy("metric").agg(
        F.max_by("value", "i").alias("current"), F.avg("value").alias("mean"), F.avg(F.when(recent, F.col("value"))).alias("newest_mean"), F.min("value").alias("least"), F.max("value").alias("greatest"),
        F.avg(F.when(recent & (F.col("back") >= half), F.col("value"))).alias("first"), F.avg(F.when(F.col("back") < half, F.col("value"))).alias("second"),
    )
    return row.select("metric", "current", "mean", "newest_mean", "least", "greatest", half_trend(F.col("first"), F.col("second")).alias("trend"))


def window_trend(metrics: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """Per metric, of the hours before ``as_of``: n, mean, sample std, least, greatest, newest value, and the trend of the
    last ten values against the first ten, for more than ten."""
    inside = metrics.where((F.unix_micros(F.col("ts").cast("timestamp")) >= F.unix_micros(as_of) - hours * 3_600_000_000) & (F.col("ts") <= as_of))
    row = inside.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("least"), F.max("value").alias("greatest"), F.max_by("value", F.struct("ts", "id")).alias("current"))
    for name, order in (("first", ("ts", "id")), ("last", (F.desc("ts"), F.desc("id")))):
        end = inside.withColumn("rank", F.row_number().over(Window.partitionBy("metric").orderBy(*order))).where("rank <= 10")
        row = row.join(end.groupBy("metric").agg(F.avg("value").alias(name)), "metric")
    moved = F.when((F.col("n") > 10) & (F.col("last") > F.col("first") * 1.1), "INCREASING").when((F.col("n") > 10) & (F.col("last") < F.col("first") * 0.9), "DECREASING").otherwise("STABLE")
    return row.withColumn("trend", moved).drop("first", "last")


def service_statistics(requests: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Of requests (hit, ok, seconds): count, hit rate, success rate, mean time."""
    return requests.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).cast("double")).alias(n) for c, n in (("hit", "hit_rate"), ("ok", "success_rate"), ("seconds", "mean_time"))])


def recommendations(rules: dict[str, Column], nothing: str) -> Column:
    """The names of the rules that hold, joined by commas, or ``nothing``."""
    found = F.concat_ws(",", *[F.when(c, F.lit(name)) for name, c in rules.items()])
    return F.when(found == "", F.lit(nothing)).otherwise(found)


def feedback_summary(feedback: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """One row: all and recent feedback, accuracy, mean rating, the share of experts' feedback that is correct."""
    recent = F.unix_timestamp("ts") >= F.unix_timestamp(as_of) - days * 86400
    return feedback.agg(F.count(F.lit(1)).alias("total"), F.count_if(recent).alias("recent"), F.avg(F.col("is_correct").cast("double")).alias("accuracy"), F.avg("rating").alias("mean_rating"), F.avg(F.when(F.col("source") == "expert", F.col("is_correct").cast("double"))).alias("expert_agreement"))


def daily_feedback(feedback: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """(day, n) of the last days, and what is correct of it."""
    inside = feedback.where(F.unix_timestamp("ts").between(F.unix_timestamp(as_of) - days * 86400, F.unix_timestamp(as_of)))
    return inside.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_correct").alias("n_correct"))


def dashboard(metrics: DataFrame, alerts: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """One row: metrics, the mean of their newest values, alerts, recent and critical ones, and the state."""
    recent = F.unix_timestamp("ts") >= F.unix_timestamp(as_of) - hours * 3600
    row = alerts.agg(F.count(F.lit(1)).alias("n_alerts"), F.count_if(recent).alias("recent_alerts"), F.count_if(recent & (F.col("severity") == "CRITICAL")).alias("recent_critical"))
    now = latest(metrics).agg(F.count(F.lit(1)).alias("n_metrics"), F.avg("value").alias("mean_value"))
    state = F.when(F.col("recent_critical") > 0, "CRITICAL").when(F.col("recent_alerts") > 0, "WARNING").otherwise("HEALTHY")
    return row.select(now.select("n_metrics").scalar().alias("n_metrics"), now.select("mean_value").scalar().alias("mean_value"), "n_alerts", "recent_alerts", "recent_critical", state.alias("state"))


def history(detections: DataFrame, order: Sequence[Column], keep: int = 1000) -> DataFrame:
    """The last ``keep`` detections, marked anomalous above one half: the log that is kept."""
    return detections.orderBy(*order).limit(keep).withColumn("anomalous", F.col("score") > 0.5)


def capped(rows: DataFrame, key: str, item: str, by: str, cap: int) -> DataFrame:
    """(key, items): the ``cap`` items of greatest ``by`` of each key, the lesser item first of equals, joined by commas."""
    best = rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(by), item))).where(F.col("rank") <= cap)
    listed = best.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(item).cast("string").alias("item")))).alias("l"))
    return listed.select(key, F.array_join(F.transform("l", lambda x: x["item"]), ",").alias("items"))


def prediction_rows(predictions: DataFrame) -> DataFrame:
    """Predictions (id, ts, seconds, accuracy, confidence) as metric rows; what is unknown gives none."""
    rows = predictions.select("id", "ts", F.expr("stack(3, 'inference_time', seconds, 'accuracy', accuracy, 'confidence', confidence) as (metric, value)"))
    return rows.where("value is not null")


#: Strategies a trigger, and learning objectives (metric, weight, whether more is better).
STRATEGIES = {"PERFORMANCE_DEGRADATION": ("THRESHOLDS", "ENSEMBLE"), "FEEDBACK_ACCUMULATION": ("THRESHOLDS", "FEATURES"), "SCHEDULED_UPDATE": ("PARAMETERS", "ENSEMBLE"), "DATA_DRIFT_DETECTED": ("FEATURES", "PARAMETERS")}
OBJECTIVES = (("accuracy", 1.0, True), ("f1_score", 0.8, True), ("false_positive_rate", 0.6, False))


def strategies(triggers: DataFrame) -> DataFrame:
    """(trigger, place, strategy) of triggers; one that is not listed asks for new thresholds."""
    table = F.create_map(*[c for t, s in STRATEGIES.items() for c in (F.lit(t), F.array(*map(F.lit, s)))])
    listed = F.coalesce(F.try_element_at(table, F.col("trigger")), F.array(F.lit("THRESHOLDS")))
    return triggers.select("*", F.posexplode(listed).alias("place", "strategy"))


def outcome(before: dict[str, Column], after: dict[str, Column]) -> tuple[Column, Column, Column]:
    """What an adaptation gained: the weighted mean of relative improvements, how sure that is, and whether to apply it."""
    parts, better = [], []
    for name, weight, more in OBJECTIVES:
        gain = (after[name] - before[name]) * (1 if more else -1)
        parts.append(F.lit(weight) * gain / F.greatest(before[name], F.lit(0.001)))
        better.append(gain > 0)
    improvement = sum(parts[1:], parts[0]) / len(parts)
    base = F.greatest(F.lit(0.0), F.least(F.lit(1.0), improvement + 0.5))
    all_better = better[0] & better[1] & better[2]
    sure = F.least(F.lit(1.0), F.when(all_better, base * 1.2).otherwise(base))
    return improvement, sure, sure >= 0.6


def tuned(parameters: DataFrame, trigger: str) -> DataFrame:
    """(name, value) with ``tuned``: a lower confidence threshold and a higher temperature when performance falls, a
    somewhat higher temperature on drift; ensemble weights lean to semantics when performance falls."""
    name, value = F.col("name"), F.col("value")
    falls = trigger == "PERFORMANCE_DEGRADATION"
    made = F.when((name == "confidence_threshold") & F.lit(falls), F.greatest(F.lit(0.1), value - 0.1))
    made = made.when(name == "attention_temperature", F.least(F.lit(2.0), value + (0.2 if falls else 0.1 if trigger == "DATA_DRIFT_DETECTED" else 0.0)))
    made = made.when((name == "weight_semantic") & F.lit(falls), F.least(F.lit(0.4), value + 0.05)).otherwise(value)
    found = parameters.withColumn("made", made).withColumn("is_weight", F.startswith(name, F.lit("weight_")))
    whole = found.where("is_weight").agg(F.sum("made").alias("whole"))
    return found.withColumn("whole", whole.scalar()).select("name", "value", F.when(F.col("is_weight"), F.col("made") / F.col("whole")).otherwise(F.col("made")).alias("tuned"))
