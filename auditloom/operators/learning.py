"""Feedback statistics, adaptation of thresholds and weights, and training export. Adaptation is a function from
parameters and feedback to parameters: nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feedback_statistics(feedback: DataFrame) -> DataFrame:
    """Per feedback type: count, correct, accuracy, mean rating over ten."""
    return feedback.groupBy("feedback_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_correct").alias("n_correct"), F.avg(F.col("is_correct").cast("double")).alias("accuracy"), (F.avg("rating") / 10).alias("mean_rating"))


def feedback_id(*parts: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("_", *parts).cast("binary")), 1, 12)


def validated(feedback: DataFrame) -> DataFrame:
    """``feedback`` with ``problem``: what keeps a row from being used (id, rating, contradiction), or an empty string."""
    rating = F.col("rating").isNotNull() & ~F.col("rating").between(1, 10)
    contradiction = (F.col("feedback_type") == "INCORRECT") & F.coalesce("is_correct", F.lit(False))
    return feedback.withColumn("problem", F.when(F.col("report_id").isNull(), "id").when(rating, "rating").when(contradiction, "contradiction").otherwise(""))


def detection_metrics(detections: DataFrame, feedback: DataFrame) -> DataFrame:
    """One row: detections with feedback, true positives (any true feedback), accuracy, false positive rate."""
    judged = feedback.groupBy("detection_id").agg(F.bool_or("is_true_positive").alias("hit"))
    joined = detections.join(judged, "detection_id", "left")
    positive = F.col("score") > 0.5
    row = joined.agg(F.count("hit").alias("n_feedback"), F.count_if(F.col("hit")).alias("true_positives"), F.count_if(~F.col("hit") & positive).alias("false_positives"), F.count_if(positive).alias("positives"))
    return row.withColumn("accuracy", F.when(F.col("n_feedback") > 0, F.col("true_positives") / F.col("n_feedback")).otherwise(0.0)).withColumn("false_positive_rate", F.col("false_positives") / F.greatest("positives", F.lit(1)))


def adapt_thresholds(thresholds: DataFrame, feedback: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """(name, threshold) with ``adapted``, by the feedback of the last days: a twentieth more, up to 0.9, where over
    30 % of it says false positive; else a twentieth less, down to 0.1, where over 20 % says missed."""
    row = recent(feedback, as_of, days).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("feedback_type") == "FALSE_POSITIVE").alias("fp"), F.count_if(F.col("feedback_type") == "MISSED").alias("missed"))
    shares = row.select(F.struct((F.col("fp") / F.greatest("n", F.lit(1))).alias("fp"), (F.col("missed") / F.greatest("n", F.lit(1))).alias("missed")))
    s = thresholds.withColumn("s", shares.scalar())
    raised, lowered = F.least(F.lit(0.9), F.col("threshold") + 0.05), F.greatest(F.lit(0.1), F.col("threshold") - 0.05)
    return s.select("name", "threshold", F.when(F.col("s.fp") > 0.3, raised).when(F.col("s.missed") > 0.2, lowered).otherwise(F.col("threshold")).alias("adapted"))


def triggers(current: DataFrame, baselines: DataFrame, feedback: DataFrame, as_of: Column, last_update: Column) -> DataFrame:
    """One row of three flags: two metrics or more below nine tenths of their baseline; twenty feedbacks within a day,
    over 30 % of them negative; a week since the last update."""
    low = current.join(baselines, "metric").agg((F.count_if(F.col("value") < 0.9 * F.col("baseline")) >= 2).alias("degraded"))
    day = feedback.where(F.unix_timestamp("ts") >= F.unix_timestamp(as_of) - 86400)
    row = day.agg(((F.count(F.lit(1)) >= 20) & (F.avg((~F.col("is_correct")).cast("double")) > 0.3)).alias("negative_feedback"))
    due = (F.unix_timestamp(as_of) - F.unix_timestamp(last_update) >= 7 * 86400).alias("due")
    return row.select(low.scalar().alias("degraded"), F.coalesce("negative_feedback", F.lit(False)).alias("negative_feedback"), due)


def recent(feedback: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    return feedback.where((F.unix_timestamp("ts") >= F.unix_timestamp(as_of) - days * 86400) & (F.unix_timestamp("ts") <= F.unix_timestamp(as_of)))


def adjust_feature_weights(weights: DataFrame, wrong: DataFrame, keep: float = 0.9, above: float = 0.8, total: float = 4.0) -> DataFrame:
    """(feature, weight): scaled by 0.9 for each wrong case (feature, importance) in which it counted much, then all to
    a sum of ``total``."""
    counted = wrong.groupBy("feature").agg(F.count_if(F.col("importance") > above).alias("n"))
    joined = weights.join(counted, "feature", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    least = joined.where("weight > 0").agg(F.coalesce(F.min("n"), F.lit(0)).alias("least"))
    # Only differences count once the sum is fixed, and powers of whole numbers of cases would all come down to zero.
    scaled = joined.withColumn("least", least.scalar()).withColumn("scaled", F.col("weight") * F.pow(F.lit(keep), F.col("n") - F.col("least")))
    whole = scaled.agg(F.sum("scaled").alias("whole"))
    shared = F.when(F.col("whole") > 0, total * F.col("scaled") / F.col("whole")).otherwise(F.col("scaled"))
    return scaled.withColumn("whole", whole.scalar()).select("feature", "weight", shared.alias("adapted"))


def training_export(feedback: DataFrame, least_rating: int = 5) -> DataFrame:
    """Feedback without a rating or with a good one; the label is the corrected one, else whether it was correct."""
    kept = feedback.where(F.col("rating").isNull() | (F.col("rating") >= least_rating))
    return kept.select("report_id", F.coalesce(F.col("corrected_label").cast("string"), F.col("is_correct").cast("string")).alias("label"), "rating")


def upsert(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of both, the newest of each key."""
    both = existing.unionByName(new)
    return both.groupBy(key).agg(F.max_by(F.struct(*both.columns), order).alias("r")).select("r.*")


def batch_summary(scored: DataFrame) -> DataFrame:
    """One row of a batch with scores and levels: analysed, anomalous, rate, mean, risk."""
    row = scored.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") > 0.5).alias("anomalous"), F.avg("score").alias("mean_score"))
    row = row.withColumn("rate", F.col("anomalous") / F.greatest("n", F.lit(1)))
    return row.withColumn("risk", F.when(F.col("rate") > 0.3, "HIGH").when(F.col("anomalous") > 0, "MEDIUM").otherwise("LOW"))


def level_histogram(scored: DataFrame, spark) -> DataFrame:
    """All five levels with their counts, zeros included."""
    levels = spark.createDataFrame([(n,) for n in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "NORMAL")], "level string")
    counted = scored.groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    return levels.join(counted, "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n"))
