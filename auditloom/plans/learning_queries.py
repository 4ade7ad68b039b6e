"""Queries over feedback, metrics and predictions as learning material: triggers, weights, losses, snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.operators import evaluation, learning, monitor, similarity
from auditloom.plans.activity_queries import _COSINE, _FB, _M, _NEAR, THRESHOLDS, _feedback, _samples, _thresholds
from auditloom.plans.report_queries import _TOTAL_SQL, rounded, statistical_scores
from auditloom.plans.tables import metrics, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


#: Feedback is given a time in the tables' first two days.
_AT, _AS_OF = 1704067200, "2024-01-02 00:05:00"


@query(_M + f", c as (select metric, avg(value) as value from e group by 1), g as (select coalesce(quality = 1, false) as is_correct, {_AT} + doc_id % 172800 as t from labels) select (select count(*) filter (where value < 0.9 * warning) >= 2 from c join th using (metric)) as degraded, (select coalesce(count(*) >= 20 and avg((not is_correct)::int) > 0.3, false) from g where t >= epoch(timestamp '{_AS_OF}') - 86400) as negative_feedback, true as due")
def learning_triggers(spark, sf_dir):
    current = metrics(spark, sf_dir).groupBy("metric").agg(F.avg("value").alias("value"))
    baselines = _thresholds(spark).select("metric", F.col("warning").alias("baseline"))
    given = _feedback(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.lit(_AT) + F.pmod("report_id", F.lit(172_800))))
    return learning.triggers(current, baselines, given, F.lit(_AS_OF).cast("timestamp"), F.lit("2023-12-01").cast("timestamp"))


@query("with w as (select 'f' || i as feature, 1 + i / 10 as weight from range(5) t(i)), c as (select 'f' || doc_id % 5 as feature, count(*) filter (where (doc_id % 7) / 7 > 0.8) as n from labels group by 1), s as (select feature, weight, weight * power(0.9, coalesce(n, 0)) as scaled from w left join c using (feature)) select feature, weight, round(4 * scaled / sum(scaled) over (), 6) as adapted from s")
def feature_weights(spark, sf_dir):
    weights = spark.createDataFrame([(f"f{i}", 1 + i / 10) for i in range(5)], "feature string, weight double")
    wrong = table(spark, sf_dir, "labels").select(F.concat(F.lit("f"), F.col("doc_id") % 5).alias("feature"), ((F.col("doc_id") % 7) / 7).alias("importance"))
    return rounded(learning.adjust_feature_weights(weights, wrong))


@query("with v as (select feature, value from (select p_size::double as p_size, p_retailprice from part) unpivot (value for feature in (p_size, p_retailprice))), m as (select feature, value / 2 as value from v union all select feature, value from v) select feature, round(avg(value), 6) as importance, round(greatest(0.1, 1 - coalesce(stddev_samp(value), 0) / (abs(avg(value)) + 1e-6)), 6) as confidence from m group by 1")
def importance_aggregate(spark, sf_dir):
    """Two methods' values (Shapley and drop-one) brought together."""
    found = similarity.additive_importance(similarity.long_features(table(spark, sf_dir, "part"), "p_partkey", ["p_size", "p_retailprice"]), "p_partkey")
    both = found.select("feature", F.col("shapley").alias("value")).unionByName(found.select("feature", F.col("drop_effect").alias("value")))
    return rounded(similarity.aggregate_importance(both))


@query(_NEAR.format(_COSINE) + " select target, count(*) as n, round(least(avg(similarity) * least(count(*) / 5, 1.0) * 1.2, 1.0), 6) as confidence from r where rank <= case when same_class then 5 else 3 end group by 1")
def similarity_confidence(spark, sf_dir):
    return rounded(similarity.confidence(similarity.nearest(*_samples(spark, sf_dir))))


@query(_M + ", l as (select metric, arg_max(value, (ts, id)) as value from e group by 1) select " + ", ".join(f"max(value) filter (where metric = '{m}') as {m}" for m, _, _ in THRESHOLDS) + " from l")
def metric_snapshot(spark, sf_dir):
    return monitor.snapshot(metrics(spark, sf_dir), [m for m, _, _ in THRESHOLDS])


@query(_M + " select metric, floor(value / 20)::bigint as bin, count(*) as n, round(min(value), 6) as least, round(max(value), 6) as greatest from e group by 1, 2")
def metric_histogram(spark, sf_dir):
    return rounded(monitor.histogram(metrics(spark, sf_dir), 20.0))


@query(_FB.replace("as rating from labels", "as rating, doc_id % 3 = 0 as incorrect from labels") + " select case when rating not between 1 and 10 then 'rating' when incorrect and is_correct then 'contradiction' else '' end as problem, count(*) as n from f group by 1")
def feedback_validation(spark, sf_dir):
    """Every third piece of feedback is called incorrect, whatever it says."""
    given = _feedback(spark, sf_dir).withColumn("feedback_type", F.when(F.col("report_id") % 3 == 0, "INCORRECT").otherwise(F.col("feedback_type")))
    return learning.validated(given).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("with l as (select vec_id, label, [x::double for x in embedding] as logits from embeddings), s as (select *, [x - list_max(logits) for x in logits] as z from l), p as (select vec_id, label, [x - ln(list_sum([exp(y) for y in z])) for x in z] as lp from s), q as (select vec_id, -lp[label + 1] as ce, -list_sum(lp) / len(lp) as flat from p) select vec_id, round(ce, 6) as cross_entropy, round(power(1 - exp(-ce), 2) * ce, 6) as focal, round(0.9 * ce + 0.1 * flat, 6) as smoothed from q")
def training_losses(spark, sf_dir):
    """Losses of each vector, read as logits of as many classes, against its label."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("logits"))
    return rounded(evaluation.losses(v, "vec_id"))


@query("select o_custkey, count(*) as n, arg_max(o_totalprice, (o_orderdate, o_orderkey)) as o_totalprice, max((o_orderdate, o_orderkey))[2] as o_orderkey from orders group by 1")
def latest_records(spark, sf_dir):
    """The newest order of each customer: the shape of a newest-row-per-stock table."""
    return evaluation.newest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "n", "o_totalprice", "o_orderkey")


@query(_TOTAL_SQL + " select count(*) as n, round(avg((statistical_score > 0.5)::int), 6) as anomaly_ratio, round(avg(statistical_score), 6) as mean, round(stddev_pop(statistical_score), 6) as std, round(min(statistical_score), 6) as least, round(max(statistical_score), 6) as greatest from t")
def evaluation_summary(spark, sf_dir):
    return rounded(evaluation.summary(statistical_scores(spark, sf_dir), "statistical_score"))
