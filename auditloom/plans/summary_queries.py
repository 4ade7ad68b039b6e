"""Queries of summaries: runs, detectors, resources, feedback, dashboards, histories, adaptation outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.operators import learning, monitor, statistical, summaries
from auditloom.plans.activity_queries import _FB, _FUSE, _M, _feedback, _thresholds, fused
from auditloom.plans.report_queries import _TOTAL_SQL, DOCS, rounded, statistical_scores
from auditloom.plans.tables import metrics, reports, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(_FUSE + ", fu as (select 'statistical' as family, st as score from z union all select 'semantic', se from z union all select 'behavioral', null from z union all select 'market', null from z) select family, count(score) as available, round(avg(score), 6) as mean, count(*) filter (where score > 0.5) as anomalous from fu group by 1")
def detector_summary(spark, sf_dir):
    return rounded(summaries.families(fused(spark, sf_dir)))


_RUNS = "with r as (select o_orderpriority as priority, case when o_orderkey % 9 = 0 then 'failed' else 'success' end as status, o_orderstatus = 'F' as hit, o_totalprice / 1e5 as seconds from orders)"


def _runs(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), F.when(F.col("o_orderkey") % 9 == 0, "failed").otherwise("success").alias("status"), (F.col("o_orderstatus") == "F").alias("is_anomalous"), (F.col("o_totalprice") / 1e5).alias("seconds"))


@query(_RUNS + ", a as (select priority, count(*) as total, count(*) filter (where status = 'success') as successful, count(*) filter (where status = 'success' and hit) as anomalous, avg(seconds) filter (where status = 'success') as mean_time, min(seconds) filter (where status = 'success') as least_time, max(seconds) filter (where status = 'success') as greatest_time, sum(seconds) filter (where status = 'success') as total_time from r group by 1) select priority, total, successful, anomalous, round(mean_time, 6) as mean_time, round(least_time, 6) as least_time, round(greatest_time, 6) as greatest_time, round(total_time, 3) as total_time, round(successful / total, 6) as success_rate, round(anomalous / successful, 6) as anomaly_rate, round(successful / total_time, 6) as per_second from a")
def run_statistics(spark, sf_dir):
    """Orders as runs of a processor, of which every ninth failed."""
    return rounded(summaries.run_statistics(_runs(spark, sf_dir), ["priority"])).withColumn("total_time", F.round("total_time", 3))


@query(_RUNS + " select count(*) as n, round(avg(hit::int), 6) as hit_rate, round(avg((status = 'success')::int), 6) as success_rate, round(avg(seconds), 6) as mean_time from r")
def service_statistics(spark, sf_dir):
    r = _runs(spark, sf_dir).select(F.col("is_anomalous").alias("hit"), (F.col("status") == "success").alias("ok"), "seconds")
    return rounded(summaries.service_statistics(r))


@query(_M + ", o as (select *, row_number() over (partition by metric order by ts, id) as i, count(*) over (partition by metric) as n from e), a as (select metric, arg_max(value, i) as current, avg(value) as mean, avg(value) filter (where i > n - 60) as newest_mean, min(value) as least, max(value) as greatest, avg(value) filter (where i > n - least(n, 60) and i <= n - least(n, 60) + floor(least(n, 60) / 2)) as f, avg(value) filter (where i > n - least(n, 60) + floor(least(n, 60) / 2)) as s from o group by 1) select metric, current, round(mean, 6) as mean, round(newest_mean, 6) as newest_mean, least, greatest, case when (s - f) / f > 0.1 then 'INCREASING' when (s - f) / f < -0.1 then 'DECREASING' else 'STABLE' end as trend from a")
def resource_report(spark, sf_dir):
    return rounded(summaries.resource_report(metrics(spark, sf_dir))).select("metric", "current", "mean", "newest_mean", "least", "greatest", "trend")


_UNTIL = "2024-01-20 12:00:00"


@query(_M + f", x as (select * from e where ts >= timestamp '{_UNTIL}' - interval 24 hour and ts <= timestamp '{_UNTIL}'), o as (select *, row_number() over (partition by metric order by ts, id) as i, row_number() over (partition by metric order by ts desc, id desc) as j from x), a as (select metric, count(*) as n, avg(value) as mean, stddev_samp(value) as std, min(value) as least, max(value) as greatest, arg_min(value, j) as current, avg(value) filter (where i <= 10) as f, avg(value) filter (where j <= 10) as l from o group by 1) select metric, n, round(mean, 6) as mean, round(std, 6) as std, least, greatest, current, case when n > 10 and l > f * 1.1 then 'INCREASING' when n > 10 and l < f * 0.9 then 'DECREASING' else 'STABLE' end as trend from a")
def trend_window(spark, sf_dir):
    """A day of each metric, with the sample's standard deviation."""
    return rounded(summaries.window_trend(metrics(spark, sf_dir), F.lit(_UNTIL).cast("timestamp"), 24))


@query(_M + ", a as (select metric, avg(value) as mean, stddev_pop(value) as std, warning, count(*) filter (where value >= critical) as n_critical from e join th using (metric) group by metric, warning), r as (select metric, concat_ws(',', case when mean > warning then 'retrain' end, case when std > 0.5 * mean then 'stabilise' end, case when n_critical > 0 then 'handle_alerts' end) as advice from a) select metric, case when advice = '' then 'keep_watching' else advice end as advice from r")
def recommendations(spark, sf_dir):
    """Advice a metric: rules over its summary."""
    m = metrics(spark, sf_dir).join(_thresholds(spark), "metric")
    a = m.groupBy("metric", "warning").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count_if(F.col("value") >= F.col("critical")).alias("n_critical"))
    rules = {"retrain": F.col("mean") > F.col("warning"), "stabilise": F.col("std") > 0.5 * F.col("mean"), "handle_alerts": F.col("n_critical") > 0}
    return a.select("metric", summaries.recommendations(rules, "keep_watching").alias("advice"))


_GIVEN = _FB.replace("as rating from labels", "as rating, 1704067200 + doc_id % 2592000 as t, case when doc_id % 4 = 0 then 'expert' else 'user' end as source from labels")
_AS_OF = "2024-01-01 02:00:00"


def _given(spark, sf_dir):
    return _feedback(spark, sf_dir).withColumns({"ts": F.timestamp_seconds(F.lit(1704067200) + F.pmod("report_id", F.lit(2_592_000))), "source": F.when(F.col("report_id") % 4 == 0, "expert").otherwise("user")})


@query(_GIVEN + f" select count(*) as total, count(*) filter (where t >= epoch(timestamp '{_AS_OF}') - 3 * 86400) as recent, round(avg(is_correct::int), 6) as accuracy, round(avg(rating), 6) as mean_rating, round(avg(is_correct::int) filter (where source = 'expert'), 6) as expert_agreement from f")
def feedback_summary(spark, sf_dir):
    return rounded(summaries.feedback_summary(_given(spark, sf_dir), F.lit(_AS_OF).cast("timestamp"), 3))


@query(_GIVEN + f" select (timestamp '1970-01-01' + t * interval 1 second)::date as day, count(*) as n, count(*) filter (where is_correct) as n_correct from f where t between epoch(timestamp '{_AS_OF}') - 30 * 86400 and epoch(timestamp '{_AS_OF}') group by 1")
def feedback_daily(spark, sf_dir):
    return summaries.daily_feedback(_given(spark, sf_dir), F.lit(_AS_OF).cast("timestamp"))


@query(_GIVEN + " select report_id, rating, is_correct::varchar as label from f where rating >= 7 and source = 'expert'")
def expert_export(spark, sf_dir):
    """Training material of experts alone."""
    return learning.training_export(_given(spark, sf_dir).where("source = 'expert'"), 7)


@query(_FB + " select substring(md5(concat_ws('_', report_id::varchar, feedback_type, rating::varchar)), 1, 12) as feedback_id, count(*) as n from f group by 1")
def feedback_ids(spark, sf_dir):
    f = _feedback(spark, sf_dir)
    made = learning.feedback_id(F.col("report_id").cast("string"), F.col("feedback_type"), F.col("rating").cast("string"))
    return f.groupBy(made.alias("feedback_id")).agg(F.count(F.lit(1)).alias("n"))


@query(_FB + " select report_id, feedback_type, rating from f where report_id between 100 and 600 order by rating desc, report_id limit 25")
def feedback_page(spark, sf_dir):
    """A range of feedback, the best first, a page of 25: the limit is the feature."""
    return _feedback(spark, sf_dir).where(F.col("report_id").between(100, 600)).orderBy(F.desc("rating"), "report_id").limit(25).select("report_id", "feedback_type", "rating")


@query(_M + ", a as (select *, case when value >= critical then 'CRITICAL' else 'WARNING' end as severity, ts >= timestamp '2024-01-30' - interval 24 hour as recent from e join th using (metric) where value >= warning), l as (select metric, arg_max(value, (ts, id)) as value from e group by 1), s as (select count(*) as n_alerts, count(*) filter (where recent) as recent_alerts, count(*) filter (where recent and severity = 'CRITICAL') as recent_critical from a) select (select count(*) from l) as n_metrics, (select round(avg(value), 6) from l) as mean_value, n_alerts, recent_alerts, recent_critical, case when recent_critical > 0 then 'CRITICAL' when recent_alerts > 0 then 'WARNING' else 'HEALTHY' end as state from s")
def system_dashboard(spark, sf_dir):
    m = metrics(spark, sf_dir)
    return rounded(summaries.dashboard(m, monitor.alerts(m, _thresholds(spark)), F.lit("2024-01-30").cast("timestamp")))


@query(_TOTAL_SQL + ", r as (select report_id, round(statistical_score, 6) as score from t) select report_id, score, score > 0.5 as anomalous from r order by report_id desc limit 1000")
def detection_history(spark, sf_dir):
    """The log of detections, which keeps the last thousand."""
    scored = statistical_scores(spark, sf_dir).select("report_id", F.round("statistical_score", 6).alias("score"))
    return summaries.history(scored, [F.desc("report_id")])


@query("with s as (select l_suppkey, l_partkey, sum(l_quantity) as q from lineitem group by 1, 2), r as (select *, row_number() over (partition by l_suppkey order by q desc, l_partkey) as rank from s) select l_suppkey, string_agg(l_partkey::varchar, ',' order by rank) as items from r where rank <= 5 group by 1")
def capped_stocks(spark, sf_dir):
    """The five stocks that each supplier moves most of."""
    s = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    return summaries.capped(s, "l_suppkey", "l_partkey", "q", 5)


@query("with p as (select o_orderkey as id, o_totalprice / 1e5 as seconds, case when o_orderkey % 3 = 0 then null else (o_orderkey % 100) / 100 end as accuracy, (o_orderkey % 7) / 7 as confidence from orders), u as (select id, 'inference_time' as metric, seconds as value from p union all select id, 'accuracy', accuracy from p union all select id, 'confidence', confidence from p) select metric, count(*) as n, round(avg(value), 6) as mean from u where value is not null group by 1")
def prediction_metric_rows(spark, sf_dir):
    k = F.col("o_orderkey")
    p = table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_orderdate").alias("ts"), (F.col("o_totalprice") / 1e5).alias("seconds"), F.when(k % 3 != 0, (k % 100) / 100).alias("accuracy"), ((k % 7) / 7).alias("confidence"))
    return rounded(summaries.prediction_rows(p).groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")))


_TRIGGERS = {"1-URGENT": "PERFORMANCE_DEGRADATION", "2-HIGH": "DATA_DRIFT_DETECTED", "3-MEDIUM": "SCHEDULED_UPDATE", "4-NOT SPECIFIED": "FEEDBACK_ACCUMULATION"}


@query("with t as (select case o_orderpriority " + " ".join(f"when '{p}' then '{t}'" for p, t in _TRIGGERS.items()) + " else 'BY_HAND' end as trigger from orders), s(trigger, place, strategy) as (values ('PERFORMANCE_DEGRADATION', 0, 'THRESHOLDS'), ('PERFORMANCE_DEGRADATION', 1, 'ENSEMBLE'), ('SCHEDULED_UPDATE', 0, 'PARAMETERS'), ('SCHEDULED_UPDATE', 1, 'ENSEMBLE'), ('DATA_DRIFT_DETECTED', 0, 'FEATURES'), ('DATA_DRIFT_DETECTED', 1, 'PARAMETERS'), ('FEEDBACK_ACCUMULATION', 0, 'THRESHOLDS'), ('FEEDBACK_ACCUMULATION', 1, 'FEATURES'), ('BY_HAND', 0, 'THRESHOLDS')) select trigger, place::int as place, strategy, count(*) as n from t join s using (trigger) group by 1, 2, 3")
def adaptation_strategies(spark, sf_dir):
    """Orders as triggers, by their priority: the strategies that each calls for."""
    named = F.coalesce(*[F.when(F.col("o_orderpriority") == p, F.lit(t)) for p, t in _TRIGGERS.items()], F.lit("BY_HAND"))
    found = summaries.strategies(table(spark, sf_dir, "orders").select(named.alias("trigger")))
    return found.groupBy("trigger", "place", "strategy").agg(F.count(F.lit(1)).alias("n"))


_OUT = "with p as (select s_suppkey, (s_suppkey % 10 + 1) / 12 as a0, (s_suppkey % 9 + 1) / 12 as f0, (s_suppkey % 8 + 1) / 12 as r0, (s_nationkey % 10 + 1) / 12 as a1, (s_nationkey % 9 + 1) / 12 as f1, (s_nationkey % 8 + 1) / 12 as r1 from supplier), i as (select *, (1.0 * (a1 - a0) / greatest(a0, 0.001) + 0.8 * (f1 - f0) / greatest(f0, 0.001) + 0.6 * (r0 - r1) / greatest(r0, 0.001)) / 3 as improvement from p), c as (select s_suppkey, improvement, least(1.0, greatest(0.0, least(1.0, improvement + 0.5)) * case when a1 > a0 and f1 > f0 and r1 < r0 then 1.2 else 1.0 end) as sure from i)"


@query(_OUT + " select s_suppkey, round(improvement, 6) as improvement, round(sure, 6) as confidence, round(sure, 9) >= 0.6 as applied from c")
def adaptation_outcome(spark, sf_dir):
    """Suppliers as adaptations with metrics before and after: gain, confidence, whether it is applied."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    of = lambda x: {"accuracy": (x % 10 + 1) / 12, "f1_score": (x % 9 + 1) / 12, "false_positive_rate": (x % 8 + 1) / 12}
    gain, sure, _ = summaries.outcome(of(k), of(n))
    found = table(spark, sf_dir, "supplier").select("s_suppkey", gain.alias("improvement"), sure.alias("confidence"))
    return rounded(found.withColumn("applied", F.round("confidence", 9) >= 0.6))


_KINDS = {"click": "statistical", "view": "behavioral", "purchase": "market", "error": "semantic"}
_SET = "with w as (select event_type, count(*) as n from events where event_type in (" + ", ".join(f"'{k}'" for k in _KINDS) + ") group by 1), p as (select 'confidence_threshold' as name, (select avg(l_discount) * 10 from lineitem) as value union all select 'attention_temperature', (select 1 + avg(l_tax) from lineitem) union all select 'weight_' || case event_type " + " ".join(f"when '{k}' then '{f}'" for k, f in _KINDS.items()) + " end, n / (select sum(n) from w) from w)"


@query(_SET + ", m as (select name, value, case name when 'confidence_threshold' then greatest(0.1, value - 0.1) when 'attention_temperature' then least(2.0, value + 0.2) when 'weight_semantic' then least(0.4, value + 0.05) else value end as made from p) select name, round(value, 6) as value, round(case when starts_with(name, 'weight_') then made / (select sum(made) from m where starts_with(name, 'weight_')) else made end, 6) as tuned from m")
def parameter_tuning(spark, sf_dir):
    """Parameters taken from the tables (mean discount and tax, shares of events), tuned for falling performance."""
    means = table(spark, sf_dir, "lineitem").agg((F.avg("l_discount") * 10).alias("confidence_threshold"), (1 + F.avg("l_tax")).alias("attention_temperature"))
    counted = table(spark, sf_dir, "events").where(F.col("event_type").isin(*_KINDS)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    named = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(f"weight_{f}")) for k, f in _KINDS.items()])
    whole = counted.agg(F.sum("n").alias("n"))
    weights = counted.withColumn("whole", whole.scalar()).select(named.alias("name"), (F.col("n") / F.col("whole")).alias("value"))
    return rounded(summaries.tuned(means.unpivot([], list(means.columns), "name", "value").unionByName(weights), "PERFORMANCE_DEGRADATION"))


@query(DOCS + r", v as (select distinct unnest(words) as word from d), i as (select item_id, list_distinct([w for w in regexp_extract_all(text, '[\p{L}\p{N}_]+') if length(w) > 1 and not regexp_full_match(w, '\p{Nd}+')]) as ws from benchmark), u as (select item_id, unnest(ws) as word from i) select item_id as report_id, count(*) as n_unique, count(*) filter (where v.word is null) as n_new from u left join v using (word) group by 1")
def benchmark_novelty(spark, sf_dir):
    """Benchmark texts against the vocabulary of the documents."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("report_id"), F.col("text").alias("content"))
    found = statistical.vocabulary_novelty(items, statistical.vocabulary(reports(spark, sf_dir)))
    return found.select("report_id", "n_unique", "n_new")


