"""Queries over bars, events, predictions, feedback and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions.scalars import level
from auditloom.operators import behavioral, features, forest, fusion, learning, market, monitor, semantic, similarity
from auditloom.plans.report_queries import _RULES, _TOTAL_SQL, LEVEL, rounded, statistical_scores
from auditloom.plans.tables import TIES, WORDS, bars, daily_bars, metrics, reports, table
from auditloom.streaming import monitoring

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_BARS = "with b as (select l_partkey as stock, l_shipdate as date, l_orderkey, l_linenumber, l_extendedprice / l_quantity as close, l_quantity as volume from lineitem), r as (select *, coalesce((close - lag(close) over o) / nullif(lag(close) over o, 0), 0) as ret, row_number() over (partition by stock order by date desc, l_orderkey desc, l_linenumber desc) as back from b window o as (partition by stock order by date, l_orderkey, l_linenumber))"
_BASE = _BARS + ", a as (select stock, count(*) as n, avg(ret) as ret_mean, stddev_pop(ret) as ret_std, quantile_cont(ret, 0.05) as ret_p5, quantile_cont(ret, 0.95) as ret_p95, avg(volume) as volume_mean, stddev_pop(volume) as volume_std, quantile_cont(volume, 0.05) as volume_p5, quantile_cont(volume, 0.95) as volume_p95 from r group by 1 having count(*) >= 30)"


def _returns(spark, sf_dir):
    return market.with_returns(bars(spark, sf_dir), TIES)


@query(_BARS + " select stock, l_orderkey, l_linenumber, round(ret, 6) as ret, round(case when count(*) over w = 20 then stddev_pop(ret) over w * sqrt(252) end, 6) as volatility from r window w as (partition by stock order by date, l_orderkey, l_linenumber rows between 19 preceding and current row)")
def rolling_volatility(spark, sf_dir):
    return rounded(_returns(spark, sf_dir).select("stock", "l_orderkey", "l_linenumber", "ret", "volatility"))


@query(_BARS + " select stock, l_orderkey, l_linenumber, round(close, 8) as close, back::int as back from r where back <= 5")
def last_n_bars(spark, sf_dir):
    return market.last_bars(bars(spark, sf_dir), 5, TIES).select("stock", "l_orderkey", "l_linenumber", F.round("close", 8).alias("close"), "back")


@query(_BASE + " select stock, n, round(ret_mean, 6) as ret_mean, round(ret_std, 6) as ret_std, round(ret_p5, 6) as ret_p5, round(ret_p95, 6) as ret_p95, round(volume_mean, 6) as volume_mean, round(volume_std, 6) as volume_std, round(volume_p5, 6) as volume_p5, round(volume_p95, 6) as volume_p95 from a")
def market_baseline(spark, sf_dir):
    return rounded(market.baseline(_returns(spark, sf_dir)))


@query(_BASE + ", l as (select stock, avg(ret) as recent from r where back <= 30 group by 1) select stock, round(recent, 6) as recent, round(case when abs(recent - ret_mean) > 3 * ret_std or abs(recent) > 0.05 then least(greatest(abs(recent - ret_mean) / greatest(3 * ret_std, 1e-6), abs(recent) / 0.05), 1) else 0.0 end, 6) as score from l join a using (stock)")
def return_anomaly(spark, sf_dir):
    r = _returns(spark, sf_dir)
    return rounded(market.return_anomaly(r, market.baseline(r), TIES))


@query(_BASE + ", l as (select stock, avg(volume) as recent from r where back <= 10 group by 1), q as (select stock, recent / greatest(volume_mean, 1e-6) as ratio from l join a using (stock)) select stock, round(ratio, 6) as ratio, round(case when ratio > 3 then least((ratio - 3) / 3, 1) when ratio < 1 / 3 then least((1 / 3 - ratio) * 3, 1) else 0.0 end, 6) as score from q")
def volume_anomaly(spark, sf_dir):
    r = _returns(spark, sf_dir)
    return rounded(market.volume_anomaly(r, market.baseline(r), TIES))


_TREND = _BARS + ", t as (select stock, case when count(*) = 14 then regr_slope(close, -back::double) / avg(close) end as trend from r where back <= 14 group by 1)"


@query(_TREND + " select stock, round(trend, 6) as trend from t")
def price_trend(spark, sf_dir):
    return rounded(market.price_trend(bars(spark, sf_dir), TIES))


@query(_TREND + ", o as (select l_orderkey as report_id, l_partkey as stock, case l_returnflag when 'A' then 'up' when 'R' then 'down' else 'neutral' end as direction from lineitem), d as (select report_id, max(case direction when 'up' then greatest(-trend, 0) when 'down' then greatest(trend, 0) else abs(trend) end) as deviation from o join t using (stock) group by 1) select report_id, round(deviation, 6) as deviation, round(case when deviation > 0.2 then least(deviation / 0.2, 1) else 0.0 end, 6) as score from d")
def trend_anomaly(spark, sf_dir):
    return rounded(market.trend_anomaly(market.price_trend(bars(spark, sf_dir), TIES), directions(spark, sf_dir)))


def directions(spark, sf_dir):
    """Lines as reports on a stock, with the direction that they see it take."""
    direction = F.when(F.col("l_returnflag") == "A", "up").when(F.col("l_returnflag") == "R", "down").otherwise("neutral")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("report_id"), F.col("l_partkey").alias("stock"), direction.alias("direction"))


_PRED = "with p as (select o_orderkey as id, o_orderdate as placed, o_totalprice as predicted, actual from orders join (select l_orderkey, sum(l_extendedprice * (1 - l_discount)) as actual from lineitem group by 1) on l_orderkey = o_orderkey), s as (select *, abs(predicted - actual) / greatest(abs(actual), 1e-6) as error, greatest(0, 1 - abs(predicted - actual) / greatest(abs(actual), 1e-6)) as accuracy, row_number() over (order by placed desc, id desc) as back from p)"


def _predictions(spark, sf_dir):
    actual = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("actual"))
    return market.with_accuracy(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.col("o_totalprice").alias("predicted")).join(actual, "id"))


@query(_PRED + " select id, round(predicted, 4) as predicted, round(actual, 4) as actual, round(error, 4) as error, round(accuracy, 4) as accuracy from s")
def prediction_accuracy(spark, sf_dir):
    return _predictions(spark, sf_dir).select("id", *[F.round(c, d).alias(c) for c, d in (("predicted", 4), ("actual", 4), ("error", 4), ("accuracy", 4))])


@query(_PRED + ", l as (select count(*) as n, avg(accuracy) as mean, stddev_pop(accuracy) as std, regr_slope(accuracy, -back::double) as trend, avg(accuracy) filter (where back <= 10) as recent from s where back <= 100) select n, round(mean, 6) as mean, round(std, 6) as std, round(trend, 6) as trend, round(recent, 6) as recent, round(mean - recent, 6) as drop, round(greatest(0.0, least(1.0, mean - recent)), 6) as score, mean - recent > 0.3 as is_anomaly from l")
def accuracy_drop(spark, sf_dir):
    return rounded(market.accuracy_stats(_predictions(spark, sf_dir), ["at", "id"]))


_DAILY = "with b as (select l_partkey as stock, l_shipdate::date as date, l_extendedprice / l_quantity as close, (l_orderkey, l_linenumber) as k from lineitem), d as (select stock, date, arg_min(close, k) as open, max(close) as high, min(close) as low, arg_max(close, k) as close, count(*) as n from b group by 1, 2)"


@query(_DAILY + " select stock, date, case when high < greatest(open, close) then 'high_low' when low > least(open, close) then 'low_high' when low <= 0 then 'not_positive' else '' end as problems from d")
def ohlc_validation(spark, sf_dir):
    return market.validate_bars(daily_bars(spark, sf_dir)).select("stock", "date", "problems")


@query("select l_partkey as stock, count(*) as n, count(distinct l_shipdate) as n_dates, count(*) > count(distinct l_shipdate) as has_duplicates, date_diff('day', min(l_shipdate)::date, max(l_shipdate)::date)::int as days from lineitem group by 1")
def series_coverage(spark, sf_dir):
    b = bars(spark, sf_dir)
    return market.series_problems(b).join(market.coverage_days(b), "stock")


_ACT = "with e as (select user_id as author, ts, event_id as id, event_type as metric, value from events), daily as (select author, ts::date as day, count(*) as n from e group by 1, 2), base as (select author, count(*) as days, avg(n) as mean, stddev_pop(n) as std, quantile_cont(n, 0.25) as p25, quantile_cont(n, 0.5) as p50, quantile_cont(n, 0.75) as p75, quantile_cont(n, 0.9) as p90, quantile_cont(n, 0.95) as p95 from daily group by 1)"


@query(_ACT + " select author, days, " + ", ".join(f"round({c}, 6) as {c}" for c in ("mean", "std", "p25", "p50", "p75", "p90", "p95")) + " from base")
def publication_frequency(spark, sf_dir):
    return rounded(behavioral.frequency_baseline(behavioral.daily_counts(metrics(spark, sf_dir))))


@query(_ACT + ", t as (select id, author, count(*) over (partition by author order by ts range between interval 30 days preceding and current row) as \"trailing\" from e), q as (select id, author, \"trailing\", \"trailing\" / 30 / greatest(mean, 1e-6) as ratio from t join base using (author)), z as (select *, case when ratio > 2 then least((ratio - 2) / 2, 1) when ratio < 0.5 then least((0.5 - ratio) * 2, 1) else 0.0 end as score from q) select id, author, \"trailing\", round(ratio, 6) as ratio, round(score, 6) as score, score > 0 as is_anomaly from z")
def frequency_anomaly(spark, sf_dir):
    m = metrics(spark, sf_dir)
    base = behavioral.frequency_baseline(behavioral.daily_counts(m))
    return rounded(behavioral.frequency_anomaly(m, base).select("id", "author", "trailing", "ratio", "score", "is_anomaly"))


@query(_ACT + ", r as (select id, author, ts, floor(epoch(ts))::bigint as t from e where metric = 'signup'), v as (select id, author, floor(epoch(ts))::bigint as u from e where metric = 'error'), p as (select r.id as report_id, v.id as event_id, abs(t - u) as apart from r join v on r.author = v.author and abs(t - u) <= 86400), b as (select report_id, count(*) as n_events, max(((1 - apart / 86400) + 1) / 2) as score from p group by 1) select r.id as report_id, coalesce(n_events, 0) as n_events, round(coalesce(score, 0), 6) as score, coalesce(score, 0) > 0.1 as is_anomaly from r left join b on r.id = b.report_id")
def timing_interval_join(spark, sf_dir):
    """Signups near errors of the same user (users stand for stocks)."""
    m = metrics(spark, sf_dir)
    left = m.where("metric = 'signup'").select(F.col("id").alias("report_id"), "ts", F.col("author").alias("stock"))
    right = m.where("metric = 'error'").select(F.col("id").alias("event_id"), "ts", F.col("author").alias("stock"))
    return rounded(behavioral.timing_anomaly(left, right))


@query("with l as (select distinct l_orderkey as report_id, l_partkey as stock, l_shipdate >= timestamp '1998-01-01' as late from lineitem), r as (select distinct report_id, stock from l where late), f as (select distinct stock from l where not late), m as (select report_id, count(*) as n_stocks, count(*) filter (where f.stock is null) as n_new from r left join f using (stock) group by 1) select report_id, n_stocks, n_new, round(n_new / n_stocks, 6) as ratio, round(least(n_new / n_stocks / 0.3, 1), 6) as score, n_new / n_stocks > 0.3 as is_anomaly from m")
def focus_shift(spark, sf_dir):
    """What shipped from 1998 on against all stocks that shipped before."""
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("report_id"), F.col("l_partkey").alias("stock"), (F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp")).alias("late"))
    return rounded(behavioral.focus_shift(r.where("late").select("report_id", "stock"), r.where("not late").select("stock")))


@query("with r as (select distinct l_orderkey as report_id, l_partkey as stock from lineitem) select stock, count(*) as n from r group by 1 order by n desc, stock limit 20")
def top_focus(spark, sf_dir):
    return behavioral.top_focus(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("report_id"), F.col("l_partkey").alias("stock")).distinct())


@query(_ACT + ", g as (select author, ts, max(ts) over (partition by author) as last, floor((floor(epoch(ts))::bigint - floor(epoch(lag(ts) over (partition by author order by ts, id)))::bigint) / 86400)::bigint as gap from (select * from e qualify floor(epoch(ts))::bigint >= floor(epoch(max(ts) over (partition by author)))::bigint - 90 * 86400)) select author, count(*) as n, round(avg(gap), 6) as gap_mean, round(stddev_pop(gap), 6) as gap_std, min(gap) as gap_min, coalesce(avg(gap) < 7, false) as frequent from g group by 1")
def author_intervals(spark, sf_dir):
    return rounded(behavioral.author_intervals(metrics(spark, sf_dir)))


@query("select event_id as id, year(ts)::int as year, month(ts)::int as month, day(ts)::int as day, hour(ts)::int as hour, (isodow(ts) - 1)::int as weekday, quarter(ts)::int as quarter, isodow(ts) >= 6 as is_weekend, isodow(ts) < 6 and hour(ts) between 9 and 14 as is_trading_hour, round(sin(2 * pi() * month(ts) / 12), 6) as month_sin, round(cos(2 * pi() * month(ts) / 12), 6) as month_cos, round(sin(2 * pi() * hour(ts) / 24), 6) as hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) as hour_cos, floor((epoch(timestamp '2025-01-01') - floor(epoch(ts))::bigint) / 86400)::bigint as age_days from events")
def temporal_features(spark, sf_dir):
    return rounded(features.temporal_features(metrics(spark, sf_dir), "id", "ts", F.lit("2025-01-01").cast("timestamp")))


@query("select p_partkey, round(ln(p_retailprice + 1), 6) as log_price, round(sqrt(p_retailprice), 6) as sqrt_price, round(p_size / 50, 6) as pe_norm, round((p_size - 25 + 50) / 100, 6) as growth_norm, round(p_retailprice / (p_size * 20) - 1, 6) as upside, round(case when p_size <> 25 then p_size / (p_size - 25) end, 6) as peg from part")
def numeric_features(spark, sf_dir):
    p, size = table(spark, sf_dir, "part"), F.col("p_size").cast("double")
    return rounded(features.numeric_features(p, "p_partkey", F.col("p_retailprice"), size * 20, size, size - 25))


#: Warning and critical values of each metric; beyond them a value is an alert.
THRESHOLDS = (("view", 80.0, 120.0), ("signup", 60.0, 100.0), ("error", 40.0, 80.0), ("click", 90.0, 150.0), ("purchase", 100.0, 200.0))
_M = "with e as (select event_type as metric, ts, value, event_id as id, user_id as author from events), th(metric, warning, critical) as (values " + ", ".join(f"('{m}', {w}, {c})" for m, w, c in THRESHOLDS) + ")"
_SEV = "case when value >= critical then 'CRITICAL' when value >= warning then 'WARNING' end"


def _thresholds(spark):
    return spark.createDataFrame(list(THRESHOLDS), "metric string, warning double, critical double")


@query(_M + f" select id, metric, value, {_SEV} as severity from e join th using (metric) where value >= warning")
def metric_alerts(spark, sf_dir):
    return monitor.alerts(metrics(spark, sf_dir), _thresholds(spark)).select("id", "metric", "value", "severity")


@query(_M + " select metric, arg_max(value, (ts, id)) as value, max(ts) as ts from e group by 1")
def latest_metric(spark, sf_dir):
    return monitor.latest(metrics(spark, sf_dir)).select("metric", "value", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(_M + f", l as (select metric, arg_max(value, (ts, id)) as value, max(ts) as ts from e group by 1 order by ts desc, metric limit 5), s as (select {_SEV} as severity from l join th using (metric)), c as (select count(*) filter (where severity = 'CRITICAL') as critical, count(*) filter (where severity = 'WARNING') as warnings from s) select critical, warnings, case when critical > 0 then 'CRITICAL' when warnings > 2 then 'WARNING' when warnings > 0 then 'CAUTION' else 'HEALTHY' end as health from c")
def system_health(spark, sf_dir):
    return monitor.health(metrics(spark, sf_dir), _thresholds(spark))


@query(_M + ", o as (select *, row_number() over (partition by metric order by ts, id) as i from e), t as (select metric, count(*) as n, regr_slope(value, i) as slope, avg(value) as mean, stddev_pop(value) as std, arg_min(value, i) as first, arg_max(value, i) as last from o group by 1) select metric, n, round(slope, 6) as slope, round(mean, 6) as mean, round(std, 6) as std, first, last, case when n < 3 then 'UNKNOWN' when mean <> 0 and std / abs(mean) > 0.2 then 'VOLATILE' when slope > 0.01 then 'IMPROVING' when slope < -0.01 then 'DECLINING' else 'STABLE' end as trend, round(last - first, 6) as change, round(case when first <> 0 then 100 * (last - first) / abs(first) end, 4) as percent_change from t")
def metric_trends(spark, sf_dir):
    return rounded(monitor.trends(metrics(spark, sf_dir))).withColumn("percent_change", F.round("percent_change", 4))


@query(_M + ", o as (select *, row_number() over (partition by metric order by ts, id) as up, row_number() over (partition by metric order by ts desc, id desc) as down from e), d as (select metric, count(*) as n, avg(value) filter (where up <= 10) as first_mean, avg(value) filter (where down <= 10) as last_mean from o group by 1 having count(*) >= 20) select metric, n, round(first_mean, 6) as first_mean, round(last_mean, 6) as last_mean, last_mean < 0.8 * first_mean as drifted from d")
def drift(spark, sf_dir):
    return rounded(monitor.drift(metrics(spark, sf_dir)))


@query(_M + " select metric, count(*) as n, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, min(value) as min, max(value) as max, round(quantile_cont(value, 0.25), 6) as q25, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.75), 6) as q75 from e group by 1")
def metric_detail(spark, sf_dir):
    return rounded(monitor.detail(metrics(spark, sf_dir)))


@query(_M + " select metric, round(avg(value), 6) as mean, round(sum(value), 2) as total, round(arg_max(value, (ts, id)) - arg_min(value, (ts, id)), 6) as change, warning as baseline, round(avg(value) - warning, 6) as vs_baseline from e join th using (metric) group by metric, warning")
def performance_summary(spark, sf_dir):
    base = _thresholds(spark).select("metric", F.col("warning").alias("baseline"))
    return rounded(monitor.summary(metrics(spark, sf_dir), base)).withColumn("total", F.round("total", 2))


@query(_M + ", a as (select id as alert_id, metric, ts, warning from e join th using (metric) where value >= critical), k as (select metric, ts as m_ts, value, row_number() over (partition by metric order by ts desc, id desc) as back from e), j as (select alert_id, a.metric, a.ts, a.warning, count(*) filter (where m_ts > a.ts) as n_later, count(*) filter (where m_ts > a.ts and k.value < a.warning) as n_fine from a left join k on a.metric = k.metric and back <= 5 group by all) select alert_id, metric, n_later, n_fine, date_diff('second', ts, timestamp '2024-02-01') > 300 and n_later = 5 and n_fine = 5 as resolved from j")
def alert_autoresolve(spark, sf_dir):
    m = metrics(spark, sf_dir)
    bad = monitor.alerts(m, _thresholds(spark)).where("severity = 'CRITICAL'").select(F.col("id").alias("alert_id"), "metric", "ts", "warning")
    return monitor.autoresolve(bad, m, F.lit("2024-02-01").cast("timestamp")).select("alert_id", "metric", "n_later", "n_fine", "resolved")


@query(_M + ", d as (select ts::date as day, count(*) as n, count(*) filter (where metric = 'error') as errors from e group by 1) select day, n, errors, round(sum(errors) over (order by day) / sum(n) over (order by day), 6) as running_rate from d")
def error_rate(spark, sf_dir):
    return rounded(monitor.error_rate(metrics(spark, sf_dir).withColumn("is_error", F.col("metric") == "error")))


_FB = "with f as (select doc_id as report_id, coalesce(quality = 1, false) as is_correct, case when toxic = 1 then 'FALSE_POSITIVE' when quality = 0 then 'MISSED' else 'CORRECT' end as feedback_type, doc_id % 10 + 1 as rating from labels)"


_AT, _AS_OF = 1704067200, "2024-01-01 02:00:00"


def _feedback(spark, sf_dir):
    kind = F.when(F.col("toxic") == 1, "FALSE_POSITIVE").when(F.col("quality") == 0, "MISSED").otherwise("CORRECT")
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("report_id"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("is_correct"), kind.alias("feedback_type"), (F.col("doc_id") % 10 + 1).alias("rating"), F.lit(None).cast("string").alias("corrected_label"))


@query(_FB + " select feedback_type, count(*) as n, count(*) filter (where is_correct) as n_correct, round(avg(is_correct::int), 6) as accuracy, round(avg(rating) / 10, 6) as mean_rating from f group by 1")
def feedback_statistics(spark, sf_dir):
    return rounded(learning.feedback_statistics(_feedback(spark, sf_dir)))


@query(_FB.replace("with f as", "with given as") + ", " + _TOTAL_SQL.removeprefix("with ") + ", j as (select statistical_score as score, is_correct as hit from t left join given using (report_id)) select count(hit) as n_feedback, count(*) filter (where hit) as true_positives, count(*) filter (where not hit and score > 0.5) as false_positives, count(*) filter (where score > 0.5) as positives, round(count(*) filter (where hit) / count(hit), 6) as accuracy, round(count(*) filter (where not hit and score > 0.5) / greatest(count(*) filter (where score > 0.5), 1), 6) as false_positive_rate from j")
def feedback_metrics(spark, sf_dir):
    found = statistical_scores(spark, sf_dir).select(F.col("report_id").alias("detection_id"), F.col("statistical_score").alias("score"))
    return rounded(learning.detection_metrics(found, _feedback(spark, sf_dir).select(F.col("report_id").alias("detection_id"), F.col("is_correct").alias("is_true_positive"))))


@query(_FB + " select report_id, is_correct::varchar as label, rating from f where rating >= 5")
def training_export(spark, sf_dir):
    return learning.training_export(_feedback(spark, sf_dir))


@query(_FB.replace("as rating from labels", f"as rating, {_AT} + doc_id % 1209600 as t from labels") + f", s as (select count(*) filter (where feedback_type = 'FALSE_POSITIVE') / count(*) as fp, count(*) filter (where feedback_type = 'MISSED') / count(*) as missed from f where t between epoch(timestamp '{_AS_OF}') - 604800 and epoch(timestamp '{_AS_OF}')), x as (select metric as name, warning / 200 as threshold, fp, missed from (values " + ", ".join(f"('{m}', {w})" for m, w, _ in THRESHOLDS) + ") v(metric, warning), s) select name, threshold::double as threshold, round(case when fp > 0.3 then least(0.9, threshold + 0.05) when missed > 0.2 then greatest(0.1, threshold - 0.05) else threshold end, 6)::double as adapted from x")
def threshold_adaptation(spark, sf_dir):
    """Feedback is given a time within a fortnight, of which the last seven days count."""
    names = _thresholds(spark).select(F.col("metric").alias("name"), (F.col("warning") / 200).alias("threshold"))
    given = _feedback(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.lit(_AT) + F.pmod("report_id", F.lit(1_209_600))))
    return rounded(learning.adapt_thresholds(names, given, F.lit(_AS_OF).cast("timestamp")))


def _dot(a: str, b: str) -> str:
    return f"list_sum([p[1]::double * p[2] for p in list_zip({a}, {b})])"


#: Searches take every vector whose id is divisible by 20, against all.
_PAIRS = "with t as (select embedding as tv, label as tl, vec_id as target from embeddings where vec_id % 20 = 0), s as (select target, vec_id as id, label = tl as same_class, {0} as similarity from embeddings, t where vec_id <> target)"
_NEAR = _PAIRS + ", r as (select *, row_number() over (partition by target, same_class order by similarity desc, id) as rank from s)"
_COSINE = f"({_dot('embedding', 'tv')}) / (sqrt({_dot('embedding', 'embedding')}) * sqrt({_dot('tv', 'tv')}))"


def _samples(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return v, v.where("id % 20 = 0")


@query(_NEAR.format(_COSINE) + " select target, id, same_class, round(similarity, 6) as similarity, rank::int as rank from r where rank <= case when same_class then 5 else 3 end")
def embedding_topk(spark, sf_dir):
    return rounded(similarity.nearest(*_samples(spark, sf_dir)))


@query(_NEAR.format("1 / (1 + sqrt(list_sum([(p[1]::double - p[2]) * (p[1]::double - p[2]) for p in list_zip(embedding, tv)])))") + " select target, id, same_class, round(similarity, 6) as similarity, rank::int as rank from r where rank <= case when same_class then 5 else 3 end")
def embedding_topk_euclidean(spark, sf_dir):
    return rounded(similarity.nearest(*_samples(spark, sf_dir), measure="euclidean"))


@query(_PAIRS.format(_COSINE) + " select target, same_class, count(*) as n, round(avg(similarity), 6) as mean, round(max(similarity), 6) as max, round(min(similarity), 6) as min, round(stddev_samp(similarity), 6) as std from s group by 1, 2")
def similarity_statistics(spark, sf_dir):
    return rounded(similarity.statistics(*_samples(spark, sf_dir)))


@query("with v as (select p_partkey, feature, value from (select p_partkey, p_size::double as p_size, p_retailprice from part) unpivot (value for feature in (p_size, p_retailprice))) select p_partkey, feature, value, round(value / 2, 6) as shapley, 1.0::double as gradient, value as drop_effect, round(abs(value) / sum(abs(value)) over (partition by p_partkey), 6) as share from v")
def importance_additive(spark, sf_dir):
    values = similarity.long_features(table(spark, sf_dir, "part"), "p_partkey", ["p_size", "p_retailprice"])
    return rounded(similarity.additive_importance(values, "p_partkey"))


@query("with v as (select p_partkey, feature, value from (select p_partkey, p_size::double as p_size, p_retailprice from part) unpivot (value for feature in (p_size, p_retailprice))) select p_partkey, feature, round(value / 2, 6) as shapley from v")
def importance_sampled(spark, sf_dir):
    """Monte-Carlo values of the additive model, which must equal the closed form."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return rounded(similarity.sampled_shapley(p, "p_partkey", ["p_size", "p_retailprice"], lambda f: f["p_size"] + f["p_retailprice"]))


@query("select p_partkey, round(abs(p_size * 50 - p_retailprice) / (abs(p_size * 50) + abs(p_retailprice)), 6) as distance, greatest(0.1, 1 - (p_size % 4) / 4) as plausibility from part")
def plausibility_distance(spark, sf_dir):
    size = F.col("p_size").cast("double")
    return rounded(table(spark, sf_dir, "part").select("p_partkey", similarity.change_distance(size * 50, F.col("p_retailprice")).alias("distance"), similarity.plausibility(size % 4, F.lit(4)).alias("plausibility")))


@query()
def counterfactuals(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return rounded(similarity.counterfactuals(p, "p_partkey", ["p_size", "p_retailprice"], 1000.0))


@query()
def isolation_forest(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("l_quantity").alias("quantity"), F.stddev_pop("l_discount").alias("discount"))
    p = table(spark, sf_dir, "part").join(per, "p_partkey").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice", "n", "quantity", "discount")
    return rounded(forest.outliers(p, "p_partkey", ["p_size", "p_retailprice", "n", "quantity", "discount"]))


_FUSE = (
    _TOTAL_SQL
    + ", "
    + _RULES.removeprefix("with ").split("from documents), ", 1)[1].replace("s as (", "rs as (", 1).replace(" from s), ", " from rs), ", 1).replace("c as (select report_id, content, least", "rc as (select report_id, content, least", 1).replace("e as (select report_id, contradiction", "re as (select report_id, contradiction", 1).replace(" from c)", " from rc)", 1)
    + ", fam as (select report_id, statistical_score as st, 0.3 * contradiction + 0.2 * source + 0.2 * consistency as se from t join re using (report_id)), w as (select *, (st + se) / 2 as score, ((st > 0.5)::int + (se > 0.5)::int) / 2 as vote, abs(st - se) / 2 as spread from fam), z as (select *, greatest(0.0, least(1.0, ((1 - 2 * least(spread, 0.5)) + case when score > 0.5 then least(score * 2, 1) else greatest(0.5, score * 2) end) / 2)) as confidence from w)"
)


def fused(spark, sf_dir, keep=()):
    r = reports(spark, sf_dir)
    rules = semantic.total(semantic.rules(r, WORDS).withColumn("deviation", F.lit(0.0)))
    s = statistical_scores(spark, sf_dir, keep).drop("length", "n_unique", "sentiment_score", "length_score", "novelty_score", "sentiment_part", "number_score").withColumnRenamed("statistical_score", "statistical")
    both = s.join(rules.select("report_id", F.col("semantic_score").alias("semantic")), "report_id")
    none = F.lit(None).cast("double")
    return fusion.fuse(both.withColumns({"behavioral": none, "market": none}))


@query(_FUSE + f" select report_id, round(score, 6) as score, round(vote, 6) as vote, round(spread, 6) as spread, {LEVEL.format('score')} as level, round(confidence, 6) as confidence, round(greatest(0.0, least(1.0, score - 1.96 * spread / sqrt(2))), 6) as low, round(greatest(0.0, least(1.0, score + 1.96 * spread / sqrt(2))), 6) as high, case when score >= 0.8 and confidence >= 0.8 then 'CRITICAL' when score >= 0.6 and confidence >= 0.7 then 'HIGH' when score >= 0.4 and confidence >= 0.6 then 'MEDIUM' when score >= 0.2 then 'LOW' else 'MINIMAL' end as risk, case when score >= 0.8 then 'IMMEDIATE' else '' end as alerts, concat_ws(',', case when st > 0.4 then 'statistical' end, case when se > 0.4 then 'semantic' end) as key_families, score > 0.5 as is_anomalous from z")
def fusion_report(spark, sf_dir):
    """Two live families fused; the others are not available for plain documents."""
    return rounded(fused(spark, sf_dir).select("report_id", "score", "vote", "spread", "level", "confidence", "low", "high", "risk", "alerts", "key_families", "is_anomalous"))


@query(_FUSE + " select report_id, round(greatest(0.0, least(1.0, score + 0.1 * (1 - least(spread, 0.5) - 0.5) + 0.1 * (greatest(0.0, least(1.0, 0.8 - case when length(content) < 100 then 0.3 when length(content) < 500 then 0.1 else 0.0 end - 0.2 - case when length(content) = 0 then 0.2 else 0.0 end)) - 0.5))), 6) as dynamic_score from z join d using (report_id)")
def fusion_dynamic(spark, sf_dir):
    quality = fusion.data_quality(F.col("content"), F.lit(False), F.lit(True))
    found = fused(spark, sf_dir, [quality.alias("quality")])
    return rounded(found.select("report_id", fusion.dynamic_threshold(F.col("score"), F.col("quality")).alias("dynamic_score")))


@query()
def fusion_weights(spark, sf_dir):
    """Weights folded over each language's whole history of detections, in order of id."""
    scored = fused(spark, sf_dir, ["lang"]).withColumnsRenamed({"lang": "group", "report_id": "at"})
    return rounded(fusion.fold_weights(scored.select("group", "at", "score", *fusion.FAMILIES)))


def _stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return raw.select(F.col("event_type").alias("metric"), F.col("ts").cast("timestamp").alias("ts"), "value", F.col("event_id").alias("id"), F.col("user_id").alias("author"))


@query(SQL["metric_alerts"])
def streaming_metric_alerts(spark, sf_dir):
    """The alerts of the stream: equal to those of the table."""
    return monitoring.run_once(monitoring.alert_stream(_stream(spark, sf_dir), _thresholds(spark)).select("id", "metric", "value", "severity"), "alerts")


@query(_M + " select metric, ts::date as day, count(*) as n, round(avg(value), 6) as mean from e group by 1, 2")
def streaming_daily_counts(spark, sf_dir):
    return rounded(monitoring.run_once(monitoring.daily_counts(_stream(spark, sf_dir)), "daily", "complete"))


@query(_M + f" select {LEVEL.format('value / 200')} as level, metric, count(*) as n from e group by 1, 2")
def metric_levels(spark, sf_dir):
    return metrics(spark, sf_dir).groupBy(level(F.col("value") / 200).alias("level"), "metric").agg(F.count(F.lit(1)).alias("n"))
