"""Queries that run as streams over the events, held against SQL that replays them."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.operators import monitor
from auditloom.plans.activity_queries import _M, _stream, _thresholds
from auditloom.plans.tables import metrics
from auditloom.sources.shared import new_path
from auditloom.streaming import callbacks, monitoring, stateful

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


LIFETIME, CAPACITY = 86_400, 30


@query(
    f"""with recursive e as (select event_type as shard, user_id::varchar as key, epoch_us(ts) as made, event_id as id, row_number() over (partition by event_type order by ts, event_id) as i from events),
walk as (select shard, 0::bigint as i, []::struct(key varchar, made bigint, id bigint)[] as held, null::bigint as id, null::boolean as hit, null::bigint as result_id from (select distinct shard from e)
union all select shard, i, case when hit then held else list_append(case when len(others) >= {CAPACITY} then others[2:] else others end, {{'key': key, 'made': made, 'id': id}}) end, id, hit, case when hit then kept.id else id end
from (select *, kept is not null and made - kept.made < {LIFETIME}000000 as hit from (select e.shard, e.i, e.key, e.made, e.id, w.held, list_filter(w.held, lambda x: x.key = e.key)[1] as kept, list_filter(w.held, lambda x: x.key <> e.key) as others from walk w join e on e.shard = w.shard and e.i = w.i + 1)))
select shard, id, hit, result_id from walk where id is not null"""
)
def cached_results(spark, sf_dir):
    """Every event asks for its user's result; results are kept a day, thirty for each type of event."""
    requests = _stream(spark, sf_dir).select(F.col("metric").alias("shard"), F.col("author").alias("key"), "ts", "id")
    with stateful.state_on_disk(spark):
        return monitoring.run_once(stateful.cached(requests, LIFETIME, CAPACITY), "cached")


_RESOLVED = _M + """, j as (select metric, id, ts, value >= warning as bad, sum((value >= warning)::int) over (partition by metric order by ts, id) as run from e join th using (metric)),
f as (select *, row_number() over (partition by metric, run order by ts, id) - case when run > 0 then 1 else 0 end as fine from j),
a as (select metric, id, ts, ts + interval 300 second as due from f where bad),
n as (select a.*, f.fine as now from a asof join f on f.metric = a.metric and f.ts <= a.due),
l as (select n.*, (select min(f.ts) from f where f.metric = n.metric and f.ts > n.due and f.fine = 5) as later from n),
r as (select metric, id, ts, case when now < 5 then later when due <= (select date_trunc('millisecond', max(ts)) from events) then due end as resolved_ts from l)"""


@query(_RESOLVED + " select metric, id, epoch_us(ts) as ts, epoch_us(resolved_ts) as resolved_ts from r where resolved_ts is not null")
def alert_resolutions(spark, sf_dir):
    """When each alert was resolved, read off the whole table."""
    return _in_micros(monitor.resolutions(metrics(spark, sf_dir), _thresholds(spark)))


@query(SQL["alert_resolutions"])
def streaming_resolutions(spark, sf_dir):
    """The same from the stream, by state and timers."""
    with stateful.state_on_disk(spark):
        return _in_micros(monitoring.run_once(stateful.resolutions(_stream(spark, sf_dir), _thresholds(spark)), "resolutions"))


def _in_micros(found):
    return found.select("metric", "id", F.unix_micros("ts").alias("ts"), F.unix_micros("resolved_ts").alias("resolved_ts"))


@query(_RESOLVED + " select metric, count(*) as n, count(*) filter (where resolved_ts is null) as open from r where not (ts < timestamp '2024-02-15' - interval 30 day and resolved_ts is not null) group by 1")
def retained_alerts(spark, sf_dir):
    """Alerts that are kept: those of the last thirty days, and older ones that are not resolved."""
    m = metrics(spark, sf_dir)
    alerts = monitor.alerts(m, _thresholds(spark)).select("metric", "id", "ts")
    told = alerts.join(monitor.resolutions(m, _thresholds(spark)).select("metric", "id", "resolved_ts"), ["metric", "id"], "left").withColumn("resolved", F.col("resolved_ts").isNotNull())
    kept = monitor.retained(told, F.lit("2024-02-15").cast("timestamp"))
    return kept.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("resolved")).alias("open"))


_ALERTS = _M + ", a as (select id, metric, value, case when value >= critical then 'CRITICAL' else 'WARNING' end as severity from e join th using (metric) where value >= warning)"


@query(_ALERTS + " select 'all' as sink, severity, count(*) as n, sum(id)::bigint as ids from a group by severity union all select 'critical', severity, count(*), sum(id)::bigint from a where severity = 'CRITICAL' group by severity")
def alert_fan_out(spark, sf_dir):
    """The stream's alerts in two sinks; every batch is replayed by force, which leaves them as they were."""
    found = monitoring.alert_stream(_stream(spark, sf_dir), _thresholds(spark)).select("id", "metric", "value", "severity")
    paths = {n: new_path(spark, f"alerts-{n}") for n in ("all", "critical")}
    each = callbacks.fan_out({"all": callbacks.files_sink(paths["all"]), "critical": callbacks.files_sink(paths["critical"], F.col("severity") == "CRITICAL")}, new_path(spark, "ledger"))

    def twice(batch, number):
        each(batch, number)
        each(batch, number)

    found.writeStream.foreachBatch(twice).option("checkpointLocation", new_path(spark, "fan-out")).trigger(availableNow=True).start().awaitTermination()
    rows = [spark.read.schema(found.schema).option("recursiveFileLookup", True).parquet(p).withColumn("sink", F.lit(n)) for n, p in paths.items()]
    return rows[0].unionByName(rows[1]).groupBy("sink", "severity").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query(_ALERTS + " select 'alerts_critical' as metric, (select count(*) from a where severity = 'CRITICAL')::double as total union all select 'alerts_n', (select count(*) from a)::double union all select 'input_rows', (select count(*) from events)::double")
def stream_progress(spark, sf_dir):
    """What the stream's triggers read and observed, as a metric table, added up over the triggers."""
    log = _progress(spark, sf_dir)
    rows = log.rows(spark).where(F.col("metric").isin("input_rows", "alerts_n", "alerts_critical"))
    return rows.groupBy("metric").agg(F.sum("value").alias("total"))


def _progress(spark, sf_dir):
    found = monitoring.alert_stream(_stream(spark, sf_dir), _thresholds(spark))
    told = callbacks.observed(found, "alerts", F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"))
    return callbacks.listened(spark, lambda: monitoring.run_once(told, "observed"))
