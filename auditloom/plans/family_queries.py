"""Queries that bring the four detector families together, and of features, views and behaviour histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions import text as X
from auditloom.functions.scalars import level
from auditloom.operators import behavioral, features, fusion, market, semantic
from auditloom.plans import activity_queries as activity
from auditloom.plans import report_queries as report
from auditloom.plans.report_queries import DOCS, LEVEL, _in, rounded
from auditloom.plans.tables import NEGATIVE, POSITIVE, TIES, WORDS, bars, metrics, reports, table
from auditloom.sources.shared import stash

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def exact(sql: str) -> str:
    """SQL without its rounding to six places, which is for what a query tells, not for what is built on it."""
    out, at = "", 0
    while (start := sql.find("round(", at)) >= 0:
        depth, end = 1, start + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = sql[start + 6 : end - 1]
        out += sql[at:start] + (f"({exact(inner[:-3])})" if inner.endswith(", 6") else f"round({exact(inner)})")
        at = end
    return out + sql[at:]


#: A document's stocks are the parts of the order of its number; users stand for the stocks of events.
_STOCKS = "select distinct doc_id as report_id, l_partkey as stock from documents join lineitem on l_orderkey = doc_id"
_TIMING = "with r as (select distinct doc_id as report_id, l_partkey % 150 as stock, 1704067200 + (doc_id % 720) * 3600 as t from documents join lineitem on l_orderkey = doc_id), n as (select *, count(*) over (partition by report_id) as n_stocks from r), v as (select event_id, user_id as stock, floor(epoch(ts))::bigint as u from events where event_type = 'error'), p as (select report_id, event_id, count(*) as shared, min(n_stocks) as n_stocks, min(abs(t - u)) as apart from n join v on n.stock = v.stock and abs(t - u) <= 86400 group by 1, 2) select report_id, max(((1 - apart / 86400) + shared / greatest(n_stocks, 1)) / 2) as score from p group by 1"
_FREQUENCY = "with a as (select doc_id as report_id, source as author, timestamp '2024-01-01' + (doc_id % 720)::int * interval 1 hour as ts from documents), base as (select author, avg(n) as mean from (select author, ts::date as day, count(*) as n from a group by 1, 2) group by 1), t as (select report_id, author, count(*) over (partition by author order by ts range between interval 30 days preceding and current row) as trailing_n from a), q as (select report_id, trailing_n / 30 / greatest(mean, 1e-6) as ratio from t join base using (author)) select report_id, case when ratio > 2 then least((ratio - 2) / 2, 1) when ratio < 0.5 then least((0.5 - ratio) * 2, 1) else 0.0 end as score from q"
_FOCUS = f"with r as ({_STOCKS}), f as (select distinct l_partkey as stock from lineitem where l_shipdate < timestamp '1996-01-01') select report_id, least(count(*) filter (where f.stock is null) / count(*) / 0.3, 1) as score from r left join f using (stock) group by 1"
_FAMILIES = (
    f"with st as ({exact(report.SQL['statistical_score'])}), wr as ({exact(report.SQL['writing_anomaly'])}), se as ({exact(report.SQL['semantic_rules'])}), ret as ({exact(activity.SQL['return_anomaly'])}), vol as ({exact(activity.SQL['volume_anomaly'])}), tr as ({exact(activity.SQL['trend_anomaly'])}), ac as ({exact(activity.SQL['accuracy_drop'])}), stocks as ({_STOCKS}), ti as ({_TIMING}), fq as ({_FREQUENCY}), fo as ({_FOCUS}), "
    "rs as (select report_id, max(score) as score from stocks join ret using (stock) group by 1), vs as (select report_id, max(score) as score from stocks join vol using (stock) group by 1), "
    "f as (select st.report_id, statistical_score as statistical, 0.25 * (coalesce(ti.score, 0) + coalesce(fq.score, 0) + coalesce(fo.score, 0) + coalesce(wr.score, 0)) as behavioral, case when k.report_id is not null then 0.3 * coalesce(rs.score, 0) + 0.25 * coalesce(vs.score, 0) + 0.25 * coalesce((select score from ac), 0) + 0.2 * coalesce(tr.score, 0) end as market, 0.3 * contradiction + 0.2 * source + 0.2 * consistency as semantic from st join wr on wr.report_id = st.report_id join se on se.report_id = st.report_id left join ti on ti.report_id = st.report_id left join fq on fq.report_id = st.report_id left join fo on fo.report_id = st.report_id left join rs on rs.report_id = st.report_id left join vs on vs.report_id = st.report_id left join tr on tr.report_id = st.report_id left join (select distinct report_id from stocks) k on k.report_id = st.report_id), "
    "f12 as (select report_id, round(statistical, 12) as statistical, round(behavioral, 12) as behavioral, round(market, 12) as market, round(semantic, 12) as semantic from f), "
    "g as (select *, 3 + (market is not null)::int as n, (statistical + behavioral + semantic + coalesce(market, 0)) / (3 + (market is not null)::int) as score from f12), h as (select *, sqrt(((statistical - score) ** 2 + (behavioral - score) ** 2 + (semantic - score) ** 2 + coalesce((market - score) ** 2, 0)) / n) as spread from g)"
)


def families(spark, sf_dir):
    """(report_id, statistical, behavioral, market, semantic) of documents; market is null for one without stocks."""
    docs = reports(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("report_id"), F.col("l_partkey").alias("stock"), "l_shipdate")
    stocks = stash(docs.select("report_id", "ts").join(lines.select("report_id", "stock").distinct(), "report_id"), "stocks")
    score = lambda df, name: df.select("report_id", F.col("score").alias(name))
    m = metrics(spark, sf_dir)
    timing = behavioral.timing_anomaly(stocks.select("report_id", "ts", (F.col("stock") % 150).alias("stock")).distinct(), m.where("metric = 'error'").select(F.col("id").alias("event_id"), "ts", F.col("author").alias("stock")))
    frequency = behavioral.frequency_anomaly(docs.select("report_id", "author", "ts"), behavioral.frequency_baseline(behavioral.daily_counts(docs)))
    focus = behavioral.focus_shift(stocks.select("report_id", "stock"), lines.where(F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp")).select("stock"))
    writing = stash(behavioral.writing_features(docs, WORDS.sentence_end), "writing")
    writing = behavioral.writing_anomaly(writing, behavioral.writing_baseline(writing))
    behaviour = docs.select("report_id")
    for part, name in ((timing, "timing"), (frequency, "frequency"), (focus, "focus"), (writing, "writing")):
        behaviour = behaviour.join(score(part, name), "report_id", "left")
    traded = stocks.select("report_id").distinct()
    # All bars are put in order once; what looks at a stock's last bars reads the last thirty.
    returns = stash(market.with_returns(bars(spark, sf_dir), TIES).drop("volatility"), "returns")
    base = stash(market.baseline(returns), "base")
    recent = stash(market.last_bars(returns, 30, TIES).drop("back"), "recent")
    moved = market.return_anomaly(recent, base, TIES).select("stock", F.col("score").alias("returns"))
    moved = moved.join(market.volume_anomaly(recent, base, TIES).select("stock", F.col("score").alias("volumes")), "stock")
    of_report = stocks.join(moved, "stock").groupBy("report_id").agg(F.max("returns").alias("returns"), F.max("volumes").alias("volumes"))
    traded = traded.join(of_report, "report_id", "left")
    trend = market.trend_anomaly(market.price_trend(recent, TIES), activity.directions(spark, sf_dir))
    dropped = market.accuracy_stats(activity._predictions(spark, sf_dir), ["at", "id"]).select("score")
    traded = traded.join(score(trend, "trend"), "report_id", "left").withColumn("accuracy_drop", dropped.scalar())
    meant = semantic.total(semantic.rules(docs, WORDS).withColumn("deviation", F.lit(0.0)))
    found = report.statistical_scores(spark, sf_dir).select("report_id", F.col("statistical_score").alias("statistical"))
    found = found.join(behavioral.total(behaviour).select("report_id", F.col("behavioral_score").alias("behavioral")), "report_id")
    found = found.join(market.total(traded).select("report_id", F.col("market_score").alias("market")), "report_id", "left")
    found = found.join(meant.select("report_id", F.col("semantic_score").alias("semantic")), "report_id")
    # Sums taken in another order differ in their last bits, which must not decide at a border.
    return found.select("report_id", *[F.round(f, 12).alias(f) for f in ("statistical", "behavioral", "market", "semantic")])


@query(_FAMILIES + " select report_id, round(statistical, 6) as statistical, round(behavioral, 6) as behavioral, round(market, 6) as market, round(semantic, 6) as semantic from h")
def family_scores(spark, sf_dir):
    return rounded(families(spark, sf_dir))


@query(_FAMILIES + f" select report_id, round(score, 6) as score, round(spread, 6) as spread, round(((statistical > 0.5)::int + (behavioral > 0.5)::int + (semantic > 0.5)::int + coalesce((market > 0.5)::int, 0)) / n, 6) as vote, {LEVEL.format('round(score, 9)')} as level, concat_ws(',', case when statistical > 0.4 then 'statistical' end, case when behavioral > 0.4 then 'behavioral' end, case when market > 0.4 then 'market' end, case when semantic > 0.4 then 'semantic' end) as key_families from h")
def fusion_families(spark, sf_dir):
    """All four families fused."""
    found = fusion.fuse(families(spark, sf_dir)).withColumn("level", level(F.round("score", 9)))
    return rounded(found.select("report_id", "score", "spread", "vote", "level", "key_families"))


@query("with l as (select l_suppkey as author, l_partkey as stock, p_brand as industry, l_shipdate::date as day from lineitem join part on p_partkey = l_partkey) select author, count(*) as n, count(distinct day) as days, count(distinct stock) as n_stocks, count(distinct industry) as n_industries, round(count(distinct stock) / count(*), 6) as diversity from l group by 1")
def behaviour_history(spark, sf_dir):
    """Per author: reports, days, stocks, industries and how spread the stocks are."""
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))  # noqa: E741
    rows = l.select(F.col("l_suppkey").alias("author"), F.col("l_partkey").alias("stock"), F.col("p_brand").alias("industry"), F.col("l_shipdate").alias("ts"))
    return rounded(behavioral.activity_profile(rows))


@query("select event_type, count(*) as n, max(event_id) as last_id from (select event_id, event_type from events union all select (select count(*) from events), 'policy') group by 1")
def events_with_new(spark, sf_dir):
    """An event added: its id is the number of those before."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return behavioral.with_event(events, "event_id", {"event_type": F.lit("policy")}).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"))


@query("with c as (select c_custkey, c_name, n_name, c_mktsegment, c_custkey % 4 as n_stocks from customer join nation on n_nationkey = c_nationkey) select c_custkey, length(c_name)::int as author_length, n_stocks::int as stock_count, (n_stocks > 1)::int as is_multi_stock, (n_stocks > 0)::int as has_sz, (n_stocks > 1)::int as has_sh, (n_stocks > 2)::int as has_bj, length(n_name)::int as institution_length, case c_mktsegment when 'BUILDING' then 1.0 when 'MACHINERY' then 0.0 else 0.5 end::double as rating_score, case c_mktsegment when 'AUTOMOBILE' then 1 when 'FURNITURE' then 2 else 0 end as type_code from c")
def metadata_features(spark, sf_dir):
    """Customers as records: author, institution, stocks of up to three exchanges, rating, type."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    stocks = F.slice(F.array(*map(F.lit, ("000001.SZ", "600001.SH", "830001.BJ"))), F.lit(1), (F.col("c_custkey") % 4).cast("int"))
    f = features.metadata_features(F.col("c_name"), stocks, F.col("n_name"), F.col("c_mktsegment"), F.col("c_mktsegment"), {"BUILDING": 1.0, "MACHINERY": 0.0}, {"AUTOMOBILE": 1, "FURNITURE": 2})
    return c.select("c_custkey", *[v.alias(k) for k, v in f.items()])


@query(DOCS + f", a as (select report_id, length(content) as chars, len(words) as n, len(regexp_split_to_array(content, '[.!?]')) as s, len(list_distinct(words)) as u, len([w for w in words if w in {_in(POSITIVE)}]) as pos, len([w for w in words if w in {_in(NEGATIVE)}]) as neg from d), b as (select *, case when n = 0 then 0.0 else pos / n end as pr, case when n = 0 then 0.0 else u / n end as ur, 1 / (1 + n / s / 20) as rd from a) select report_id, round(chars / greatest(report_id % 4, 1), 6) as content_per_stock, round(abs(pr - (report_id % 5) / 4), 6) as alignment, round(case when n = 0 then 0.0 else (pos + neg) / n end, 6) as intensity, round((ur + least(n / s / 50, 1) + 1 - rd) / 3, 6) as complexity from b")
def engineered_features(spark, sf_dir):
    """Features of features: length a stock, sentiment against rating, intensity, complexity."""
    k = F.col("report_id")
    t = features.text_features(reports(spark, sf_dir), POSITIVE, NEGATIVE, WORDS.sentence_end)
    return rounded(t.select("report_id", *[v.alias(n) for n, v in features.engineered((k % 4), (k % 5) / 4).items()]))


@query("select event_id as id, 'k' as name, try_cast(regexp_extract(props, '\"k\": *(-?[0-9.]+)', 1) as double) as value from events where props is not null")
def dynamic_features(spark, sf_dir):
    """Whatever numbers a record's open part holds, by name."""
    return features.dynamic_numbers(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.try_parse_json("props").alias("data")), "id")


@query()
def historical_deviation(spark, sf_dir):
    """Each turn against earlier views of its conversation's role and of its conversation: the greater deviation (the
    tests have a plain version)."""
    c = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null").withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("turn") * 86400))
    c = c.withColumns({"report_id": F.concat_ws("-", "conv_id", "turn"), "s": X.sentiment(X.tokens(F.col("text")), POSITIVE, NEGATIVE), "summary": semantic.view_summary(F.coalesce("text", F.lit("")), POSITIVE + NEGATIVE, end=WORDS.sentence_end)})
    fanned = semantic.fan_out(c.select("report_id", "ts", "s", "summary", "conv_id", "role"), {"stock": F.concat_ws("-", "conv_id", "role"), "author": F.concat_ws("-", "conv_id", F.lit("all"))})
    views = fanned.select("key", F.col("report_id").alias("view_id"), F.col("ts").alias("view_ts"), F.col("summary").alias("view_summary"), F.col("s").alias("view_s"))
    keyed = fanned.withColumn("report_key", F.concat_ws("|", "report_id", "kind"))
    near = semantic.recent_views(keyed.select(F.col("report_key").alias("report_id"), "key", "ts", "summary", "s"), views)
    compared = near.withColumn("similarity", semantic.sequence_ratio(F.col("summary"), F.col("view_summary"))).withColumn("gap", semantic.sentiment_gap(F.col("s"), F.col("view_s")))
    each = semantic.view_deviation(compared).withColumn("report_id", F.substring_index("report_id", "|", 1))
    return rounded(semantic.worst_context(each))
