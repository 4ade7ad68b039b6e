"""Queries of intake: market tables, records, caches, validation, extraction, row shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions import text as X
from auditloom.operators import intake, market, quality, semantic
from auditloom.plans.report_queries import DOCS, _in, rounded
from auditloom.plans.tables import NEGATIVE, POSITIVE, TIES, bars, reports, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query("with i as (select l_partkey as stock, count(*) as n, min(l_shipdate)::date as first, max(l_shipdate)::date as last from lineitem where l_shipdate >= timestamp '1996-01-01' and l_shipdate < timestamp '1996-04-01' group by 1) select p_partkey as stock, case when n is null then 'failed' else 'success' end as status, coalesce(n, 0) as n, date_diff('day', first, last)::int as days from part left join i on p_partkey = stock")
def market_collection(spark, sf_dir):
    """The first quarter of 1996 for every stock; those without a bar have failed."""
    found = intake.collect(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("stock")), bars(spark, sf_dir), F.lit("1996-01-01").cast("timestamp"), F.lit("1996-04-01").cast("timestamp"))
    return found.select("stock", "status", "n", F.datediff("last", "first").alias("days"))


@query("select l_partkey::varchar as code, l_linenumber::bigint as number, round(l_extendedprice, 2) as turnover, l_quantity::bigint as volume, l_orderkey as source from lineitem")
def normalised_bars(spark, sf_dir):
    names = {"code": ("l_partkey", "string"), "number": ("l_linenumber", "bigint"), "turnover": ("l_extendedprice", "double"), "volume": ("l_quantity", "bigint"), "source": ("l_orderkey", "bigint")}
    return intake.normalised(table(spark, sf_dir, "lineitem"), names).withColumn("turnover", F.round("turnover", 2))


@query("select c_custkey, c_name as name, c_mktsegment as segment, round(c_acctbal, 2)::varchar as balance from customer")
def record_pivot(spark, sf_dir):
    """Key-value rows of customers as one record each."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), X.number_text(F.col("c_acctbal"), 2).alias("balance"))
    return intake.one_record(c.unpivot(["c_custkey"], ["name", "segment", "balance"], "item", "value"), "c_custkey", "item", "value", ["name", "segment", "balance"])


@query("select s_suppkey as code, s_name as name, round(s_acctbal, 2) as value from supplier where s_suppkey in (1, 2, 3)")
def index_snapshot(spark, sf_dir):
    """Three indices by their codes."""
    return table(spark, sf_dir, "supplier").where(F.col("s_suppkey").isin(1, 2, 3)).select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"), F.round("s_acctbal", 2).alias("value"))


@query("select o_custkey as key, max((o_orderdate, o_orderkey))[2] as o_orderkey from orders where epoch(o_orderdate) > epoch(timestamp '1998-01-01') - 4320 * 3600 group by 1")
def fresh_cache(spark, sf_dir):
    """Customers' newest orders as cache entries that live 180 days."""
    cache = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("updated"), "o_orderkey")
    return intake.fresh(cache, F.lit("1998-01-01").cast("timestamp"), 4320).select("key", "o_orderkey")


_CHECK = "concat_ws(',', case when length(content) not between 10 and 50000 then 'content' end, case when report_id % 7 = 0 then 'thresholds' end, case when report_id % 11 = 0 then 'range' end, case when report_id % 5 = 4 then 'action' end)"


@query(DOCS + f", v as (select {_CHECK} as problems from d) select problems, count(*) as n from v group by 1")
def request_validation(spark, sf_dir):
    """Documents as requests; thresholds, ranges and actions that are wrong for some ids."""
    k = F.col("report_id")
    thresholds = F.array(F.lit(0.5), F.when(k % 7 == 0, 1.5).otherwise(1.0))
    day = F.lit("2024-01-01").cast("timestamp")
    end = F.when(k % 11 == 0, day).otherwise(day + F.expr("interval 1 day"))
    action = F.get(F.array(*map(F.lit, ("resolve", "dismiss", "escalate", "resolve", "delete"))), (k % 5).cast("int"))
    return reports(spark, sf_dir).select(intake.request_problems(F.col("content"), thresholds, day, end, action).alias("problems")).groupBy("problems").agg(F.count(F.lit(1)).alias("n"))


@query("with b as (select o_custkey, count(*) as size from orders group by 1) select case when size between 1 and 100 then '' else 'size' end as problems, count(*) as n, sum(size)::bigint as size from b group by 1")
def batch_validation(spark, sf_dir):
    sizes = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy(intake.batch_problems(F.col("size")).alias("problems")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


@query("with s as (select s_nationkey as version, (s_suppkey % 120) / 100 as threshold, 1 / count(*) over (partition by s_nationkey) + case when s_nationkey % 3 = 0 then 0.1 else 0 end as weight from supplier) select version, concat_ws(',', case when max(threshold) > 1 then 'thresholds' end, case when abs(sum(weight) - 1) > 0.01 then 'weights' end) as problems from s group by 1")
def config_validation(spark, sf_dir):
    """Suppliers as settings: a version a nation, of which some have weights that do not sum to 1."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("version"), F.col("s_suppkey").cast("string").alias("name"), ((F.col("s_suppkey") % 120) / 100).alias("threshold"))
    n = s.groupBy("version").agg(F.count(F.lit(1)).alias("n"))
    weights = s.join(n, "version").withColumn("weight", 1 / F.col("n") + F.when(F.col("version") % 3 == 0, 0.1).otherwise(0.0))
    return intake.settings_problems(weights.unpivot(["version", "name"], ["threshold", "weight"], "kind", "value"))


_PHRASES = ("tion", "ung", "ment", "para", "zzz")
_FIG = {"pe": r"(?:er|en) [^0-9]*(\d+\.?\d*)", "growth": r"(\d+\.?\d*)%"}


@query(DOCS + ", f as (select report_id, content, concat_ws(',', " + ", ".join(f"case when contains(content, '{p}') then '{p}' end" for p in _PHRASES) + rf") as risks, len(regexp_extract_all(content, '{_FIG['pe']}', 1))::int as n_pe, coalesce(array_to_string(regexp_extract_all(content, '{_FIG['growth']}', 1), ','), '') as growth from d) select report_id, risks, n_pe, growth, least(10 + 10 * (report_id % 2 = 0)::int + 10 * contains(content, 'the')::int + case when length(content) > 1000 then 15 when length(content) > 500 then 10 when length(content) > 200 then 5 else 0 end + 10 * (risks <> '')::int + case when length(content) > 5000 then 10 else 0 end, 100)::int as quality from f")
def pipeline_extraction(spark, sf_dir):
    """Risks, figures and the additive quality of documents, with phrases and patterns that occur in them."""
    t = F.col("content")
    found = reports(spark, sf_dir).select("report_id", t, intake.named(t, _PHRASES).alias("risks"), *[v.alias(k) for k, v in intake.figures(t, _FIG).items()])
    present = {"theme": F.lit(True), "type": F.col("report_id") % 2 == 0, "investment_advice": F.contains(t, F.lit("the")), "risks": F.size("risks") > 0}
    return found.select("report_id", F.concat_ws(",", "risks").alias("risks"), F.size("pe").alias("n_pe"), F.concat_ws(",", "growth").alias("growth"), intake.intake_quality(present, F.length(t), F.length(t)).cast("int").alias("quality"))


@query(DOCS + ", k as (select case when contains(content, 'the') then case when contains(content, 'tion') then 'en' else 'other' end end as a, case when contains(content, 'der') then case when contains(content, 'ung') then 'de' else 'other' end end as b from d), u as (select '1.1' as number, a as sector, 'the' as stock from k where a is not null union all select '1.2', b, 'der' from k where b is not null) select number, sector, stock, count(*) as n from u group by 1, 2, 3")
def key_stocks(spark, sf_dir):
    """Listed names with a sector rule: two words that occur stand for the stocks."""
    stocks = {"the": ("tion", "en"), "der": ("ung", "de")}
    found = reports(spark, sf_dir).select(F.explode(intake.key_stocks(F.col("content"), stocks, "other")).alias("s"))
    return found.select("s.*").groupBy("number", "sector", "stock").agg(F.count(F.lit(1)).alias("n"))


@query("select c_custkey, round_even(c_acctbal / 7, 3) as share, round_even(c_acctbal, 0) as whole from customer")
def rounded_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 7).alias("share"), F.col("c_acctbal").alias("whole"))
    return intake.rounded(c).withColumn("whole", F.bround("whole", 0))


@query("select n_nationkey, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' as row from nation")
def serialised_rows(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.struct("n_nationkey", "n_name")).alias("row"))


@query("select event_id, strftime(ts + interval 8 hour, '%Y-%m-%d %H:%M:%S') as shown from events")
def localised_times(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", intake.localised(F.col("ts").cast("timestamp"), "Asia/Shanghai").alias("shown"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey offset 40 limit 20")
def history_page(spark, sf_dir):
    """The third page of twenty: the limit is the feature."""
    return intake.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 40, 20)


@query(DOCS + r" select report_id, len(words)::int as n_words, try_cast(substring(content, 1, 4) as integer) as number, case when try_cast(substring(content, 1, 4) as integer) is null then 'number' else '' end as error from d")
def batch_steps(spark, sf_dir):
    """Named steps over every text; one that fails says so and does not stop the others."""
    steps = {"n_words": lambda t: F.size(X.tokens(t)), "number": lambda t: X.whole_number(F.substring(t, 1, 4))}
    return intake.attempted(reports(spark, sf_dir), steps).select("report_id", "n_words", "number", "error")


@query(DOCS + f", c as (select report_id, len([w for w in words if w in {_in(POSITIVE)}])::int as positive, len([w for w in words if w in {_in(NEGATIVE)}])::int as negative, len(words)::int as total from d) select report_id, positive, negative, total, round(case when total = 0 then 0.0 else positive / total end, 6) as positive_ratio, round(case when total = 0 then 0.0 else negative / total end, 6) as negative_ratio from c")
def sentiment_counts(spark, sf_dir):
    words = X.tokens(F.col("content"))
    c = reports(spark, sf_dir).select("report_id", X.count_in(words, POSITIVE).alias("positive"), X.count_in(words, NEGATIVE).alias("negative"), F.size(words).alias("total"))
    return rounded(c.withColumns({"positive_ratio": X.ratio(F.col("positive").cast("double"), F.col("total")), "negative_ratio": X.ratio(F.col("negative").cast("double"), F.col("total"))}))


@query(DOCS + r" select count(*) as n, count(*) filter (where regexp_matches(content, '[。！？.!?]{3,}')) as repeated_marks, count(*) filter (where regexp_matches(content, '[A-Za-z]{10,}[\x{4e00}-\x{9fff}]{10,}')) as mixed_scripts from d")
def text_quality_flags(spark, sf_dir):
    flags = quality.text_flags(F.col("content"))
    return reports(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(flags[k]).alias(k) for k in ("repeated_marks", "mixed_scripts")])


_ANSWERS = ("程度：严重，存在数据矛盾与观点矛盾", "中等的逻辑矛盾", "轻微", "没有问题")


@query("with a as (select doc_id as report_id, case doc_id % 5 when 0 then '" + "' when 1 then '".join(_ANSWERS[:2]) + f"' when 2 then '{_ANSWERS[2]}' when 3 then '{_ANSWERS[3]}' end as response from documents) select report_id, case when contains(response, '严重') then 0.9 when contains(response, '中等') then 0.6 when contains(response, '轻微') then 0.3 when response is not null then 0.0 end::double as score, coalesce(concat_ws(',', case when contains(response, '观点矛盾') then '观点矛盾' end, case when contains(response, '数据矛盾') then '数据矛盾' end, case when contains(response, '逻辑矛盾') then '逻辑矛盾' end), '') as kinds from a")
def answer_parsing(spark, sf_dir):
    """Answers of a language model, read by the severity and kinds that they name."""
    response = F.get(F.array(*map(F.lit, _ANSWERS)), (F.col("report_id") % 5).cast("int"))
    return reports(spark, sf_dir).select("report_id", response.alias("r")).select("report_id", semantic.answer_score(F.col("r")).alias("score"), F.concat_ws(",", semantic.answer_kinds(F.col("r"))).alias("kinds"))


@query("with l as (select l_partkey as stock, l_shipdate as date, lag(l_shipdate) over (partition by l_partkey order by l_orderkey, l_linenumber, l_shipdate) as before from lineitem) select stock, count(*) filter (where date < before) as n_unsorted, count(*) filter (where date = before) as n_equal from l group by 1")
def unsorted_series(spark, sf_dir):
    """Stocks' bars in the order of arrival: how often a date lies before the one that came before it."""
    return market.order_problems(bars(spark, sf_dir), [*TIES, "date"]).select("stock", "n_unsorted", "n_equal")


_CODES = "lpad((c_custkey % 1000000)::varchar, 6, '0') || case c_custkey % 4 when 0 then '.SZ' when 1 then '.SH' when 2 then '.BJ' else '.XX' end"


@query(f"select c_custkey, concat_ws(',', case when c_custkey % 6 = 0 then 'rating' end, case when c_custkey % 13 not between 1 and 10 then 'analysts' end, case when {_CODES} not similar to '.*\\.(SZ|SH|BJ)' then 'exchange' end) as problems from customer")
def business_rules(spark, sf_dir):
    """Customers as records with a rating, analysts and a code."""
    k = F.col("c_custkey")
    suffix = F.get(F.array(*map(F.lit, (".SZ", ".SH", ".BJ", ".XX"))), (k % 4).cast("int"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 6 == 0, "强推").otherwise("买入").alias("rating"), F.array_repeat(F.lit("a"), (k % 13).cast("int")).alias("analysts"), F.array(F.concat(F.lpad((k % 1_000_000).cast("string"), 6, "0"), suffix)).alias("stocks"))
    return c.select("c_custkey", quality.business_problems(c).alias("problems"))
