"""Queries of record checks (dates, numbers, formats) and of periods of metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions.scalars import parse_date, parse_number
from auditloom.operators import monitor, quality
from auditloom.plans.activity_queries import _M
from auditloom.plans.report_queries import rounded
from auditloom.plans.tables import metrics, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_NOW = "1998-06-01"


@query(f"with o as (select o_orderkey, o_orderdate::date as published, o_orderdate::date + (o_orderkey % 5 - 2)::int as analysed from orders) select o_orderkey, (published < analysed)::int as errors, (published > timestamp '{_NOW}' + interval 1 day)::int + (analysed > timestamp '{_NOW}' + interval 1 day)::int as warnings from o")
def date_checks(spark, sf_dir):
    """Orders as reports with dates of publication and analysis: what is out of order or lies ahead."""
    date = F.col("o_orderdate").cast("date")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", date.cast("string").alias("publish_date"), F.date_add(date, (F.col("o_orderkey") % 5 - 2).cast("int")).cast("string").alias("analysis_date"))
    errors, warnings = quality.date_issues(rows, F.lit(_NOW).cast("timestamp"))
    return rows.select("o_orderkey", errors.alias("errors"), warnings.alias("warnings"))


@query("with p as (select p_partkey, p_retailprice - 950 as target, p_size - 3 as current, p_size * 30 - 200 as growth, p_size * 5 as pe, p_retailprice * 60 as cap from part) select p_partkey, (target <= 0)::int + (current <= 0)::int + (growth not between -100 and 1000)::int + (pe not between 0 and 200)::int + (cap not between 0 and 100000)::int as errors from p")
def numeric_checks(spark, sf_dir):
    """Parts as records with prices and ratios: how many numbers lie outside their ranges."""
    price, size = F.col("p_retailprice"), F.col("p_size")
    rows = table(spark, sf_dir, "part").select("p_partkey", (price - 950).cast("string").alias("target_price"), (size - 3).cast("string").alias("current_price"), (size * 30 - 200).cast("string").alias("growth_rate"), (size * 5).cast("string").alias("pe_ratio"), (price * 60).alias("market_cap"))
    return rows.select("p_partkey", quality.numeric_errors(rows).alias("errors"))


@query(r"with c as (select c_custkey as k, case when c_custkey % 3 = 0 then 'someone' else 'c' || c_custkey || '@example.com' end as email, case c_custkey % 4 when 0 then '138' || lpad(c_custkey::varchar, 8, '0') when 1 then '010-' || lpad(c_custkey::varchar, 8, '0') when 2 then c_custkey::varchar else null end as phone, [lpad(c_custkey::varchar, 6, '0') || case c_custkey % 5 when 0 then '.SZ' when 1 then '' else '.XX' end, 'X' || c_custkey] as stocks from customer) select k as c_custkey, (not regexp_full_match(email, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}'))::int + coalesce((not regexp_full_match(phone, '(\+86)?1[3-9]\d{9}|\d{3,4}-?\d{7,8}'))::int, 0) + len([s for s in stocks if not regexp_full_match(s, '\d{6}(\.(SZ|SH|BJ))?')]) as errors from c")
def format_checks(spark, sf_dir):
    """Customers as records with e-mail, telephone and stock codes, in good and bad forms."""
    k = F.col("c_custkey")
    padded = lambda n: F.lpad(k.cast("string"), n, "0")
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(k % 3 == 0, "someone").otherwise(F.concat(F.lit("c"), k.cast("string"), F.lit("@example.com"))).alias("email"),
        F.when(k % 4 == 0, F.concat(F.lit("138"), padded(8))).when(k % 4 == 1, F.concat(F.lit("010-"), padded(8))).when(k % 4 == 2, k.cast("string")).alias("phone"),
        F.array(F.concat(padded(6), F.when(k % 5 == 0, ".SZ").when(k % 5 == 1, "").otherwise(".XX")), F.concat(F.lit("X"), k.cast("string"))).alias("stocks"),
    )
    return rows.select("c_custkey", quality.format_errors(rows).cast("long").alias("errors"))


@query("select o_orderkey, case when o_orderkey % 6 = 5 then null else o_orderdate::date::varchar end as date from orders")
def parsed_dates(spark, sf_dir):
    """Dates written in five ways, and in one that none reads, come back as they were."""
    date, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    forms = ("yyyy-M-d", "yyyy/M/d", "yyyy年M月d日", "yyyy-MM-dd HH:mm:ss", "yyyyMMdd", "'day' D")
    text = F.coalesce(*[F.when(k % len(forms) == i, F.date_format(date, f)) for i, f in enumerate(forms)])
    return table(spark, sf_dir, "orders").select("o_orderkey", parse_date(text).cast("date").cast("string").alias("date"))


@query("select l_orderkey, l_linenumber, round(l_quantity * case l_linenumber % 6 when 0 then 1e4 when 1 then 1e8 when 2 then 1e3 when 3 then 1e2 else 1 end, 4) as value from lineitem")
def parsed_numbers(spark, sf_dir):
    """Numbers written with four units, with a percent sign, and bare."""
    marks = ("万", "亿", "千", "百", "%", "")
    text = F.concat(F.col("l_quantity").cast("string"), F.element_at(F.array(*map(F.lit, marks)), (F.col("l_linenumber") % 6 + 1).cast("int")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(parse_number(text), 4).alias("value"))


_UNTIL = "2024-01-20 12:00:00"


@query(_M + f", x as (select * from e where ts <= timestamp '{_UNTIL}' and ts >= timestamp '{_UNTIL}' - interval 24 hour), o as (select *, row_number() over (partition by metric order by ts, id) as up, row_number() over (partition by metric order by ts desc, id desc) as down from x), d as (select metric, count(*) as n, avg(value) filter (where up <= 10) as first_mean, avg(value) filter (where down <= 10) as last_mean from o group by 1 having count(*) >= 20) select metric, n, round(first_mean, 6) as first_mean, round(last_mean, 6) as last_mean, last_mean < 0.8 * first_mean as drifted from d")
def drift_window(spark, sf_dir):
    """Drift within one day."""
    return rounded(monitor.drift(metrics(spark, sf_dir), as_of=F.lit(_UNTIL).cast("timestamp")))


@query(_M + f", a as (select metric, value, (epoch_us(timestamp '{_UNTIL}') - epoch_us(ts)) / 86400000000 as age from e where ts <= timestamp '{_UNTIL}'), s as (select * from a, (values (1), (7), (30), (90)) d(days) where age < 2 * days), r as (select days, metric, count(*) filter (where age < days) as n, avg(value) filter (where age < days) as mean, min(value) filter (where age < days) as least, max(value) filter (where age < days) as greatest, avg(value) filter (where age >= days) as before from s group by 1, 2) select days, metric, n, round(mean, 6) as mean, least, greatest, round(before, 6) as before, round(case when before <> 0 then (mean - before) / abs(before) end, 6) as change from r where n > 0")
def period_report(spark, sf_dir):
    """Every metric over a day, a week, a month and a quarter, against the period before."""
    return rounded(monitor.period_report(metrics(spark, sf_dir), F.lit(_UNTIL).cast("timestamp")))
