"""Queries of what is kept and brought up to date: histories, sketches, losses of batches, places of numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions.spans import number_spans
from auditloom.operators import evaluation, history, quantiles
from auditloom.plans.activity_queries import _M
from auditloom.plans.report_queries import rounded
from auditloom.plans.tables import metrics, reports, table
from auditloom.sources.shared import new_path

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query("select l_partkey as stock, l_shipdate::date as date, l_orderkey, l_linenumber, round(l_extendedprice, 2) as price from (select *, row_number() over (partition by l_partkey order by l_shipdate desc, l_orderkey desc, l_linenumber desc) as back from lineitem) where back <= 10")
def kept_bars(spark, sf_dir):
    """The last ten bars of each stock, kept up to date over three updates, the last of which is repeated."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("stock"), F.col("l_shipdate").cast("date").alias("date"), "l_orderkey", "l_linenumber", F.round("l_extendedprice", 2).alias("price"))
    path = new_path(spark, "bars")
    for part in (0, 1, 2, 2):
        history.update(spark, path, rows.where(F.col("l_orderkey") % 3 == part), "stock", ["date", "l_orderkey", "l_linenumber"], 10)
    return history.read(spark, path, rows.schema)


@query(_M + " select metric, ts::date as day, count(*) as n, true as within from e group by 1, 2")
def sketched_percentiles(spark, sf_dir):
    """Percentiles of each metric and day from its hours' sketches: whether the true ranks of all of them, counted over
    the values, are within three times the error that the sketches state."""
    m = metrics(spark, sf_dir).select("metric", "ts", "value")
    shares = (0.05, 0.25, 0.5, 0.75, 0.95)
    kept = quantiles.sketches(m, ["metric"], "ts", "value")
    days = quantiles.from_sketches(kept, ["metric", F.to_date("hour").alias("day")], shares)
    told = m.withColumn("day", F.to_date("ts")).join(days, ["metric", "day"])
    counts = [f(F.get("p", F.lit(i))).alias(f"{n}{i}") for i in range(len(shares)) for n, f in (("less", lambda q: F.count_if(F.col("value") < q)), ("upto", lambda q: F.count_if(F.col("value") <= q)))]
    ranks = told.groupBy("metric", "day").agg(F.count(F.lit(1)).alias("all"), F.min("n").alias("n"), *counts)
    error = 3 * quantiles.rank_error()
    fine = [(F.col(f"less{i}") / F.col("all") - error <= s) & (F.col(f"upto{i}") / F.col("all") + error >= s) for i, s in enumerate(shares)]
    return ranks.select("metric", "day", "n", (F.col("n") == F.col("all")) & fine[0] & fine[1] & fine[2] & fine[3] & fine[4]).toDF("metric", "day", "n", "within")


_LOGITS = "with r as (select vec_id, vec_id // 200 as batch, (label % 3)::int as label, [embedding[i]::double for i in [1, 2, 3]] as x from embeddings where len(embedding) >= 3)"


@query(_LOGITS + """, u as (select *, [v / sqrt(x[1] * x[1] + x[2] * x[2] + x[3] * x[3]) for v in x] as y from r),
p as (select a.batch, a.label = b.label as same, sqrt((a.y[1] - b.y[1]) ** 2 + (a.y[2] - b.y[2]) ** 2 + (a.y[3] - b.y[3]) ** 2) as d from u a join u b on a.batch = b.batch and a.vec_id < b.vec_id),
c as (select batch, avg(case when same then d * d else greatest(1 - d, 0) ** 2 end) as contrastive from p group by 1),
l as (select batch, count(*) as n, sum(w * ce) / sum(w) as classification from (select batch, case when label = 0 then 1.0 else 2.0 end as w, ln(exp(x[1]) + exp(x[2]) + exp(x[3])) - x[label + 1] as ce from r) group by 1)
select batch, n, round(classification, 6) as classification, round(contrastive, 6) as contrastive, round(classification + 0.1 * contrastive, 6) as loss from l join c using (batch)""")  # fmt: skip
def anomaly_losses(spark, sf_dir):
    """Batches of two hundred vectors, of which three components stand for logits: the weighted loss and the contrastive
    one, which SQL takes from all pairs."""
    v = table(spark, sf_dir, "embeddings").where(F.size("embedding") >= 3)
    rows = v.select("vec_id", F.floor(F.col("vec_id") / 200).alias("batch"), (F.col("label") % 3).cast("int").alias("label"), F.slice("embedding", 1, 3).cast("array<double>").alias("logits"))
    return rounded(evaluation.anomaly_loss(rows, "vec_id", lambda label: F.when(label == 0, 1.0).otherwise(2.0)))


_KINDS = (("percent", r"(\d+\.?\d*)%"), ("year", r"(\d{4})"), ("number", r"(\d+\.?\d*)"))
_SPANS = "with " + ", ".join(f"k{i} as (select doc_id, {i} as k, '{n}' as kind, regexp_split_to_array(coalesce(text, ''), '{p}') as parts, regexp_extract_all(coalesce(text, ''), '{p}') as found from documents)" for i, (n, p) in enumerate(_KINDS)) + ", a as (" + " union all ".join(f"select * from k{i}" for i in range(len(_KINDS))) + """),
s as (select doc_id, k, kind, i, (select coalesce(sum(length(x)), 0) from (select unnest(parts[1:i]) as x)) + (select coalesce(sum(length(x)), 0) from (select unnest(found[1:i - 1]) as x)) as start, length(found[i]) as n from (select *, unnest(range(1, len(found) + 1)) as i from a))"""


@query(_SPANS + " select d.doc_id as report_id, count(s.k) as n_spans, coalesce(md5(string_agg(kind || ':' || start::bigint || ':' || (start + s.n)::bigint, ',' order by k, i)), md5('')) as digest from documents d left join s on s.doc_id = d.doc_id group by 1")
def number_places(spark, sf_dir):
    """Every number of a text with its kind and place; kinds may overlap."""
    found = reports(spark, sf_dir).select("report_id", number_spans(F.col("content"), _KINDS).alias("s"))
    told = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("report_id", F.size("s").cast("long").alias("n_spans"), F.md5(told.cast("binary")).alias("digest"))
