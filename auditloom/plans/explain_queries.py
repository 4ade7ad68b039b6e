"""Queries of explanations: feature differences, contrasts, perturbations, counterfactual sets, more losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions import text as X
from auditloom.functions.scalars import level
from auditloom.operators import evaluation, explain, similarity
from auditloom.plans.activity_queries import _COSINE, _NEAR, _samples
from auditloom.plans.report_queries import _TOTAL_SQL, DOCS, LEVEL, rounded, statistical_scores
from auditloom.plans.tables import reports, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _product(f):
    return f["p_size"] * f["p_retailprice"]


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")


_PAIR = "with p as (select a.c_custkey, a.c_acctbal as x, b.c_acctbal as y, a.c_mktsegment as s, b.c_mktsegment as t from customer a join customer b on b.c_custkey = a.c_custkey + 1), m as (select c_custkey, case when greatest(abs(x), abs(y)) = 0 then true else abs(x - y) / greatest(abs(x), abs(y)) < 0.1 end as balance, s = t or abs(length(s) - length(t)) / greatest(length(s), length(t), 1) < 0.1 as segment from p)"


@query(_PAIR + " select c_custkey, concat_ws(',', case when balance then 'balance' end, case when segment then 'segment' end) as matching, concat_ws(',', case when not balance then 'balance' end, case when not segment then 'segment' end) as contrasting from m")
def feature_differences(spark, sf_dir):
    """Each customer against the next."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    after = c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("c_acctbal").alias("b2"), F.col("c_mktsegment").alias("s2"))
    both = c.join(after, "c_custkey")
    same, other = explain.differences({"balance": F.col("c_acctbal"), "segment": F.col("c_mktsegment")}, {"balance": F.col("b2"), "segment": F.col("s2")}, {"balance": "number", "segment": "string"})
    return both.select("c_custkey", F.concat_ws(",", same).alias("matching"), F.concat_ws(",", other).alias("contrasting"))


@query(_NEAR.format(_COSINE) + ", c as (select target, id from r where not same_class and rank <= 3), f as (select c.target, c.id, i, case when greatest(abs(a.embedding[i]::double), abs(b.embedding[i]::double)) = 0 then true else abs(a.embedding[i]::double - b.embedding[i]::double) / greatest(abs(a.embedding[i]::double), abs(b.embedding[i]::double)) < 0.1 end as alike from c join embeddings a on a.vec_id = c.target join embeddings b on b.vec_id = c.id, range(1, 6) t(i)), n as (select target, count(distinct id) as size from c group by 1) select target, 'f' || i as feature, count(*) as n from f join n using (target) where not alike group by target, i, size having count(*) >= size // 2")
def contrast_features(spark, sf_dir):
    """What the contrasting samples of each target have in common: of five features, those that differ in half of them."""
    v, targets = _samples(spark, sf_dir)
    near = similarity.nearest(v, targets).where("not same_class").select("target", "id")
    names = [f"f{i}" for i in range(1, 6)]
    of = lambda prefix: {n: F.get(F.col(f"{prefix}v"), i).cast("double") for i, n in enumerate(names)}
    both = near.join(v.select(F.col("id").alias("target"), F.col("vector").alias("av")), "target").join(v.select("id", F.col("vector").alias("bv")), "id")
    _, other = explain.differences(of("a"), of("b"), dict.fromkeys(names, "number"))
    return explain.common_contrasts(both.select("target", other.alias("contrasting")), "target")


@query(DOCS + ", p as (select report_id, list_distinct(words) as w, list_distinct([substring(x, 1, 2) for x in words]) as h from d), j as (select a.report_id, a.w, b.w as w2, a.h, b.h as h2 from p a join p b on b.report_id = a.report_id + 1), k as (select report_id, case when len(w) + len(w2) = 0 then null else len(list_intersect(w, w2)) / (len(w) + len(w2) - len(list_intersect(w, w2))) end as x, case when len(h) + len(h2) = 0 then null else len(list_intersect(h, h2)) / (len(h) + len(h2) - len(list_intersect(h, h2))) end as y from j) select report_id, round(case when x is null and y is null then 0.0 else (coalesce(x, 0) + coalesce(y, 0)) / ((x is not null)::int + (y is not null)::int) end, 6) as similarity from k")
def jaccard_features(spark, sf_dir):
    """Each document against the next, by its words and by their beginnings."""
    told = F.transform(F.array(X.tokens(F.col("content"))), lambda w: F.struct(F.array_distinct(w).alias("w"), F.array_distinct(F.transform(w, lambda x: F.substring(x, 1, 2))).alias("h")))[0]
    p = reports(spark, sf_dir).select("report_id", told.alias("t"))
    after = p.select((F.col("report_id") - 1).alias("report_id"), F.col("t").alias("t2"))
    similar = explain.mean_jaccard([F.col("t.w"), F.col("t.h")], [F.col("t2.w"), F.col("t2.h")])
    return rounded(p.join(after, "report_id").select("report_id", similar.alias("similarity")))


#: Standard normal numbers: the quantiles in the middles of ten equal shares, in a mixed order.
DRAWS = (0.125661, -1.036433, 0.674490, -0.385320, 1.644854, -0.125661, 1.036433, -1.644854, 0.385320, -0.674490)


@query("with z(z) as (values " + ", ".join(f"({z})" for z in DRAWS) + "), v as (select p_partkey, f as feature, p_size * p_retailprice - case f when 'p_size' then (p_size + (abs(p_size) * 0.1 + 0.01) * z::double) * p_retailprice else p_size * (p_retailprice + (abs(p_retailprice) * 0.1 + 0.01) * z::double) end as fall from part, z, (values ('p_size'), ('p_retailprice')) t(f)), a as (select p_partkey, feature, avg(fall) as mean, stddev_pop(fall) as std from v group by 1, 2) select p_partkey, feature, round(abs(mean), 4) as importance, round(greatest(0.1, 1 - std / (abs(mean) + 1e-6)), 4) as confidence from a")
def importance_permutation(spark, sf_dir):
    """Features shaken by noise, under the model that multiplies them."""
    found = explain.permutation(_parts(spark, sf_dir), "p_partkey", ["p_size", "p_retailprice"], _product, DRAWS)
    return found.select("p_partkey", "feature", F.round("importance", 4).alias("importance"), F.round("confidence", 4).alias("confidence"))


@query("select p_partkey, feature, round(case feature when 'p_size' then p_retailprice else p_size end, 4)::double as gradient, round(p_size * p_retailprice, 4) as drop from part, (values ('p_size'), ('p_retailprice')) t(feature)")
def importance_gradient(spark, sf_dir):
    """Slopes of a product are the other factor; without a factor nothing is left."""
    found = explain.gradient(_parts(spark, sf_dir), "p_partkey", ["p_size", "p_retailprice"], _product)
    return found.select("p_partkey", "feature", F.round("gradient", 4).alias("gradient"), F.round("drop", 4).alias("drop"))


#: Factors of the alternatives: eight pairs, of which some leave a feature as it is.
FACTORS = ((0.8, 1.0), (0.9, 1.1), (1.0, 1.2), (1.1, 0.9), (1.2, 1.0), (1.2, 1.2), (0.8, 0.8), (1.0, 0.9))
_SETS = "with f(k, a, b) as (values " + ", ".join(f"({i}, {a}::double, {b}::double)" for i, (a, b) in enumerate(FACTORS)) + "), e as (select p_partkey, k, p_size::double as x0, p_retailprice as y0, p_size::double * a as x, p_retailprice * b as y from part, f)"


def _sets(spark, sf_dir):
    return explain.candidates(_parts(spark, sf_dir), "p_partkey", ["p_size", "p_retailprice"], FACTORS)


@query(_SETS + ", q as (select p_partkey, count(*)::int as n, ((sum((x <> x0)::int) > 0)::int + (sum((y <> y0)::int) > 0)::int) / 2 as coverage, avg(abs(x - x0) / (abs(x) + abs(x0) + 1e-6) + abs(y - y0) / (abs(y) + abs(y0) + 1e-6)) as mean_distance, avg(greatest(0.1, 1 - ((x <> x0)::int + (y <> y0)::int) / 2)) as mean_plausibility from e group by 1), d as (select p_partkey, avg(abs(p.x - r.x) / (abs(p.x) + abs(r.x) + 1e-6) + abs(p.y - r.y) / (abs(p.y) + abs(r.y) + 1e-6)) as diversity from e p join e r using (p_partkey) where p.k < r.k group by 1) select p_partkey, n, round(diversity, 6) as diversity, round(coverage, 6) as coverage, round(mean_distance, 6) as mean_distance, round(mean_plausibility, 6) as mean_plausibility from q join d using (p_partkey)")
def counterfactual_quality(spark, sf_dir):
    """Sets of eight alternatives a part: diversity of their pairs, coverage, means."""
    return rounded(explain.set_quality(_sets(spark, sf_dir), "p_partkey", ["p_size", "p_retailprice"]))


@query()
def counterfactual_diverse(spark, sf_dir):
    """Three of the eight alternatives, by greatest distance (a greedy choice, which the tests make plainly)."""
    return explain.diverse(_sets(spark, sf_dir), "p_partkey", ["p_size", "p_retailprice"]).select("p_partkey", F.concat_ws(",", F.transform("chosen", lambda n: n.cast("string"))).alias("chosen"))


@query(_SETS + " select 'p_size' as feature, count(*) filter (where x <> x0) as n from e union all select 'p_retailprice', count(*) filter (where y <> y0) from e")
def counterfactual_features(spark, sf_dir):
    return explain.most_altered(_sets(spark, sf_dir), "p_partkey", ["p_size", "p_retailprice"])


@query(_TOTAL_SQL + f" select {LEVEL.format('statistical_score')} in ('CRITICAL', 'HIGH') or statistical_score > 0.5 as is_anomaly, count(*) as n from t group by 1")
def anomaly_flags(spark, sf_dir):
    s = F.col("statistical_score")
    return statistical_scores(spark, sf_dir).groupBy(explain.is_anomaly(level(s), s).alias("is_anomaly")).agg(F.count(F.lit(1)).alias("n"))


@query("with c as (select p_brand, count(*) as n from part group by 1) select p_brand, n, repeat('#', round(n / (select max(n) from c) * 20)::int) as bar from c")
def importance_bars(spark, sf_dir):
    """Bars of text: parts a brand."""
    c = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("top", c.agg(F.max("n").alias("m")).scalar()).select("p_brand", "n", explain.bar(F.col("n"), F.col("top")).alias("bar"))


@query("with s as (select vec_id, [case when list_max(embedding) = list_min(embedding) then 0.0 else (x::double - list_min(embedding)) / (list_max(embedding)::double - list_min(embedding)) end for x in embedding] as w from embeddings) select vec_id, round(list_sum(w), 4) as total, coalesce(array_to_string([i - 1 for i in range(1, len(w) + 1) if w[i] > 0.7], ','), '') as places from s")
def attention_highlights(spark, sf_dir):
    """Vectors as weights of tokens: scaled, and the places of the heavy ones."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("w"))
    scaled, places = explain.highlights(F.col("w"))
    found = v.select("vec_id", scaled.alias("s"), places.alias("p"))
    return found.select("vec_id", F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.concat_ws(",", F.transform("p", lambda i: i.cast("string"))).alias("places"))


@query("with l as (select vec_id, label, [x::double for x in embedding] as logits from embeddings), s as (select vec_id, label, logits, list_max(logits) as m from l), p as (select vec_id, label, logits[label + 1] - m - ln(list_sum([exp(y - m) for y in logits])) as lp from s), q as (select vec_id, -lp as ce, -lp * case when label = 0 then 1.0 else 2.0 end as weighted from p) select vec_id, round(weighted, 6) as weighted, round(weighted + 0.1 * 0.1, 6) as anomaly, round(0.7 * ce + 0.3 * weighted, 6) as multi_task from q")
def weighted_losses(spark, sf_dir):
    """Class weights, the anomaly loss with its fixed contrastive part, and two tasks brought together."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("logits"))
    return rounded(evaluation.weighted_losses(v, "vec_id", lambda y: F.when(y == 0, 1.0).otherwise(2.0), (0.7, 0.3)))


@query("with l as (select o_custkey, o_orderkey, o_totalprice / 1e5 as loss, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as back from orders) select o_custkey, count(*) as n, round(avg(loss) filter (where back <= 5), 9) as mean from l group by 1")
def loss_history(spark, sf_dir):
    """A history of losses a customer: how many there are, and the mean of the last five."""
    o = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_totalprice") / 1e5).alias("loss"), "o_orderdate", "o_orderkey")
    found = evaluation.last_mean(o, "o_custkey", "loss", ["o_orderdate", "o_orderkey"], 5)
    return found.withColumn("mean", F.round("mean", 9))  # means of numbers of seven places have no halves there
