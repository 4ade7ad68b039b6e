"""Queries of the learner's turn, of processors, feature tables, answers and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions import text as X
from auditloom.operators import explain, features, fusion, learner, processors, quality, semantic, similarity
from auditloom.plans.activity_queries import _COSINE, _NEAR, _samples, _stream, statistical_scores
from auditloom.plans.explain_queries import _SETS, _sets
from auditloom.plans.report_queries import DOCS, rounded
from auditloom.plans.tables import NEGATIVE, POSITIVE, WORDS, reports, table
from auditloom.sources.shared import stash
from auditloom.streaming import monitoring

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_PERF = "select strategy, count(*) as n, count(*) filter (where hit and truth) as tp, count(*) filter (where hit and not truth) as fp, count(*) filter (where not hit and truth) as missed from (select strategy, truth, a * wa + b * wb + c * wc + e * we >= threshold as hit from d cross join {0}) group by 1"
_LEARN = (
    "with d as (select o_orderkey, o_custkey % 100 / 200 + (o_orderstatus = 'F')::int / 2 as a, o_orderkey % 50 / 50 as b, o_orderkey % 20 / 20 as c, o_orderkey % 10 / 20 + (o_orderstatus = 'F')::int / 2 as e, o_orderstatus = 'F' as truth from orders), p as (select 0.8::double as threshold, 0.25::double as wa, 0.25::double as wb, 0.25::double as wc, 0.25::double as we), "
    f"cur as (select 'CURRENT' as strategy, * from p), now as ({_PERF.format('cur')}), leaning as (select least(0.4, we + 0.05) as l from p), whole as (select wa + wb + wc + l as s from p, leaning), "
    "sets as (select * from cur union all select 'THRESHOLDS', case when fp / n > 0.3 then least(0.9, threshold + 0.05) when missed / n > 0.2 then greatest(0.1, threshold - 0.05) else threshold end, wa, wb, wc, we from p, now union all select 'ENSEMBLE', threshold, wa / s, wb / s, wc / s, l / s from p, leaning, whole), "
    f"perf as (select strategy, n, (n - fp - missed) / n as accuracy, case when 2 * tp + fp + missed > 0 then 2 * tp / (2 * tp + fp + missed) else 0.0 end as f1_score, case when n - tp - missed > 0 then fp / (n - tp - missed) else 0.0 end as false_positive_rate from ({_PERF.format('sets')})), "
    "b4 as (select accuracy as ba, f1_score as bf, false_positive_rate as bp from perf where strategy = 'CURRENT'), "
    "g as (select sets.*, n, accuracy, f1_score, false_positive_rate, ((accuracy - ba) / greatest(ba, 0.001) + 0.8 * (f1_score - bf) / greatest(bf, 0.001) + 0.6 * (bp - false_positive_rate) / greatest(bp, 0.001)) / 3 as improvement, accuracy > ba and f1_score > bf and false_positive_rate < bp as better from sets join perf using (strategy) cross join b4), "
    "q as (select *, least(1.0, greatest(0.0, least(1.0, improvement + 0.5)) * case when better then 1.2 else 1.0 end) as confidence from g), best as (select coalesce((select strategy from q where strategy <> 'CURRENT' and improvement > 0 and confidence >= 0.6 order by improvement desc, strategy limit 1), 'CURRENT') as best)"
)


def _turn(spark, sf_dir):
    k, hit = F.col("o_orderkey"), (F.col("o_orderstatus") == "F").cast("int")
    d = table(spark, sf_dir, "orders").select(k, (F.col("o_custkey") % 100 / 200 + hit / 2).alias("statistical"), (k % 50 / 50).alias("behavioral"), (k % 20 / 20).alias("market"), (k % 10 / 20 + hit / 2).alias("semantic"), (F.col("o_orderstatus") == "F").alias("truth"))
    now = _first(spark).drop("version")
    return learner.tried(d, now, "PERFORMANCE_DEGRADATION")


def _first(spark):
    return spark.range(1).select(F.lit(0).alias("version"), F.lit(0.8).alias("threshold"), *[F.lit(0.25).alias(f"weight_{f}") for f in learner.FAMILIES])


@query(_LEARN + " select strategy, round(threshold, 6) as threshold, round(accuracy, 6) as accuracy, round(f1_score, 6) as f1_score, round(false_positive_rate, 6) as false_positive_rate, round(improvement, 6) as improvement, round(confidence, 6) as confidence, strategy = best as chosen from q, best")
def learner_run(spark, sf_dir):
    """Orders as judged detections: every strategy for falling performance is tried, the best kept."""
    return rounded(_turn(spark, sf_dir).select("strategy", "threshold", "accuracy", "f1_score", "false_positive_rate", "improvement", "confidence", "chosen"))


@query(_LEARN + ", v1 as (select 1 as version, threshold, we from q, best where strategy = best and best <> 'CURRENT'), h as (select 0 as version, threshold, we from p union all select * from v1), r as (select * from h union all select (select max(version) from h) + 1, threshold, we from h where version = (select max(version) from h) - 1) select version::int as version, round(threshold, 6) as threshold, round(we, 6) as weight_semantic from r")
def parameter_versions(spark, sf_dir):
    """The sets of parameters: the first, the one that the turn chose, and the way back."""
    chosen = learner.applied(_first(spark), _turn(spark, sf_dir))
    return rounded(learner.rolled_back(chosen).select("version", "threshold", "weight_semantic"))


#: Words that occur in the tables stand for those that answers name.
STAND_INS = {
    "source": ((("copyright",), 0.9), (("und ",), 0.6), (("que ",), 0.3), ((), 0.1)),
    "consistency": ((("licen",), 0.9), (("der ",), 0.7), (("les ",), 0.5), (("the ",), 0.2), ((), 0.1)),
    "sentiment_analysis": ((("the ", "positive"), ("positive", 0.8)), (("que ", "negative"), ("negative", 0.8)), ((), ("neutral", 0.6))),
}


@query(
    "with d as (select doc_id as report_id, lower(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) as t from documents) select report_id, case when contains(t, 'copyright') then 0.9 when contains(t, 'und ') then 0.6 when contains(t, 'que ') then 0.3 else 0.1 end::double as source, case when contains(t, 'licen') then 0.9 when contains(t, 'der ') then 0.7 when contains(t, 'les ') then 0.5 when contains(t, 'the ') then 0.2 else 0.1 end::double as consistency, "
    "case when contains(t, 'the ') or contains(t, 'positive') then 'positive' when contains(t, 'que ') or contains(t, 'negative') then 'negative' else 'neutral' end as sentiment, case when contains(t, 'the ') or contains(t, 'positive') or contains(t, 'que ') or contains(t, 'negative') then 0.8 else 0.6 end::double as sure, case when contains(t, 'anomaly') then 'anomaly' when contains(t, 'suspicious') then 'suspicious' else 'normal' end as anomaly, case when contains(t, 'aggressive') then 'aggressive' when contains(t, 'conservative') then 'conservative' else 'neutral' end as style from d"
)
def answer_parsing(spark, sf_dir):
    """Texts as answers to five tasks."""
    said = lambda task, table=semantic.ANSWERS: semantic.answer(F.col("content"), task, table)
    stand_in = lambda task: said(task, STAND_INS)
    return reports(spark, sf_dir).select(
        "report_id", stand_in("source").alias("source"), stand_in("consistency").alias("consistency"), stand_in("sentiment_analysis")["label"].alias("sentiment"), stand_in("sentiment_analysis")["confidence"].alias("sure"), said("anomaly_pre_detection")["label"].alias("anomaly"), said("style_recognition")["label"].alias("style")
    )


@query("with d as (select trim(coalesce(text, '')) <> '' as ok from documents), p(processor) as (values ('text_cleaning'), ('quality_check'), ('feature_extraction'), ('languages')) select processor, count(*) as total, count(*) filter (where ok) as successful, count(*) filter (where not ok) as failed, round(count(*) filter (where ok) / count(*), 6) as success_rate from d, p where processor <> 'languages' group by 1 union all select 'languages', count(*), count(lang), count(*) - count(lang), round(count(lang) / count(*), 6) from documents")
def processor_results(spark, sf_dir):
    """Registered processors over all records, one of them our own: a result row each, and their summary."""
    known = processors.standard()
    known.register("languages", lambda df: F.upper("lang"))
    return rounded(processors.summary(known.run(reports(spark, sf_dir), "report_id", ["text_cleaning", "quality_check", "feature_extraction", "languages"])))


def _feature_table(spark, sf_dir):
    r = reports(spark, sf_dir)
    t = features.text_features(r, POSITIVE, NEGATIVE, WORDS.sentence_end)
    k, ts = F.col("report_id"), F.timestamp_seconds(F.lit(1704067200) + F.pmod("report_id", F.lit(720)) * 3600)
    flags = [F.pmod("report_id", F.lit(2)) == 0, F.weekday(ts) < 5, (F.weekday(ts) < 5) & F.hour(ts).between(9, 14)]
    made = features.engineered(k % 4, (k % 5) / 4, (k % 7 * 10).cast("double"), (k % 3 * 10).cast("double"), flags)
    return t.select("report_id", "char_count", "word_count", "sentence_count", "unique_ratio", *[made[n].alias(n) for n in ("content_per_stock", "price_change", "relative_price_change", "timeliness")])


@query(DOCS + r", f as (select report_id, length(content)::double as char_count, len(words)::double as word_count, len(regexp_split_to_array(content, '[.!?]'))::double as sentence_count, case when len(words) = 0 then 0.0 else len(list_distinct(words)) / len(words) end::double as unique_ratio, (length(content) / greatest(report_id % 4, 1))::double as content_per_stock, case when report_id % 3 > 0 then abs(report_id % 7 * 10 - report_id % 3 * 10) end::double as price_change, case when report_id % 3 > 0 then abs(report_id % 7 * 10 - report_id % 3 * 10) / (report_id % 3 * 10) end::double as relative_price_change, (((report_id % 2 = 0)::int + (w < 5)::int + (w < 5 and h between 9 and 14)::int) / 3)::double as timeliness from (select *, (isodow(ts) - 1) as w, hour(ts) as h from (select *, timestamp '2024-01-01' + (report_id % 720)::int * interval 1 hour as ts from d))), u as (unpivot f on columns(* exclude report_id) into name feature value value) select feature, count(value) as n, round(avg(value), 4) as mean, round(stddev_pop(value), 4) as std, round(min(value), 4) as least, round(max(value), 4) as greatest from u group by 1")
def feature_statistics(spark, sf_dir):
    """A feature table of text, price and time, and the statistics of each of its features."""
    found = features.feature_statistics(_feature_table(spark, sf_dir), "report_id")
    return found.select("feature", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "least", "greatest")])


@query("with u as (select p_partkey, ('0x' || substring(md5('42:' || p_partkey::varchar), 1, 8))::bigint / 4294967296.0 as u from part) select case when u < 0.7 then 'train' when u < 0.7 + 0.2 then 'validation' else 'test' end as part, count(*) as n, sum(p_partkey)::bigint as ids from u group by 1")
def training_split(spark, sf_dir):
    return features.split(table(spark, sf_dir, "part"), "p_partkey").groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("p_partkey").alias("ids"))


@query("with r as (select o_orderkey as id, c_name, o_orderpriority, o_clerk_date, o_orderstatus, c_mktsegment from (select *, o_orderdate::date::varchar as o_clerk_date from orders) join customer on c_custkey = o_custkey) select o_orderpriority as rating, c_mktsegment as institution, count(*) as n, count(distinct c_name) as titles, max(o_orderstatus || ' ' || c_mktsegment) as logic, min(o_clerk_date) as first_date, '' as missing from r group by 1, 2")
def record_features(spark, sf_dir):
    """Orders as parsed reports: texts, categories and what is said of the file, read by path."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    basic = F.struct(F.col("c_name").alias("title"), F.col("c_mktsegment").alias("institution"), F.col("o_orderdate").cast("date").cast("string").alias("publish_date"))
    record = F.struct(basic.alias("basic_info"), F.struct(F.col("o_orderpriority").alias("rating")).alias("investment_advice"), F.struct(F.array("o_orderstatus", "c_mktsegment").alias("main_logic")).alias("core_content"))
    parsed = o.select(F.col("o_orderkey").alias("id"), F.parse_json(F.to_json(record)).alias("data"))
    f = features.record_features(parsed, "id")
    return f.groupBy(F.col("categories.rating").alias("rating"), F.col("categories.institution").alias("institution")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("texts.title").alias("titles"), F.max("texts.main_logic").alias("logic"), F.min("meta.publish_date").alias("first_date"), F.max("texts.risk_warning").alias("missing")
    )


_COMPARED = _SETS + ", m as (select p_partkey, k as number, concat_ws(',', case when x <> x0 then 'p_size' end, case when y <> y0 then 'p_retailprice' end) as changed, abs(x - x0) / (abs(x) + abs(x0) + 1e-6) + abs(y - y0) / (abs(y) + abs(y0) + 1e-6) as distance, greatest(0.1, 1 - ((x <> x0)::int + (y <> y0)::int) / 2) as plausibility, x * y - x0 * y0 as score_change from e)"


@query(_COMPARED + " select p_partkey, number::int as number, changed, round(distance, 6) as distance, round(plausibility, 6) as plausibility, round(score_change, 3) as score_change from m")
def counterfactual_comparison(spark, sf_dir):
    """Every alternative beside its original."""
    found = explain.comparison(_sets(spark, sf_dir), "p_partkey", ["p_size", "p_retailprice"], lambda f: f["p_size"] * f["p_retailprice"])
    return found.select("p_partkey", "number", "changed", F.round("distance", 6).alias("distance"), F.round("plausibility", 6).alias("plausibility"), F.round("score_change", 3).alias("score_change"))


@query(_COMPARED + ", c as (select p_partkey, f, count(*) as c from (select p_partkey, unnest(string_split(changed, ',')) as f from m) where f <> '' group by 1, 2), l as (select p_partkey, string_agg(f, ',' order by c desc, f) as most_changed from (select *, row_number() over (partition by p_partkey order by c desc, f) as r from c) where r <= 3 group by 1) select p_partkey, n, round(mean_change, 3) as mean_change, round(mean_plausibility, 6) as mean_plausibility, coalesce(most_changed, '') as most_changed from (select p_partkey, count(*) as n, avg(score_change) as mean_change, avg(plausibility) as mean_plausibility from m group by 1) left join l using (p_partkey)")
def counterfactual_report(spark, sf_dir):
    compared = explain.comparison(_sets(spark, sf_dir), "p_partkey", ["p_size", "p_retailprice"], lambda f: f["p_size"] * f["p_retailprice"])
    return explain.comparison_summary(compared, "p_partkey").withColumns({"mean_change": F.round("mean_change", 3), "mean_plausibility": F.round("mean_plausibility", 6)})


@query(_NEAR.format(_COSINE) + ", k as (select * from r where rank <= case when same_class then 5 else 3 end) select target, row_number() over (partition by target order by same_class desc, rank)::int as place, case when same_class then 'similar' else 'contrasting' end as section, id as sample, printf('%d. %s %.3f', rank, id::varchar, similarity) as text from k")
def similarity_report(spark, sf_dir):
    return explain.similarity_report(similarity.nearest(*_samples(spark, sf_dir)))


@query(r"select doc_id as report_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>', '', 'g'), 'https?://[^\s<>\x22'']+', '', 'g'), '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z|]{2,}\b', '', 'g'), '\s+', ' ', 'g'), '[^\p{L}\p{N}_\s.,!?;:()（）【】“”‘’《》、。，！？；：]', '', 'g'), '\b\d{10,}\b', '', 'g'))) as digest from documents")
def clean_basic(spark, sf_dir):
    return reports(spark, sf_dir).select("report_id", F.md5(X.basic_clean(F.col("content")).cast("binary")).alias("digest"))


@query(DOCS + ", j as (select a.report_id, list_distinct(a.words) as w, list_distinct(b.words) as v from d a join d b on b.report_id = a.report_id + 1) select report_id, round(case when len(w) = 0 or len(v) = 0 then 0.0 else len(list_intersect(w, v)) / (sqrt(len(w)) * sqrt(len(v))) end, 6) as similarity from j")
def word_set_cosine(spark, sf_dir):
    """The words of each document against those of the next."""
    p = reports(spark, sf_dir).select("report_id", X.tokens(F.col("content")).alias("w"))
    after = p.select((F.col("report_id") - 1).alias("report_id"), F.col("w").alias("v"))
    return rounded(p.join(after, "report_id").select("report_id", X.set_cosine(F.col("w"), F.col("v")).alias("similarity")))


@query("select feedback_type, is_valid, count(*) as n from (select feedback_type, rating between 1 and 10 and not (feedback_type = 'INCORRECT' and is_correct) as is_valid from (select doc_id as report_id, coalesce(quality = 1, false) as is_correct, case when toxic = 1 then 'INCORRECT' else 'CORRECT' end as feedback_type, doc_id % 12 as rating from labels)) group by 1, 2")
def valid_feedback(spark, sf_dir):
    f = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("report_id"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("is_correct"), F.when(F.col("toxic") == 1, "INCORRECT").otherwise("CORRECT").alias("feedback_type"), (F.col("doc_id") % 12).alias("rating"))
    return f.groupBy("feedback_type", quality.feedback_valid(f).alias("is_valid")).agg(F.count(F.lit(1)).alias("n"))


_SESSIONS = "with e as (select user_id as author, ts, lag(ts) over (partition by user_id order by ts) as before from events), s as (select author, ts, sum((before is null or ts >= before + interval 30 minute)::int) over (partition by author order by ts) as s from e)"


@query(_SESSIONS + " select author, epoch_us(min(ts)) as start, epoch_us(max(ts)) + 1800000000 as \"end\", count(*) as n from s group by author, s.s")
def author_sessions(spark, sf_dir):
    """The stream's sessions: an author's events less than half an hour apart."""
    found = monitoring.run_once(monitoring.sessions(_stream(spark, sf_dir)), "sessions", "complete")
    return found.select("author", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


@query("with e as (select event_type as metric, ts::date as day from events), x as (select metric, day + k::int as until from e, range(1, 8) r(k)) select metric, epoch_us(until::timestamp) as until, count(*) as n from x group by 1, 2")
def trailing_events(spark, sf_dir):
    """The stream's counts of the last seven days, at the end of every day."""
    found = monitoring.run_once(monitoring.trailing_counts(_stream(spark, sf_dir), 7), "trailing", "complete")
    return found.select("metric", F.unix_micros("until").alias("until"), "n")


@query()
def fusion_with_views(spark, sf_dir):
    """Two families fused, the semantic one with each document's deviation from the five documents of its source before
    it (the tests have a plain version)."""
    r = reports(spark, sf_dir)
    told = stash(r.select("report_id", F.col("author").alias("key"), "ts", X.sentiment(X.tokens(F.col("content")), POSITIVE, NEGATIVE).alias("s"), semantic.view_summary(F.col("content"), POSITIVE + NEGATIVE, end=WORDS.sentence_end).alias("summary")).where("key is not null"), "told")
    views = told.select("key", F.col("report_id").cast("string").alias("view_id"), F.col("ts").alias("view_ts"), F.col("summary").alias("view_summary"), F.col("s").alias("view_s"))
    near = semantic.recent_views(told.withColumn("report_id", F.col("report_id").cast("string")), views)
    deviation = semantic.deviation_score(near).select(F.col("report_id").cast("long").alias("report_id"), F.col("score").alias("deviation"), "n_views")
    meant = semantic.total(semantic.rules(r, WORDS).join(deviation, "report_id", "left")).select("report_id", F.col("semantic_score").alias("semantic"), F.coalesce("deviation", F.lit(0.0)).alias("deviation"), F.coalesce("n_views", F.lit(0)).alias("n_views"))
    both = statistical_scores(spark, sf_dir).select("report_id", F.col("statistical_score").alias("statistical")).join(meant, "report_id")
    none = F.lit(None).cast("double")
    return rounded(fusion.fuse(both.withColumns({"behavioral": none, "market": none})).select("report_id", "statistical", "semantic", "deviation", "n_views", "score"))
