"""Queries over documents as reports: statistics, novelty, sentiment, numbers, cleaning, quality, rules, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions import text as X
from auditloom.functions.scalars import level, parse_date, parse_number, stock_code
from auditloom.operators import behavioral, cleaning, features, learning, quality, semantic, statistical
from auditloom.plans.tables import NEGATIVE, NUMBERS, POSITIVE, WORDS, reports, table
from auditloom.sources.shared import stash

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def rounded(df, *keep):
    """Doubles to six places; the named columns first."""
    return df.select(*[F.round(f.name, 6).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


TOKENS = r"[w for w in regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+') if length(w) > 1 and not regexp_full_match(w, '\p{Nd}+')]"
DOCS = rf"with d as (select doc_id as report_id, coalesce(text, '') as content, source as author, lang, {TOKENS} as words from documents)"
LEVEL = "case when {0} >= 0.8 then 'CRITICAL' when {0} >= 0.6 then 'HIGH' when {0} >= 0.4 then 'MEDIUM' when {0} >= 0.2 then 'LOW' else 'NORMAL' end"
_LENGTH_SQL = DOCS + ", b as (select avg(length(content)) as m, stddev_pop(length(content)) as s from d), length_part as (select report_id, length(content) as length, abs(length(content) - m) / greatest(s, 1e-6) as z from d, b)"
_NOVELTY_SQL = ", u as (select report_id, unnest(list_distinct(words)) as word from d), v as (select word from (select unnest(words) as word from d) group by 1 having count(*) > 1), novelty_part as (select d.report_id, count(u.word) as n_unique, count(u.word) filter (where v.word is null) as n_new from d left join u on d.report_id = u.report_id left join v on u.word = v.word group by 1)"
_SENTIMENT_SQL = f", f as (select report_id, case when len(words) = 0 then 0.0 else (len([w for w in words if w in {_in(POSITIVE)}]) - len([w for w in words if w in {_in(NEGATIVE)}]))::double / len(words) end as sentiment_score from d), fb as (select avg(sentiment_score) as m, stddev_pop(sentiment_score) as s from f), sentiment_part as (select report_id, sentiment_score, abs(sentiment_score - m) / greatest(s, 1e-6) as z from f, fb)"
_NUMBER_SQL = r", x as (select report_id, unnest(regexp_extract_all(content, '(\d+\.?\d*)', 1))::double as value from d), xb as (select quantile_cont(value, 0.05) as p5, quantile_cont(value, 0.95) as p95 from x), number_part as (select d.report_id, count(value) as n_numbers, coalesce(max(case when value < p5 then least((p5 - value) / greatest(abs(p5), 1e-6), 1) when value > p95 then least((value - p95) / greatest(abs(p95), 1e-6), 1) when value is not null then 0.0 end), 0.0) as score from d left join x on d.report_id = x.report_id cross join xb group by 1)"


def _length(r):
    return statistical.length_anomaly(r, statistical.describe(r.select(F.length("content").alias("n")), "n", ()))


def _sentiment(r):
    scored = statistical.with_sentiment(r, POSITIVE, NEGATIVE)
    return statistical.sentiment_anomaly(scored, statistical.describe(scored, "sentiment_score", ()))


def _numbers(r):
    return statistical.number_anomaly(r, statistical.describe(statistical.number_values(r, NUMBERS), "value", (0.05, 0.95)), NUMBERS)


@query(_LENGTH_SQL + " select report_id, length, round(z, 6) as z, round(least(z / 2, 1), 6) as score, z > 2 as is_anomaly from length_part")
def length_anomaly(spark, sf_dir):
    return rounded(_length(reports(spark, sf_dir)))


@query(DOCS + _NOVELTY_SQL + " select report_id, n_unique, n_new, round(n_new / greatest(n_unique, 1), 6) as ratio, round(least(n_new / greatest(n_unique, 1) / 0.15, 1), 6) as score, n_new / greatest(n_unique, 1) > 0.15 as is_anomaly from novelty_part")
def vocab_novelty(spark, sf_dir):
    return rounded(statistical.self_novelty(reports(spark, sf_dir)))


@query(DOCS + _SENTIMENT_SQL + " select report_id, round(sentiment_score, 5) as sentiment_score, round(z, 6) as z, round(least(z / 2.5, 1), 6) as score, z > 2.5 as is_anomaly from sentiment_part")
def sentiment_anomaly(spark, sf_dir):
    return rounded(_sentiment(reports(spark, sf_dir)).withColumn("sentiment_score", F.round("sentiment_score", 5)))


@query(DOCS + _SENTIMENT_SQL + " select lang, count(*) as n, round(avg(sentiment_score), 6) as mean, round(stddev_pop(sentiment_score), 6) as std from f join d using (report_id) group by 1")
def sentiment_stats(spark, sf_dir):
    scored = statistical.with_sentiment(reports(spark, sf_dir), POSITIVE, NEGATIVE)
    return rounded(scored.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg("sentiment_score").alias("mean"), F.stddev_pop("sentiment_score").alias("std")))


@query(DOCS + _NUMBER_SQL + " select report_id, n_numbers, round(score, 6) as score, score > 0.5 as is_anomaly from number_part")
def numeric_outliers(spark, sf_dir):
    return rounded(_numbers(reports(spark, sf_dir)))


_TOTAL_SQL = _LENGTH_SQL + _NOVELTY_SQL + _SENTIMENT_SQL + _NUMBER_SQL + ", t as (select report_id, least(a.z / 2, 1) as length_score, least(b.n_new / greatest(b.n_unique, 1) / 0.15, 1) as novelty_score, least(c.z / 2.5, 1) as sentiment_part, e.score as number_score, 0.2 * least(a.z / 2, 1) + 0.3 * least(b.n_new / greatest(b.n_unique, 1) / 0.15, 1) + 0.3 * least(c.z / 2.5, 1) + 0.2 * e.score as statistical_score from length_part a join novelty_part b using (report_id) join sentiment_part c using (report_id) join number_part e using (report_id))"


def statistical_scores(spark, sf_dir, keep=()):
    r = reports(spark, sf_dir)
    return statistical.scores(statistical.row_features(r, keep, POSITIVE, NEGATIVE, NUMBERS), statistical.hapaxes(r))


@query(_TOTAL_SQL + " select report_id, round(length_score, 6) as length_score, round(novelty_score, 6) as novelty_score, round(sentiment_part, 6) as sentiment_part, round(number_score, 6) as number_score, round(statistical_score, 6) as statistical_score from t")
def statistical_score(spark, sf_dir):
    return rounded(statistical_scores(spark, sf_dir).select("report_id", "length_score", "novelty_score", "sentiment_part", "number_score", "statistical_score"))


@query(_TOTAL_SQL + f" select lang, {LEVEL.format('statistical_score')} as level, count(*) as n, round(avg(statistical_score), 6) as mean_score from t join d using (report_id) group by 1, 2")
def level_by_lang(spark, sf_dir):
    scored = statistical_scores(spark, sf_dir, ["lang"])
    return rounded(scored.groupBy("lang", level(F.col("statistical_score")).alias("level")).agg(F.count(F.lit(1)).alias("n"), F.avg("statistical_score").alias("mean_score")))


@query(DOCS + r", s as (select *, [x for x in [trim(y, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) for y in regexp_split_to_array(content, '[。！？；\n]')] if x <> ''] as sents from d) select report_id, length(content) as char_count, len(words)::int as word_count, len(sents)::int as sentence_count, round(case when len(words) = 0 then 0.0 else list_sum([length(w) for w in words]) / len(words) end, 6) as avg_word_length, round(case when len(sents) = 0 then 0.0 else len(words) / len(sents) end, 6) as avg_sentence_length, round(case when len(words) = 0 then 0.0 else len(list_distinct(words)) / len(words) end, 6) as unique_word_ratio, len(list_distinct(words))::int as unique_word_count from s")
def text_stats(spark, sf_dir):
    return rounded(reports(spark, sf_dir).select("report_id", *[v.alias(k) for k, v in X.text_stats(F.col("content")).items()]).withColumn("char_count", F.col("char_count").cast("long")))


@query(DOCS + r", s as (select report_id, words, [x for x in [trim(y, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) for y in regexp_split_to_array(content, '[。！？；\n]')] if x <> ''] as sents from d) select report_id, round(least((0.6 * (case when len(sents) = 0 then 0.0 else len(words) / len(sents) end) + 0.4 * (case when len(words) = 0 then 0.0 else list_sum([length(w) for w in words]) / len(words) end)) / 10, 1), 6) as readability from s")
def readability(spark, sf_dir):
    s = X.text_stats(F.col("content"))
    return rounded(reports(spark, sf_dir).select("report_id", s["avg_sentence_length"].alias("a"), s["avg_word_length"].alias("w")).select("report_id", X.readability(F.col("a"), F.col("w")).alias("readability")))


_WRITING = DOCS + r", s as (select report_id, [x for x in [trim(y, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) for y in regexp_split_to_array(content, '[.!?]')] if x <> ''] as sents, [x for x in [trim(y, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) for y in string_split(content, chr(10))] if x <> ''] as paras from d), w as (select report_id, len(sents)::int as n_sentences, case when len(sents) = 0 then 0.0 else list_sum([length(x) for x in sents]) / len(sents) end as mean_sentence, len(paras)::int as n_paragraphs from s)"


@query(_WRITING + " select report_id, n_sentences, round(mean_sentence, 6) as mean_sentence, n_paragraphs from w")
def writing_features(spark, sf_dir):
    return rounded(behavioral.writing_features(reports(spark, sf_dir), WORDS.sentence_end))


@query(_WRITING + ", b as (select avg(mean_sentence) as m1, stddev_pop(mean_sentence) as s1, avg(n_paragraphs) as m2, stddev_pop(n_paragraphs) as s2 from w), z as (select w.*, abs(mean_sentence - m1) / s1 as z1, abs(n_paragraphs - m2) / s2 as z2 from w, b), p as (select *, greatest(case when z1 > 2 then least(z1 / 2 - 1, 1) else 0.0 end, case when z2 > 2 then least(z2 / 2 - 1, 1) else 0.0 end) as score from z) select report_id, round(mean_sentence, 6) as mean_sentence, n_paragraphs, round(score, 6) as score, score > 0 as is_anomaly from p")
def writing_anomaly(spark, sf_dir):
    w = behavioral.writing_features(reports(spark, sf_dir), WORDS.sentence_end)
    return rounded(behavioral.writing_anomaly(w, behavioral.writing_baseline(w)))


@query(DOCS + ", c as (select report_id, word, count(*) as tf from (select report_id, unnest(words) as word from d) group by 1, 2), i as (select word, ln((select count(*) from d) / count(*)) as idf from c group by 1), k as (select report_id, c.word, tf, tf * idf as weight, row_number() over (partition by report_id order by tf * idf desc, c.word) as rank from c join i using (word)) select report_id, word, tf, round(weight, 6) as weight, rank::int as rank from k where rank <= 5")
def keyword_topk(spark, sf_dir):
    return rounded(statistical.keywords(reports(spark, sf_dir), 5))


_STRIPPED = "regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace({0}, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '<[^>]+>', '', 'g'), '&[a-zA-Z0-9#]+;', '', 'g')"


@query("select page_id, md5(" + _STRIPPED.format("html") + ") as digest from pages")
def clean_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(X.strip_tags(F.col("html")).cast("binary")).alias("digest"))


@query(r"select doc_id as report_id, length(regexp_replace(coalesce(text, ''), '(\d{3,4}[-\s]?\d{7,8})|(\w+@\w+\.\w+)|(www\.\w+\.\w+)', '', 'g')) as length_after, md5(regexp_replace(coalesce(text, ''), '(\d{3,4}[-\s]?\d{7,8})|(\w+@\w+\.\w+)|(www\.\w+\.\w+)', '', 'g')) as digest from documents")
def clean_contacts(spark, sf_dir):
    return reports(spark, sf_dir).select("report_id", X.without_contacts(F.col("content")).alias("t")).select("report_id", F.length("t").cast("long").alias("length_after"), F.md5(F.col("t").cast("binary")).alias("digest"))


@query("select doc_id as report_id, md5(array_to_string([s for s in string_split(coalesce(text, ''), '.') if not regexp_matches(s, '(?i)license|copyright|rights')], '.')) as digest from documents")
def clean_sentences(spark, sf_dir):
    return reports(spark, sf_dir).select("report_id", F.md5(F.array_join(F.filter(F.split("content", r"\."), lambda s: ~s.rlike(WORDS.disclaimer)), ".").cast("binary")).alias("digest"))


@query()
def dedup_sentences(spark, sf_dir):
    return reports(spark, sf_dir).select("report_id", F.md5(X.without_repeats(F.col("content"), ".").cast("binary")).alias("digest"))


@query()
def clean_full(spark, sf_dir):
    cleaned = reports(spark, sf_dir).select("report_id", "content", X.clean(F.col("content")).alias("cleaned"))
    found = cleaned.withColumn("issues", X.issues(F.col("cleaned")))
    return found.select("report_id", F.length("cleaned").alias("length_after"), F.concat_ws(",", "issues").alias("issues"), X.clean_quality(F.col("content"), F.col("cleaned"), F.col("issues")).alias("quality"))


def _cleaned(spark, sf_dir):
    return cleaning.stepwise(reports(spark, sf_dir), "report_id")


def _cleaned_pages(spark, sf_dir):
    return cleaning.stepwise(table(spark, sf_dir, "pages"), "page_id", "html")


@query("with t as (select html, " + _STRIPPED.format("html") + r" as plain from pages where html <> '') select count(*) as total_processed, count(*) as total_cleaned, 1.0::double as cleaning_rate, round(avg((length(plain) < length(html))::int), 6) as html_removal_rate, round(avg(regexp_matches(plain, '[\x{10000}-\x{10FFFF}]')::int), 6) as encoding_fix_rate from t")
def clean_statistics(spark, sf_dir):
    """All pages cleaned and written, and the statistics of it from the same reading (the tests hold the shares that SQL
    cannot express against a plain version)."""
    rows, seen = cleaning.observed(_cleaned_pages(spark, sf_dir))
    stash(rows.drop("original"), "cleaned")
    told = cleaning.statistics(seen)
    names = ["total_processed", "total_cleaned", "cleaning_rate", "html_removal_rate", "encoding_fix_rate"]
    return rounded(spark.createDataFrame([tuple(told[n] for n in names)], ", ".join(f"{n} {'long' if n.startswith('total') else 'double'}" for n in names)))


@query()
def clean_steps(spark, sf_dir):
    """The steps that changed each text, what is wrong with it afterwards, its quality."""
    return rounded(_cleaned(spark, sf_dir).select("report_id", F.concat_ws(",", "steps").alias("steps"), F.concat_ws(",", "issues").alias("issues"), "quality", "length_reduction", "reduction_ratio", F.md5(F.col("cleaned").cast("binary")).alias("digest")))


@query(DOCS + r", t as (select report_id, [w for w in regexp_split_to_array(content, '[ \t\n\x0B\f\r]+') if w <> ''] as ws from d), c as (select report_id, word, count(*) as n from (select report_id, unnest(ws) as word from t) group by 1, 2) select t.report_id, round(coalesce(max(n) / any_value(len(ws)), 0.0), 6) as top_share from t left join c using (report_id) group by 1")
def repetition(spark, sf_dir):
    words = F.filter(F.split("content", r"\s+"), lambda w: w != "")
    return rounded(reports(spark, sf_dir).select("report_id", words.alias("w")).select("report_id", X.top_share(F.col("w")).alias("top_share")))


_BENCH = r"with b as (select item_id, list_distinct([w for w in regexp_extract_all(text, '[\p{L}\p{N}_]+') if length(w) > 1 and not regexp_full_match(w, '\p{Nd}+')]) as ws from benchmark), bw as (select item_id, len(ws) as n, unnest(ws) as word from b), " + DOCS.removeprefix("with ") + ", dw as (select report_id, len(list_distinct(words)) as m, unnest(list_distinct(words)) as word from d), p as (select item_id, report_id, any_value(n) as n, any_value(m) as m, count(*) as shared from bw join dw using (word) group by 1, 2), r as (select *, shared / (n + m - shared) as jaccard, row_number() over (partition by item_id order by shared / (n + m - shared) desc, report_id) as rank from p)"


@query(_BENCH + " select item_id, report_id, shared, round(jaccard, 6) as jaccard from r where rank = 1")
def benchmark_overlap(spark, sf_dir):
    """The most similar document of each benchmark item by word Jaccard. Items are a small table: words that no item has are
    dropped before anything is shuffled."""
    from pyspark.sql import Window

    def words(df, key):
        listed = df.select(key, F.array_distinct(X.tokens(F.col("content"))).alias("ws"))
        return listed.select(key, F.size("ws").alias("size"), F.explode("ws").alias("word"))

    items = words(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("content")), "item_id").withColumnRenamed("size", "n")
    docs = words(reports(spark, sf_dir), "report_id").withColumnRenamed("size", "m")
    pairs = docs.join(items, "word").groupBy("item_id", "report_id").agg(F.min("n").alias("n"), F.min("m").alias("m"), F.count(F.lit(1)).alias("shared"))
    scored = pairs.withColumn("jaccard", F.col("shared") / (F.col("n") + F.col("m") - F.col("shared")))
    best = scored.groupBy("item_id").agg(F.max_by(F.struct("report_id", "shared", "jaccard"), F.struct("jaccard", (-F.col("report_id")).alias("k"))).alias("b"))
    return rounded(best.select("item_id", "b.*"))


_FLAGS = r"with q as (select doc_id as report_id, coalesce(text, '') as content, source from documents), s as (select report_id, (1 - ((content = '')::int + (source is null or trim(source) = '')::int) / 3) * case when length(content) > 0 and (length(content) < 100 or length(content) > 100000) then 0.9 else 1.0 end as completeness, greatest(0.0, 1 - 0.1 * coalesce(regexp_matches(content, '[。！？.!?]{3,}'), false)::int) as accuracy, case when date_diff('day', date '2024-01-01' + (report_id % 720)::int * interval 1 day, timestamp '2025-06-01') > 365 then greatest(0.0, 1 - (date_diff('day', date '2024-01-01' + (report_id % 720)::int * interval 1 day, timestamp '2025-06-01') - 365) / 365) else 1.0 end as timeliness, (date '2024-01-01' + (report_id % 720)::int * interval 1 day > timestamp '2025-06-02') as late, length(content) < 200 as has_issue from q), z as (select report_id, completeness, 1 - 0.1 * late::int as consistency, accuracy, timeliness, 0.3 * completeness + 0.25 * (1 - 0.1 * late::int) + 0.25 * accuracy + 0.1 * timeliness + 0.1 as score, has_issue from s)"
_QLEVEL = "case when round(score, 9) >= 0.9 then 'EXCELLENT' when round(score, 9) >= 0.8 then 'GOOD' when round(score, 9) >= 0.6 then 'FAIR' when round(score, 9) >= 0.4 then 'POOR' else 'UNACCEPTABLE' end"


def _quality(spark, sf_dir):
    r = reports(spark, sf_dir).withColumns({"title": F.lit("report"), "publish_date": F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("report_id", F.lit(720)).cast("int")), "yyyy-MM-dd")})
    return quality.check(r, F.lit("2025-06-01").cast("timestamp"))


@query(_FLAGS + " select report_id, round(completeness, 6) as completeness, round(consistency, 6) as consistency, round(accuracy, 6) as accuracy, round(timeliness, 6) as timeliness, round(score, 6) as score, round(score, 9) >= 0.6 and not has_issue as passed from z")
def quality_scores(spark, sf_dir):
    return rounded(_quality(spark, sf_dir).select("report_id", "completeness", "consistency", "accuracy", "timeliness", "score", "passed"))


@query(_FLAGS + f" select {_QLEVEL} as level, count(*) as n, round(avg(score), 6) as mean_score, round(avg((round(score, 9) >= 0.6 and not has_issue)::int), 6) as pass_rate from z group by 1")
def quality_statistics(spark, sf_dir):
    checked = _quality(spark, sf_dir)
    return rounded(quality.statistics(checked))


@query("select report_id, sum_, round(case when n = 0 then 0 else sum_ / n end, 6) as mean from (select doc_id as report_id, len(regexp_extract_all(coalesce(text, ''), '[0-9]')) as n, list_sum([x::bigint for x in regexp_extract_all(coalesce(text, ''), '[0-9]')])::bigint as sum_ from documents)")
def digit_sums(spark, sf_dir):
    digits = F.regexp_extract_all("content", F.lit("([0-9])"), F.lit(1))
    total = F.aggregate(digits, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    return rounded(reports(spark, sf_dir).select("report_id", F.when(F.size(digits) > 0, total).alias("sum_"), X.ratio(total, F.size(digits)).alias("mean")))


def _has(words, column="content") -> str:
    return "(" + " + ".join(f"contains({column}, '{w}')::int" for w in words) + ")"


_RULES = (
    DOCS
    + r", s as (select report_id, content, [x for x in [trim(y, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) for y in regexp_split_to_array(content, '[.!?]')] if length(x) > 5] as sents, [x for x in [trim(y, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) for y in string_split(content, chr(10))] if x <> ''] as paras from d), "
    + f"c as (select report_id, content, least(0.1 * coalesce(list_sum([{_has(WORDS.contradiction, 'x')} for x in sents]), 0) + 0.2 * ({_has(WORDS.polar_positive)} > 0 and {_has(WORDS.polar_negative)} > 0)::int"
    + r" + 0.1 * (len(regexp_extract_all(content, '\d+\.?\d*%?')) >= 4)::int, 1.0) as contradiction, "
    + "least(0.2 * ("
    + " + ".join(f"len(regexp_extract_all(content, '{p}'))" for p in WORDS.source_patterns)
    + f") + 0.3 * ({_has(WORDS.uncertainty)} > 5)::int"
    + r" + 0.2 * (len(regexp_extract_all(content, '\d+\.\d{3,}')) > 3)::int, 1.0) as source, "
    + f"paras, [sign({_has(WORDS.polar_positive, 'x')} - {_has(WORDS.polar_negative, 'x')}) for x in paras] as polar, {_has(WORDS.formal)} as formal, {_has(WORDS.casual)} as casual from s), "
    + "e as (select report_id, contradiction, source, case when len(paras) < 2 then 0.0 else least(0.4 * (len([i for i in range(2, len(polar) + 1) if polar[i] <> polar[i - 1]]) > len(paras) * 0.6)::int + case when formal > 0 and casual > 0 then least(casual / formal, 1) * 0.3 else 0.0 end, 1.0) end as consistency from c)"
)


@query(_RULES + " select report_id, round(contradiction, 6) as contradiction, round(source, 6) as source, round(consistency, 6) as consistency, round(contradiction, 9) > 0.7 as is_contradiction, round(source, 9) > 0.3 as is_doubtful_source, round(consistency, 9) > 0.7 as is_inconsistent from e")
def semantic_rules(spark, sf_dir):
    found = rounded(semantic.rules(reports(spark, sf_dir), WORDS).select("report_id", "contradiction", "source", "consistency"))
    return found.withColumns({"is_contradiction": F.col("contradiction") > 0.7, "is_doubtful_source": F.col("source") > 0.3, "is_inconsistent": F.col("consistency") > 0.7})


@query()
def view_deviation(spark, sf_dir):
    """Each turn against the last five of the same role in its conversation: summaries of whole texts are compared
    (sequence ratios are beyond SQL; a plain version in the tests stands for it)."""
    c = table(spark, sf_dir, "conversations").withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("turn") * 86400))
    c = c.withColumns({"report_id": F.concat_ws("-", "conv_id", "turn"), "key": F.concat_ws("-", "conv_id", "role"), "s": X.sentiment(X.tokens(F.col("text")), POSITIVE, NEGATIVE), "summary": semantic.view_summary(F.coalesce("text", F.lit("")), POSITIVE + NEGATIVE, end=WORDS.sentence_end)})
    views = c.select("key", F.col("report_id").alias("view_id"), F.col("ts").alias("view_ts"), F.col("summary").alias("view_summary"), F.col("s").alias("view_s"))
    near = semantic.recent_views(c.select("report_id", "key", "ts", "summary", "s"), views)
    compared = near.withColumn("similarity", semantic.sequence_ratio(F.col("summary"), F.col("view_summary"))).withColumn("gap", semantic.sentiment_gap(F.col("s"), F.col("view_s")))
    return rounded(semantic.view_deviation(compared))


@query(DOCS + r" select report_id, length(content)::int as char_count, len(words)::int as word_count, len(regexp_split_to_array(content, '[.!?]'))::int as sentence_count, round(len(words) / len(regexp_split_to_array(content, '[.!?]')), 6) as words_per_sentence, round(case when len(words) = 0 then 0.0 else len(list_distinct(words)) / len(words) end, 6) as unique_ratio, len(regexp_extract_all(content, '[0-9]'))::int as digit_count, len(regexp_extract_all(content, '[0-9]%'))::int as percent_count, len(regexp_extract_all(content, ','))::int as comma_count, round(case when length(content) = 0 then 0.0 else len(regexp_extract_all(content, '[A-Z]')) / length(content) end, 6) as upper_ratio, round(1 / (1 + len(words) / len(regexp_split_to_array(content, '[.!?]')) / 20), 6) as readability from d")
def text_features(spark, sf_dir):
    f = features.text_features(reports(spark, sf_dir), POSITIVE, NEGATIVE, WORDS.sentence_end)
    return rounded(f.select("report_id", "char_count", "word_count", "sentence_count", "words_per_sentence", "unique_ratio", "digit_count", "percent_count", "comma_count", "upper_ratio", "readability"))


@query(DOCS + ", c as (select report_id, word, count(*) as n from (select report_id, unnest(words) as word from d) group by 1, 2), r as (select *, row_number() over (partition by report_id order by n desc, word) as rank from c) select report_id, sum(n)::bigint as n_words, round(max(n) / sum(n), 6) as top_share, round(sum(n) filter (where rank <= 10) / sum(n), 6) as topk_share from r group by 1")
def word_shares(spark, sf_dir):
    return rounded(features.word_shares(reports(spark, sf_dir)))


@query(DOCS + ", w as (select report_id, author, list_distinct(words) as ws, lag(list_distinct(words)) over (partition by author order by report_id) as prev from d), j as (select report_id, author, case when prev is null or len(ws) = 0 or len(prev) = 0 then 0.0 else len(list_intersect(ws, prev)) / (len(ws) + len(prev) - len(list_intersect(ws, prev))) end as similarity from w) select report_id, author, round(similarity, 6) as similarity, similarity > 0.8 as repetitive from j")
def author_repetition(spark, sf_dir):
    return rounded(features.author_repetition(reports(spark, sf_dir).withColumn("at", F.col("report_id"))))


@query("select lang, source, count(*) as n, sum(length(coalesce(text, '')))::bigint as chars, count(distinct md5(coalesce(text, ''))) as n_distinct from documents group by 1, 2")
def report_profile(spark, sf_dir):
    return reports(spark, sf_dir).groupBy("lang", F.col("author").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"), F.countDistinct(F.md5(F.col("content").cast("binary"))).alias("n_distinct"))


@query("select 'report_' || substring(md5(coalesce(text, '')), 1, 8) as report_key, count(*) as n from documents where trim(coalesce(text, '')) <> '' group by 1")
def standardised_reports(spark, sf_dir):
    good, _ = quality.standardise(reports(spark, sf_dir).drop("report_id"))
    return good.groupBy(F.col("report_id").alias("report_key")).agg(F.count(F.lit(1)).alias("n"))


@query("select c_custkey, case when lpad((c_custkey % 1000000)::varchar, 6, '0') similar to '(00|30).*' then lpad((c_custkey % 1000000)::varchar, 6, '0') || '.SZ' when lpad((c_custkey % 1000000)::varchar, 6, '0') like '60%' then lpad((c_custkey % 1000000)::varchar, 6, '0') || '.SH' when lpad((c_custkey % 1000000)::varchar, 6, '0') similar to '(43|83|87).*' then lpad((c_custkey % 1000000)::varchar, 6, '0') || '.BJ' else lpad((c_custkey % 1000000)::varchar, 6, '0') end as code, round(c_acctbal * 10000, 2) as value, date '2024-01-01' + (c_custkey % 365)::int as day from customer")
def normalised_codes(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    code = F.lpad((F.col("c_custkey") % 1_000_000).cast("string"), 6, "0")
    text_day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 365).cast("int")), "yyyy/M/d")
    return c.select("c_custkey", stock_code(code).alias("code"), F.round(parse_number(F.concat(F.col("c_acctbal").cast("decimal(20,4)").cast("string"), F.lit("万"))), 2).alias("value"), parse_date(text_day).cast("date").alias("day"))


@query(_TOTAL_SQL + f", l as (select {LEVEL.format('statistical_score')} as level, count(*) as n from t group by 1) select v.level, coalesce(n, 0) as n from (values ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW'), ('NORMAL')) v(level) left join l using (level)")
def level_histogram(spark, sf_dir):
    return learning.level_histogram(statistical_scores(spark, sf_dir).select(level(F.col("statistical_score")).alias("level")), spark)


@query(_TOTAL_SQL + " select count(*) as n, count(*) filter (where statistical_score > 0.5) as anomalous, round(avg(statistical_score), 6) as mean_score, round(count(*) filter (where statistical_score > 0.5) / count(*), 6) as rate, case when count(*) filter (where statistical_score > 0.5) / count(*) > 0.3 then 'HIGH' when count(*) filter (where statistical_score > 0.5) > 0 then 'MEDIUM' else 'LOW' end as risk from t")
def batch_summary(spark, sf_dir):
    return rounded(learning.batch_summary(statistical_scores(spark, sf_dir).select(F.col("statistical_score").alias("score"))))


@query(r"select doc_id as report_id, length(c)::int as total_length, len([p for p in regexp_split_to_array(c, '\n{2,}') if trim(p) <> ''])::int as paragraph_count, round(case when length(c) = 0 then 0.0 else len(regexp_extract_all(c, '[0-9]')) / length(c) end, 6) as digit_density, case when regexp_matches(c, '买入|强烈推荐|强推') then '买入' else '未明确' end as rating, coalesce(nullif(regexp_extract(substring(c, 1, 2000), '(\d{4})[-/年](\d{1,2})[-/月](\d{1,2})', 1), ''), '2025') as year from (select doc_id, coalesce(text, '') as c from documents)")
def report_style(spark, sf_dir):
    """Style and metadata of plain texts."""
    from auditloom.functions import converter

    t = F.col("content")
    s = converter.style(t)
    year = F.substring(converter.publish_date(t, F.lit("2025-01-01")), 1, 4)
    return rounded(reports(spark, sf_dir).select("report_id", s["total_length"].alias("total_length"), s["paragraph_count"].alias("paragraph_count"), s["digit_density"].alias("digit_density"), converter.rating(t).alias("rating"), year.alias("year")))
