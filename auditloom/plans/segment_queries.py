"""Queries over segmented texts.  The tables hold no Chinese, so runs of words stand in for runs of characters: their
units are words, and the dictionary is one of phrases."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.operators import segmentation, statistical
from auditloom.operators.segmentation import SegmentConfig
from auditloom.plans.report_queries import rounded
from auditloom.plans.tables import spread, table

QUERIES, SQL = {}, {}

#: Possessive, as Java would go down a level for each word of a run otherwise.
PHRASES = SegmentConfig(run="[a-z]++(?: [a-z]++)*+", unit="[a-z]++", joint=" ", longest=3)
GIVEN, STOP_WORDS = ("the report", "in the year"), ("the", "of", "und", "de")

_COUNTS = """with recursive texts as (select doc_id, regexp_extract_all(coalesce(text, ''), '[a-z]+(?: [a-z]+)*') as found from documents),
runs as (select doc_id, place, string_split(found[place], ' ') as u from (select doc_id, found, unnest(range(1, len(found) + 1)) as place from texts)),
heads as (select u[i:i + 3] as h from (select u, unnest(range(1, len(u) + 1)) as i from runs)),
counts as (select h[1:k] as words, k, count(*) as n from (select h, unnest(range(1, len(h) + 1)) as k from heads) group by 1, 2),
total as (select sum(n)::double as total from counts where k = 1),
afters as (select words[1:k - 1] as words, sum(n) as inside, sum(n * ln(n)) as c from counts where k > 1 group by 1),
befores as (select words[2:k] as words, sum(n) as inside, sum(n * ln(n)) as c from counts where k > 1 group by 1),
sides as (select w.words, w.k, w.n, round(1000 * (ln(w.n) - (coalesce(b.c, 0) + case when w.n > coalesce(b.inside, 0) then (w.n - coalesce(b.inside, 0)) * ln(w.n - coalesce(b.inside, 0)) else 0 end) / w.n), 3) as l, round(1000 * (ln(w.n) - (coalesce(a.c, 0) + case when w.n > coalesce(a.inside, 0) then (w.n - coalesce(a.inside, 0)) * ln(w.n - coalesce(a.inside, 0)) else 0 end) / w.n), 3) as r from counts w left join afters a on a.words = w.words left join befores b on b.words = w.words where w.n >= 5 and w.k between 2 and 3),
parts as (select words, n, words[1:j] as a, words[j + 1:k] as b from (select *, unnest(range(1, k)) as j from sides where l >= 600 and r >= 600)),
firm as (select p.words, min(p.n) as n, min(floor(1000 * ln(p.n * total / (a.n::double * b.n)))) as cohesion from parts p join counts a on a.words = p.a join counts b on b.words = p.b cross join total where a.n >= 5 and b.n >= 5 group by 1),
known as (select array_to_string(words, ' ') as word, n, floor(1000 * ln(n::double / total))::bigint as weight from (select words, n from counts where k = 1 union all select words, n from firm where cohesion >= 3000) cross join total)"""
_WORDS = (
    _COUNTS
    + """,
lexicon as (select word, weight from known where word not in ('the report', 'in the year') union all select 'the report', greatest(coalesce((select weight from known where word = 'the report'), -99999999), coalesce((select weight from known where word = 'the'), (select floor(1000 * ln(1 / total)) from total)) + coalesce((select weight from known where word = 'report'), (select floor(1000 * ln(1 / total)) from total)) + 1)::bigint
union all select 'in the year', greatest(coalesce((select weight from known where word = 'in the year'), -99999999), greatest(w('in') + w('the') + w('year'), w('in the') + w('year'), w('in') + w('the year')) + 1)::bigint),
path as (select doc_id, place, u, len(u) as i, 0::bigint as b1, [] ::varchar[] as s1, null::bigint as b2, null::varchar[] as s2, null::bigint as b3, null::varchar[] as s3 from runs
union all select doc_id, place, u, i - 1, greatest(c1, c2, c3), case when c3 >= greatest(c1, c2, c3) then list_prepend(w3, s3) when c2 >= greatest(c1, c2, c3) then list_prepend(w2, s2) else list_prepend(w1, s1) end, b1, s1, b2, s2
from (select r.*, u[i] as w1, u[i] || ' ' || u[i + 1] as w2, u[i] || ' ' || u[i + 1] || ' ' || u[i + 2] as w3, x.weight + b1 as c1, y.weight + b2 as c2, z.weight + b3 as c3 from path r left join lexicon x on x.word = u[i] left join lexicon y on y.word = u[i] || ' ' || u[i + 1] and b2 is not null left join lexicon z on z.word = u[i] || ' ' || u[i + 1] || ' ' || u[i + 2] and b3 is not null where i > 0)),
cut as (select t.doc_id, coalesce(list_filter(flatten(list(p.s1 order by p.place) filter (where p.s1 is not null)), lambda w: length(w) > 1 and w not in ('the', 'of', 'und', 'de')), []) as words from texts t left join (select * from path where i = 0) p on p.doc_id = t.doc_id group by 1)"""
)
#: The weight of a word, or that of an unknown unit; a phrase that is unknown can't be on a path.
_WORDS = _WORDS.replace("coalesce((select weight from known where word = 'in the'), ", "(")
for _w in ("in", "the", "year", "in the", "the year"):
    _unknown = "(select floor(1000 * ln(1 / total)) from total)" if " " not in _w else "-99999999"
    _WORDS = _WORDS.replace(f"w('{_w}')", f"coalesce((select weight from known where word = '{_w}'), {_unknown})")


def _texts(spark, sf_dir):
    return spread(spark, f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("report_id"), "text")


def segmented_words(spark, sf_dir):
    """Every text in words and phrases, by a dictionary counted from all of them."""
    n = lambda x: F.size(x).cast("long")
    return segmentation.segment(_texts(spark, sf_dir), "report_id", "text", PHRASES, GIVEN, STOP_WORDS).select("report_id", n(F.col("words")).alias("n_words"), n(F.filter("words", lambda w: F.contains(w, F.lit(" ")))).alias("n_phrases"), F.md5(F.array_join("words", "|").cast("binary")).alias("digest"))


def segment_keywords(spark, sf_dir):
    """The five words or phrases of greatest tf-idf of every text."""
    counts = segmentation.segment_counts(_texts(spark, sf_dir), "report_id", "text", PHRASES, GIVEN, STOP_WORDS)
    return rounded(statistical.top_counted(counts, 5, _segmented_count(spark, sf_dir)))


def _segmented_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("docs"))


def lexicon_words(spark, sf_dir):
    """The dictionary: every word and phrase with its number and weight."""
    return segmentation.text_lexicon(_texts(spark, sf_dir), "text", PHRASES).select("word", "n", "weight")


QUERIES |= {f.__name__: f for f in (segmented_words, segment_keywords, lexicon_words)}
SQL["segmented_words"] = _WORDS + " select doc_id as report_id, len(words) as n_words, len(list_filter(words, lambda w: contains(w, ' '))) as n_phrases, md5(array_to_string(words, '|')) as digest from cut"
SQL["segment_keywords"] = _WORDS + ", c as (select report_id, word, count(*) as tf from (select doc_id as report_id, unnest(words) as word from cut) group by 1, 2), x as (select word, ln((select count(*) from documents) / count(*)) as idf from c group by 1), k as (select report_id, c.word, tf, tf * idf as weight, row_number() over (partition by report_id order by tf * idf desc, c.word) as rank from c join x on x.word = c.word) select report_id, word, tf, round(weight, 6) as weight, rank from k where rank <= 5"
SQL["lexicon_words"] = _COUNTS + " select word, n, weight from known"
