"""Rule-based semantic detectors: contradictions, sources, consistency, deviation from earlier views."""

from __future__ import annotations

import difflib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.config import LEXICONS, THRESHOLDS, Lexicons
from auditloom.functions import text as X
from auditloom.functions.scalars import weighted
from auditloom.operators.monitor import running
from auditloom.sources.shared import stash


def contradiction_score(text: Column, words: Lexicons = LEXICONS) -> Column:
    """A tenth a keyword and sentence, more for both polarities and for four numbers or more."""
    sentences = F.filter(X.pieces(text, words.sentence_end), lambda s: F.length(s) > 5)
    hits = F.aggregate(sentences, F.lit(0), lambda acc, s: acc + X.sum_of(s, words.contradiction))
    both = X.any_of(text, words.polar_positive) & X.any_of(text, words.polar_negative)
    many = F.regexp_count(text, F.lit(r"\d+\.?\d*%?")) >= 4
    return F.least(hits * 0.1 + F.when(both, 0.2).otherwise(0.0) + F.when(many, 0.1).otherwise(0.0), F.lit(1.0))


def source_score(text: Column, words: Lexicons = LEXICONS) -> Column:
    """A fifth a doubtful source, more for uncertain words and for over-exact numbers."""
    matches = sum((F.regexp_count(text, F.lit(p)) for p in words.source_patterns), F.lit(0))
    return F.least(matches * 0.2 + F.when(X.sum_of(text, words.uncertainty) > 5, 0.3).otherwise(0.0) + F.when(F.regexp_count(text, F.lit(r"\d+\.\d{3,}")) > 3, 0.2).otherwise(0.0), F.lit(1.0))


def consistency_score(text: Column, words: Lexicons = LEXICONS) -> Column:
    """Polarity changing between most paragraphs, and formal beside casual words."""
    paragraphs = X.pieces(text, r"\n")
    polar = F.transform(paragraphs, lambda p: F.signum((X.sum_of(p, words.polar_positive) - X.sum_of(p, words.polar_negative)).cast("double")))
    n = F.size(paragraphs)
    turns = F.transform(F.array(polar), lambda a: F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size(a) - 1, F.lit(1))), lambda i: F.get(a, i) != F.get(a, i - 1))))[0]
    formal, casual = X.sum_of(text, words.formal), X.sum_of(text, words.casual)
    mixed = F.when((formal > 0) & (casual > 0), F.least(casual / formal, F.lit(1.0)) * 0.3).otherwise(0.0)
    return F.when(n < 2, F.lit(0.0)).otherwise(F.least(F.when(turns > n * 0.6, 0.4).otherwise(0.0) + mixed, F.lit(1.0)))


def rules(reports: DataFrame, words: Lexicons = LEXICONS, response: str | None = None) -> DataFrame:
    """(report_id, three scores, three verdicts). ``response`` names a column with a language model's answer about
    contradictions, which counts before the rule where there is one."""
    t = F.coalesce(F.col("content"), F.lit(""))
    contradiction = contradiction_score(t, words) if response is None else F.coalesce(answer_score(F.col(response)), contradiction_score(t, words))
    found = reports.select("report_id", contradiction.alias("contradiction"), source_score(t, words).alias("source"), consistency_score(t, words).alias("consistency"))
    return found.withColumns({"is_contradiction": F.col("contradiction") > 0.7, "is_doubtful_source": F.col("source") > 0.3, "is_inconsistent": F.col("consistency") > 0.7})


def answer_score(response: Column) -> Column:
    """The severity that an answer names (fixed words), 0 if it names none; null without an answer."""
    return F.when(F.contains(response, F.lit("严重")), 0.9).when(F.contains(response, F.lit("中等")), 0.6).when(F.contains(response, F.lit("轻微")), 0.3).when(response.isNotNull(), 0.0)


#: Kinds that an answer may name, a task.
ANSWER_KINDS = {"contradiction": ("观点矛盾", "数据矛盾", "逻辑矛盾")}


def answer_kinds(response: Column, task: str = "contradiction") -> Column:
    return F.array_compact(F.array(*[F.when(F.contains(response, F.lit(k)), F.lit(k)) for k in ANSWER_KINDS[task]]))


#: Words of an answer, a task, in the order in which they are looked for, with what they mean (a score or
#: a name) and how sure that is; the last line of a task, without a word, is for an answer that names none.
ANSWERS = {
    "source": ((("异常",), 0.9), (("低",), 0.6), (("中",), 0.3), ((), 0.1)),
    "consistency": ((("很差",), 0.9), (("较差",), 0.7), (("一般",), 0.5), (("良好",), 0.2), ((), 0.1)),
    "sentiment_analysis": ((("积极", "positive"), ("positive", 0.8)), (("消极", "negative"), ("negative", 0.8)), ((), ("neutral", 0.6))),
    "style_recognition": ((("激进", "aggressive"), ("aggressive", 0.8)), (("保守", "conservative"), ("conservative", 0.8)), ((), ("neutral", 0.6))),
    "anomaly_pre_detection": ((("异常", "anomaly"), ("anomaly", 0.8)), (("可疑", "suspicious"), ("suspicious", 0.7)), ((), ("normal", 0.6))),
}


def answer(response: Column, task: str, table: dict = ANSWERS) -> Column:
    """What an answer to a task says: a score, or a structure of ``label`` and ``confidence``; null without an answer. Of a
    task that is not known the answer itself is the label."""
    said = F.lower(F.btrim(response, F.lit(" \t\n\r\x0b\x0c")))
    if task not in table:
        return F.when(response.isNotNull(), F.struct(said.alias("label"), F.lit(0.5).alias("confidence")))
    value = lambda m: F.struct(F.lit(m[0]).alias("label"), F.lit(m[1]).alias("confidence")) if isinstance(m, tuple) else F.lit(m)
    *lines, (_, other) = table[task]
    found = None
    for words, meaning in lines:
        named = X.any_of(said, words)
        found = F.when(named, value(meaning)) if found is None else found.when(named, value(meaning))
    return F.when(response.isNotNull(), found.otherwise(value(other)))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The Ratcliff/Obershelp ratio of two texts."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype=float)


def sentiment_gap(a: Column, b: Column) -> Column:
    return F.abs(a - b) / 2


def recent_views(reports: DataFrame, views: DataFrame, days: int = 180, k: int = 5) -> DataFrame:
    """Reports (report_id, key, ts, ...) with each of the last k views (key, view_id, view_ts, ...) before them that are
    not older than ``days``.  Views are numbered within their key, by ranges of time, so that a key with most of the rows
    is spread over tasks; a report takes the k numbers below its own place, so that no pairs are made but those wanted."""
    marks = views.select("key", F.col("view_ts").alias("t"), F.lit(1).alias("view"), F.col("view_id").cast("string").alias("id"))
    marks = marks.unionByName(reports.select("key", F.col("ts").alias("t"), F.lit(0).alias("view"), F.col("report_id").cast("string").alias("id")))
    placed = running(marks, "key", ["t", "view", "id"], F.col("view").cast("long"), "n")
    numbered = views.join(placed.where("view = 1").select("key", F.col("id").alias("view_id"), F.col("n").alias("number")), ["key", "view_id"])
    wanted = placed.where("view = 0 and n > 0").select("key", F.col("id").alias("report_id"), F.explode(F.sequence(F.greatest(F.lit(1), F.col("n") - (k - 1)), F.col("n"))).alias("number"))
    near = reports.join(wanted, ["key", "report_id"]).join(numbered, ["key", "number"])
    return near.where(F.unix_timestamp("view_ts") >= F.unix_timestamp("ts") - days * 86400)


def view_deviation(compared: DataFrame) -> DataFrame:
    """(report_id, n_views, similarity, gap, score) of rows with ``similarity`` and ``gap`` a view."""
    found = compared.groupBy("report_id").agg(F.count(F.lit(1)).alias("n_views"), F.avg("similarity").alias("similarity"), F.avg("gap").alias("gap"))
    hit = (F.col("similarity") < 0.4) & (F.col("gap") > 0.5)
    return found.withColumn("score", F.when(hit, F.least((1 - F.col("similarity")) * (F.col("gap") + 0.5), F.lit(1.0))).otherwise(0.0))


def deviation_score(near: DataFrame) -> DataFrame:
    """(report_id, n_views, score) of ``recent_views`` rows with ``summary``, ``s``, ``view_summary`` and ``view_s``: the score
    of ``view_deviation``.  It is 0 for views whose mean gap is small, whatever they say, so that only others are compared."""
    near = stash(near.select("report_id", "summary", "view_summary", sentiment_gap(F.col("s"), F.col("view_s")).alias("gap")), "near")
    means = near.groupBy("report_id").agg(F.count(F.lit(1)).alias("n_views"), F.avg("gap").alias("mean_gap"))
    wide = near.join(means.where("mean_gap > 0.5").select("report_id"), "report_id", "left_semi")
    told = view_deviation(wide.withColumn("similarity", sequence_ratio(F.col("summary"), F.col("view_summary")))).select("report_id", "score")
    return means.join(told, "report_id", "left").select("report_id", "n_views", F.coalesce("score", F.lit(0.0)).alias("score"))


def fan_out(views: DataFrame, contexts: dict[str, Column]) -> DataFrame:
    """``views`` once for each kind of context, with ``kind`` and ``key``; a context that is null takes none."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in contexts.items()])
    return views.select("*", F.explode(kinds).alias("context")).select(*views.columns, "context.kind", "context.key").where("key is not null")


def last_views(views: DataFrame, keep: int = 50) -> DataFrame:
    """The newest ``keep`` views (key, view_id, view_ts) of each key: the history that is kept."""
    order = Window.partitionBy("key").orderBy(F.desc("view_ts"), F.desc("view_id"))
    return views.withColumn("back", F.row_number().over(order)).where(F.col("back") <= keep).drop("back")


def worst_context(deviations: DataFrame, above: float = 0.6) -> DataFrame:
    """(report_id, score, is_anomaly): the greatest deviation over a report's contexts, 0 for none above 0."""
    found = deviations.groupBy("report_id").agg(F.max("score").alias("score"))
    return found.withColumn("is_anomaly", F.col("score") > above)


def view_summary(text: Column, keywords: Sequence[str], cut: int = 100, end: str = LEXICONS.sentence_end) -> Column:
    """The sentence (over ten characters) with most keywords, the first of equals, cut; else the text's beginning."""
    sentences = F.filter(X.pieces(text, end), lambda s: F.length(s) > 10)
    ranked = F.transform(sentences, lambda s, i: F.struct(X.sum_of(s, keywords).alias("n"), (-i).alias("i"), s.alias("s")))
    best = F.coalesce(F.array_max(ranked)["s"], text)
    return F.when(F.length(best) > cut, F.concat(F.substring(best, 1, cut), F.lit("..."))).otherwise(best)


def total(scored: DataFrame) -> DataFrame:
    return scored.withColumn("semantic_score", weighted([F.coalesce(F.col(c), F.lit(0.0)) for c in ("contradiction", "deviation", "source", "consistency")], THRESHOLDS.semantic_weights))
