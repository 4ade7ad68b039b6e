"""Statistical detectors: text length, new vocabulary, sentiment and numbers against a baseline of earlier texts.

Baselines are aggregate tables of one row (lengths, sentiment, numbers) or of one row a word.  Reports carry
``report_id`` and ``content``.  ``row_features``, ``hapaxes`` and ``scores`` give all four at once from two
readings of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.config import LEXICONS, THRESHOLDS
from auditloom.functions import text as X
from auditloom.functions.scalars import attach, weighted, z_score
from auditloom.operators.quantiles import percentiles
from auditloom.sources.shared import stash


def describe(values: DataFrame, column: str, shares: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """One row: n, mean, std (population), min, max and exact percentiles, which are searched at once."""
    c = F.col(column)
    row = values.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
    found = percentiles(values, column, shares) if shares else []
    return row.select("*", *[F.lit(p).cast("double").alias(f"p{int(100 * s)}") for s, p in zip(shares, found)])


def vocabulary(reports: DataFrame, cap: int | None = None, stop_words: Sequence[str] = ()) -> DataFrame:
    """(word, n) of all texts; ``cap`` keeps the most frequent, ties by the word."""
    counted = reports.select(F.explode(X.tokens(F.col("content"), stop_words)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted if cap is None else counted.orderBy(F.desc("n"), "word").limit(cap)


def number_values(reports: DataFrame, patterns: Sequence[str] = LEXICONS.number_patterns) -> DataFrame:
    return reports.select("report_id", F.explode(X.numbers(F.col("content"), patterns)).alias("value"))


def length_anomaly(reports: DataFrame, baseline: DataFrame) -> DataFrame:
    """(report_id, length, z, score, is_anomaly); ``baseline`` is ``describe`` of lengths, one row."""
    z = z_score(F.col("length"), F.col("mean"), F.col("std"))
    found = attach(reports.select("report_id", F.length("content").cast("long").alias("length")), baseline.select("mean", "std"))
    found = found.withColumn("z", z)
    return found.select("report_id", "length", "z", F.least(F.col("z") / THRESHOLDS.length_z, F.lit(1.0)).alias("score"), (F.col("z") > THRESHOLDS.length_z).alias("is_anomaly"))


def vocabulary_novelty(reports: DataFrame, words: DataFrame, stop_words: Sequence[str] = ()) -> DataFrame:
    """(report_id, n_unique, n_new, ratio, score, is_anomaly): the share of a report's distinct words that ``words`` lacks."""
    unique = reports.select("report_id", F.explode_outer(F.array_distinct(X.tokens(F.col("content"), stop_words))).alias("word"))
    known = words.select("word", F.lit(True).alias("known"))
    counted = unique.join(known, "word", "left").groupBy("report_id").agg(F.count("word").alias("n_unique"), F.count_if(F.col("word").isNotNull() & F.col("known").isNull()).alias("n_new"))
    return _novelty(counted)


def self_novelty(reports: DataFrame, stop_words: Sequence[str] = ()) -> DataFrame:
    """``vocabulary_novelty`` of reports against the words that occur twice or more in themselves."""
    unique = reports.select("report_id", F.size(F.array_distinct(X.tokens(F.col("content"), stop_words))).cast("long").alias("n_unique"))
    found = unique.join(hapaxes(reports, stop_words), "report_id", "left").withColumn("n_new", F.coalesce("n_new", F.lit(0)))
    return _novelty(found)


def _novelty(counted: DataFrame) -> DataFrame:
    r = F.col("n_new") / F.greatest(F.col("n_unique"), F.lit(1))
    return counted.withColumn("ratio", r).select("report_id", "n_unique", "n_new", "ratio", F.least(F.col("ratio") / THRESHOLDS.novelty, F.lit(1.0)).alias("score"), (F.col("ratio") > THRESHOLDS.novelty).alias("is_anomaly"))


def with_sentiment(reports: DataFrame, positive: Sequence[str] = LEXICONS.positive, negative: Sequence[str] = LEXICONS.negative) -> DataFrame:
    return reports.withColumn("sentiment_score", X.sentiment(X.tokens(F.col("content")), positive, negative))


def sentiment_anomaly(scored: DataFrame, baseline: DataFrame) -> DataFrame:
    """(report_id, sentiment_score, z, score, is_anomaly) of ``with_sentiment`` rows."""
    found = attach(scored.select("report_id", "sentiment_score"), baseline.select("mean", "std")).withColumn("z", z_score(F.col("sentiment_score"), F.col("mean"), F.col("std")))
    return found.select("report_id", "sentiment_score", "z", F.least(F.col("z") / THRESHOLDS.sentiment_z, F.lit(1.0)).alias("score"), (F.col("z") > THRESHOLDS.sentiment_z).alias("is_anomaly"))


def deviation(value: Column, low: Column, high: Column) -> Column:
    """How far a number lies outside [low, high], relative to the border, at most 1."""
    return F.when(value < low, F.least((low - value) / F.greatest(F.abs(low), F.lit(1e-6)), F.lit(1.0))).when(value > high, F.least((value - high) / F.greatest(F.abs(high), F.lit(1e-6)), F.lit(1.0))).otherwise(0.0)


def number_anomaly(reports: DataFrame, baseline: DataFrame, patterns: Sequence[str] = LEXICONS.number_patterns) -> DataFrame:
    """(report_id, n_numbers, score, is_anomaly): the greatest deviation of a report's numbers."""
    exploded = attach(reports.select("report_id", F.explode_outer(X.numbers(F.col("content"), patterns)).alias("value")), baseline.select("p5", "p95"))
    found = exploded.groupBy("report_id").agg(F.count("value").alias("n_numbers"), F.coalesce(F.max(deviation(F.col("value"), F.col("p5"), F.col("p95"))), F.lit(0.0)).alias("score"))
    return found.withColumn("is_anomaly", F.col("score") > THRESHOLDS.number_deviation)


def row_features(reports: DataFrame, keep: Sequence[str | Column] = (), positive: Sequence[str] = LEXICONS.positive, negative: Sequence[str] = LEXICONS.negative, patterns: Sequence[str] = LEXICONS.number_patterns, stop_words: Sequence[str] = ()) -> DataFrame:
    """(report_id, keep, length, n_unique, sentiment_score, numbers) from one reading of the texts, whose words are
    told apart once. Written to the shared folder: what follows reads these few columns, not the texts."""
    told = F.transform(F.array(X.tokens(F.col("content"), stop_words)), lambda w: F.struct(F.size(F.array_distinct(w)).cast("long").alias("n_unique"), X.sentiment(w, positive, negative).alias("sentiment_score")))
    found = reports.select("report_id", *keep, F.length("content").cast("long").alias("length"), told[0].alias("told"), X.numbers(F.col("content"), patterns).alias("numbers"))
    found = stash(found, "features")
    kept = [c for c in found.columns if c not in ("report_id", "length", "told", "numbers")]
    return found.select("report_id", *kept, "length", "told.n_unique", "told.sentiment_score", "numbers")


def hapaxes(reports: DataFrame, stop_words: Sequence[str] = ()) -> DataFrame:
    """(report_id, n_new): words of a report that occur once in all reports together; reports without any are not in it.
    Words are counted before they are shuffled, so that what moves is vocabularies, not texts."""
    words = reports.select("report_id", F.explode(X.tokens(F.col("content"), stop_words)).alias("word"))
    single = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min("report_id").alias("report_id")).where("n = 1")
    return single.groupBy("report_id").agg(F.count(F.lit(1)).alias("n_new"))


def scores(features: DataFrame, new_words: DataFrame) -> DataFrame:
    """``features`` of ``row_features`` with the four parts and ``statistical_score``, the reports being their own
    baseline; ``new_words`` is (report_id, n_new)."""
    base = features.agg(*[f(c).alias(f"{c}_{n}") for c in ("length", "sentiment_score") for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    low, high = percentiles(features.select(F.explode("numbers").alias("value")), "value", (0.05, 0.95))
    found = attach(features.join(new_words, "report_id", "left"), base)
    z = lambda c: z_score(F.col(c), F.col(f"{c}_mean"), F.col(f"{c}_std"))
    worst = F.array_max(F.transform("numbers", lambda v: deviation(v, F.lit(low), F.lit(high)))) if low is not None else F.lit(0.0)
    ratio = F.coalesce("n_new", F.lit(0)) / F.greatest("n_unique", F.lit(1))
    parts = {"length_score": F.least(z("length") / THRESHOLDS.length_z, F.lit(1.0)), "novelty_score": F.least(ratio / THRESHOLDS.novelty, F.lit(1.0)), "sentiment_part": F.least(z("sentiment_score") / THRESHOLDS.sentiment_z, F.lit(1.0)), "number_score": F.coalesce(worst, F.lit(0.0))}
    kept = [c for c in features.columns if c != "numbers"]
    scored = found.select(*kept, *[v.alias(k) for k, v in parts.items()])
    return scored.withColumn("statistical_score", weighted([F.col(c) for c in parts], THRESHOLDS.statistical_weights))


def keywords(reports: DataFrame, k: int = 5, stop_words: Sequence[str] = ()) -> DataFrame:
    """The k words of greatest tf-idf of each report: (report_id, word, tf, weight, rank). Texts are dealt by report before
    their words are counted, so that the shuffle moves them once and no words after them."""
    words = reports.select("report_id", "content").repartition("report_id").select("report_id", F.explode(X.tokens(F.col("content"), stop_words)).alias("word"))
    return top_words(words, k, reports.agg(F.count(F.lit(1)).alias("docs")))


#: So many words, those of most reports, are sent to every task, which spares most rows the shuffle by word.
COMMON = 32_768

#: So many rows are weighed at once.
ROWS = 1 << 18


def top_words(words: DataFrame, k: int, docs: DataFrame) -> DataFrame:
    """The k words of greatest tf-idf of each report, of words however they were found (report_id, word) and the number
    of reports (docs). Words are counted once and written; document frequencies and weights read the counts."""
    counted = stash(words.groupBy("report_id", "word").agg(F.count(F.lit(1)).alias("tf")), "counts")
    spread = stash(attach(counted.groupBy("word").agg(F.count(F.lit(1)).alias("df")), docs).select("word", F.log(F.col("docs") / F.col("df")).alias("idf")), "idf")
    known = counted.join(F.broadcast(spread.orderBy("idf", "word").limit(COMMON)), "word", "left")
    rest = known.where("idf is null").drop("idf").join(spread, "word")
    return _first(known.where("idf is not null").unionByName(rest).withColumn("weight", F.col("tf") * F.col("idf")), k)


def _first(weighed: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("report_id").orderBy(F.desc("weight"), "word")
    return weighed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("report_id", "word", "tf", "weight", "rank")


def top_counted(counts: DataFrame, k: int, docs: DataFrame) -> DataFrame:
    """``top_words`` of reports whose words are counted already: (report_id, word, tf), a row a text, with its different
    words and their numbers in arrays. They are written; document frequencies and weights read them once each. Texts of one
    report are put together first, where there are such."""
    counted = stash(counts, "counts")
    if counted.groupBy("report_id").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").head(1):
        each = counted.select("report_id", F.explode(F.arrays_zip("word", "tf")).alias("c")).groupBy("report_id", "c.word").agg(F.sum("c.tf").alias("tf"))
        lists = each.groupBy("report_id").agg(F.collect_list(F.struct("word", "tf")).alias("c"))
        counted = stash(lists.select("report_id", F.col("c.word").alias("word"), F.col("c.tf").alias("tf")), "reports")
    words = counted.select(F.explode("word").alias("word"))
    spread = stash(attach(words.groupBy("word").agg(F.count(F.lit(1)).alias("df")), docs).select("word", F.log(F.col("docs") / F.col("df")).alias("idf")), "idf")
    common = spread.orderBy("idf", "word").limit(COMMON).toPandas()
    most = spread.agg(F.max("idf")).first()[0] or 0.0
    known = leading(counted, common["word"].to_numpy(), common["idf"].to_numpy(), most, k)
    return _first(known.join(spread, "word", "left").withColumn("weight", F.coalesce("weight", F.col("tf") * F.col("idf"))), k)


def leading(counted: DataFrame, words: np.ndarray, idf: np.ndarray, most: float, k: int) -> DataFrame:
    """(report_id, word, tf, weight): a row a word, with the weights of those in ``words``, null for others, whose idf is no
    less than any of theirs and ``most`` at most.  Only rows stay that may be among a report's k of greatest weight, equal
    ones included."""
    shared = counted.sparkSession.sparkContext.broadcast((words, idf))

    def weigh(report: pa.Array, words: pa.Array, tf: np.ndarray, sizes: np.ndarray, known: pa.Array, idf: np.ndarray) -> pa.RecordBatch:
        place = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy()
        low, high = tf * np.append(idf, idf.max(initial=0.0))[place], tf * np.append(idf, most)[place]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((-low, owner))
        sizes = sizes[sizes > 0]
        least = np.repeat(low[order][np.cumsum(sizes) - np.maximum(sizes - k + 1, 1)], sizes)
        kept = np.sort(order[high[order] >= least])
        columns = [report.take(pa.array(owner[kept])), words.take(pa.array(kept)), pa.array(tf[kept]), pa.array(low[kept], mask=place[kept] < 0)]
        return pa.RecordBatch.from_arrays(columns, ["report_id", "word", "tf", "weight"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, idf = shared.value
        known = pa.array(words, pa.string())
        for batch in batches:
            report, word, tf = batch.columns
            sizes = pc.list_value_length(word).to_numpy()
            ends = np.append(np.flatnonzero(np.diff(np.cumsum(sizes) // ROWS)) + 1, len(sizes)).tolist()
            for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
                yield weigh(report[lo:hi], word[lo:hi].flatten(), tf[lo:hi].flatten().to_numpy(), sizes[lo:hi], known, idf)

    kind = counted.schema["report_id"].dataType.simpleString()
    return counted.select("report_id", "word", "tf").mapInArrow(of, f"report_id {kind}, word string, tf long, weight double")
