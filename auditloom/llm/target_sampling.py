"""Importance resampling towards a target text, over a persisted sparse count matrix.

Every text becomes a row of a matrix of counts, a column a hash bucket of its features (runs of words).  The
matrix is written once, as compressed sparse rows in blocks of about a megabyte of text: row ends, buckets and
counts of a block are three plain arrays.  Column sums of the documents' and of the target's matrix give both
distributions and a gain a bucket; the matrix times the gains gives each document its weight.  Gumbel noise is
added, and the highest scores are drawn.  Only column sums, a number a bucket, reach the driver.

Defined cases: a null or empty text has no features and weight 0, and is too short to be drawn; rows that repeat
an id are each counted, weighed and drawn as rows of their own, and share their noise; a null id is drawn under
the empty name and stands first among ties; ties in score go to the smaller id, then to the smaller weight and
number of features; a very long text is read whole, in a block of its own; without a target, or without any
feature at all, the gains are those of the formula with zero counts; an empty table gives an empty result; only
``key`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.quality_classifier import kth_largest
from auditloom.llm.stash import stash
from auditloom.llm.text_blocks import blocks
from auditloom.operators.monitor import numbered

#: Words of texts whose A-Z are lower-cased: digits, a-z and all that is not ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class SamplingConfig(NamedTuple):
    buckets: int = 10_000
    longest: int = 1
    least_words: int = 20
    percent: int = 10
    seed: int = 2024


class _Buckets(dict):
    """Buckets of features met before; forgotten when there are too many, so that memory stays bounded."""

    def __init__(self, buckets: int, most: int = 1 << 19):
        self.buckets, self.most = buckets, most

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


def count_matrix(docs: DataFrame, text: str = "text", key: str = "doc_id", config: SamplingConfig = SamplingConfig()) -> DataFrame:
    """The matrix as blocks of rows: (keys, words, ends, buckets, counts); ``words`` holds a number a row, ``ends``
    where each row ends, as 4-byte integers; ``buckets`` and ``counts`` the entries of all rows, as 4-byte integers."""
    source = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    kind = source.schema["__key"].dataType
    schema = T.StructType([T.StructField("keys", T.ArrayType(kind)), *[T.StructField(n, T.BinaryType()) for n in ("words", "ends", "buckets", "counts")]])
    n_buckets, longest = config.buckets, config.longest

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_of = _Buckets(n_buckets)
        for batch in batches:
            for block in blocks(batch.column(1)):
                words, ends, at, counts = [], [0], [], []
                for i in range(block.hi - block.lo):
                    found = _WORD.findall(block.text(i).lower())
                    row: Counter = Counter()
                    for n in range(1, longest + 1):
                        features = found if n == 1 else [b" ".join(found[j : j + n]) for j in range(len(found) - n + 1)]
                        for feature, times in Counter(features).items():
                            row[bucket_of[feature]] += times
                    words.append(len(found))
                    at.append(np.fromiter(row.keys(), np.int32, len(row)))
                    counts.append(np.fromiter(row.values(), np.int32, len(row)))
                    ends.append(ends[-1] + len(row))
                packed = [np.array(words, np.int32), np.array(ends[1:], np.int32), np.concatenate(at), np.concatenate(counts)]
                keys = batch.column(0).slice(block.lo, block.hi - block.lo)
                held = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
                yield pa.RecordBatch.from_arrays([held, *[pa.array([x.tobytes()], pa.binary()) for x in packed]], names=schema.names)

    return source.mapInArrow(counted, schema)


def _arrays(batch: pa.RecordBatch, *names: str) -> Iterator[list[np.ndarray]]:
    """The named binary columns of each block as arrays."""
    columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
    for i in range(batch.num_rows):
        yield [np.frombuffer(c[i].as_buffer(), np.int32) for c in columns]


def column_sums(matrix: DataFrame, config: SamplingConfig = SamplingConfig()) -> np.ndarray:
    """The number of features in each bucket: every task sums its blocks, and a row a bucket reaches the driver."""
    n_buckets = config.buckets

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for at, counts in _arrays(batch, "buckets", "counts"):
                total += np.bincount(at, counts, minlength=n_buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    found = np.zeros(n_buckets, np.int64)
    for r in matrix.select("buckets", "counts").mapInArrow(summed, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        found[r["bucket"]] = r["n"]
    return found


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the target's to the raw text's smoothed share, a bucket; rounded down."""
    s_all, t_all = int(raw.sum()) + len(raw), int(target.sum()) + len(raw)
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weights(matrix: DataFrame, gain: np.ndarray, key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_features, weight): the matrix times the gains over each row's features, rounded down."""
    schema = T.StructType([T.StructField(key, matrix.schema["keys"].dataType.elementType), *[T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight")]])

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("keys"))
            for i, (words, ends, at, counts) in enumerate(_arrays(batch, "words", "ends", "buckets", "counts")):
                row = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[np.concatenate([[0], ends])])
                n, total = row(counts), row(gain[at] * counts)
                own = keys.values.slice(keys.offsets[i].as_py(), len(words))
                yield pa.RecordBatch.from_arrays([own, pa.array(words.astype(np.int64)), pa.array(n), pa.array(np.floor_divide(total, np.maximum(n, 1)))], names=schema.names)

    return matrix.mapInArrow(weighed, schema)


def noise(key: str = "doc_id", seed: int = SamplingConfig.seed) -> Column:
    """Thousandths of Gumbel noise from the first four bytes of the key's SHA-256, rounded down."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share))).cast("long")


def draw(weighed: DataFrame, key: str = "doc_id", config: SamplingConfig = SamplingConfig()) -> DataFrame:
    """``weighed`` with ``score`` and ``rank``: the highest scores of the rows with words enough are numbered, the
    others have no rank.  The least score drawn is found by histograms; only rows that reach it are put in order, by
    ranges of that order."""
    # A number a row, written with it, so that the many rows of one id can lie in several ranges.
    scored = stash(weighed.withColumn("score", F.col("weight") + noise(key, config.seed)).withColumn("__row", F.monotonically_increasing_id()), "scores")
    fit = scored.where(F.col("n_words") >= config.least_words)
    k = config.percent * fit.count() // 100
    threshold = kth_largest(fit, "score", k)
    reached = F.lit(False) if threshold is None else (F.col("n_words") >= config.least_words) & (F.col("score") >= F.lit(threshold))
    ordered = numbered(scored.where(reached).withColumn("__all", F.lit(0)).withColumn("__down", -F.col("score")), "__all", ["__down", key, "weight", "n_features", "__row"], "rank")
    ranked = ordered.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank").cast("long")))
    others = scored.where(~reached).withColumn("rank", F.lit(None).cast("long"))
    return ranked.drop("__all", "__down").unionByName(others).drop("__row")


def resample(docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", target_text: str = "text", config: SamplingConfig = SamplingConfig()) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of every row of ``docs``, drawn towards ``target``."""
    matrix = stash(count_matrix(docs, text, key, config), "counts")
    wanted = column_sums(count_matrix(target, target_text, target_text, config), config)
    return draw(weights(matrix, gains(column_sums(matrix, config), wanted), key), key, config)


def op13_importance_sampling(spark, sf_dir: str) -> DataFrame:
    found = resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank", "n_words")
