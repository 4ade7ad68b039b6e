"""Importance resampling: documents are drawn by the ratio of two hashed n-gram models, by Gumbel top-k.

The target model counts hashed words, marks and pairs of neighbours in documents labelled good, the raw
model in all documents; a word or mark that repeats its neighbour also counts as one gram of its own kind.
A document's log importance is its log ratio a gram, with ``prior`` grams of ratio one added to each
document, times ``effective``, the number of grams that a document counts as.  The grams of a text are far
from independent; taking all of them for so would put importances hundreds of orders apart and leave the draw
nothing to decide.  One formula serves all lengths, so that length alone does not decide.  Adding Gumbel noise
drawn from a hash of the id, and keeping the ``k`` greatest sums, draws ``k`` documents without replacement in
proportion to importance.

``k`` is a parameter; by default it is the number of documents times the share of good ones among those
with a label.  The labels used are a bounded sample (``DsirConfig.sample`` rows of smallest id hash); raw
counts and the threshold of the draw come from all documents.

Defined cases: null and empty texts have no gram, so log importance 0; very long texts are read whole, a
block of their own; repeated rows share their noise and are drawn together, as are all documents that tie
with the last one drawn; of several labels of one document the greatest counts, null labels none; an empty
table draws none; without labels the share is 0 and none is drawn; without good labels every log importance
is 0.  A column of the table named like the result and listed in ``keep`` is an error; others do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.arrow_map import add_columns
from auditloom.llm.stash import stash
from auditloom.llm.text_blocks import ASCII_SPACE, Block, blocks, classes, ngrams

_MARKS = bytes(b for b in range(128) if not chr(b).isalnum() and b not in ASCII_SPACE)
_PIECES = classes(other=_MARKS)
#: Gumbel keys are compared as integers of this step.
KEY_STEP = 1e-6


@dataclass(frozen=True)
class DsirConfig:
    """``buckets``: size of the hash space; ``sample`` bounds the labelled rows; ``smooth`` is added to each
    count of raw text, and in proportion to raw text to the target's; ``prior``: grams of ratio one that each
    document starts with; ``effective``: the number of independent grams that a document counts as, the inverse of the
    draw's temperature; ``seed`` is that of the Gumbel noise."""

    buckets: int = 1 << 15
    sample: int = 24_000
    smooth: float = 1.0
    prior: float = 16.0
    effective: float = 16.0
    seed: int = 17


@dataclass(frozen=True)
class DsirModel:
    """The log ratio a bucket, the number of grams that a document counts as, the number of documents, and the share of
    good ones among those labelled."""

    ratio: np.ndarray
    effective: float
    documents: int
    share: float
    prior: float = DsirConfig.prior

    @property
    def k(self) -> int:
        """The expected number of good documents."""
        return round(self.documents * self.share)


def grams(block: Block, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, marks and pairs of neighbours of a block, and the text of each."""
    pieces = block.tokens(_PIECES)
    owner = pieces.owner()
    inside = owner[:-1] == owner[1:]
    again = inside & (pieces.hashes[:-1] == pieces.hashes[1:])
    found = np.concatenate([ngrams(pieces.hashes, (), 11), ngrams(pieces.hashes, (1,), 12)[inside], np.full(again.sum(), 13, np.uint64)])
    return (found % np.uint64(buckets)).astype(np.int64), np.concatenate([owner, owner[:-1][inside], owner[:-1][again]])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", config: DsirConfig = DsirConfig()) -> DsirModel:
    """Both models from one scan of ``docs``; the labelled sample is bounded, so it is broadcast to it."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg((F.max(F.col(label)) == 1).alias("__good"))
    known = known.withColumn("__h", F.xxhash64(F.col("__key").cast("string"))).orderBy("__h", "__key").limit(config.sample)
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(known), "__key", "left").select("__text", "__good")
    buckets = config.buckets

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Beside the buckets: documents, labelled ones, good ones.
        raw, target, totals = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64), np.zeros(3, np.int64)
        for batch in batches:
            good = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            totals += batch.num_rows, batch.num_rows - batch.column(1).null_count, good.sum()
            for block in blocks(batch.column(0)):
                at, owner = grams(block, buckets)
                raw += np.bincount(at, minlength=buckets)
                target += np.bincount(at[good[block.lo : block.hi][owner]], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-3, buckets)), pa.array(np.concatenate([totals, raw])), pa.array(np.concatenate([totals * 0, target]))], names=["bucket", "raw", "target"])

    counted = rows.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(buckets + 3), np.zeros(buckets + 3)
    for r in counted.collect():  # one row a bucket
        raw[r["bucket"] + 3], target[r["bucket"] + 3] = r["raw"], r["target"]
    documents, labelled, good = raw[:3]
    return DsirModel(log_ratio(raw[3:], target[3:], config.smooth), config.effective, int(documents), good / labelled if labelled else 0.0, config.prior)


def log_ratio(raw: np.ndarray, target: np.ndarray, smooth: float) -> np.ndarray:
    """The log of the target's over the raw text's share of each bucket; zeros without a target."""
    if not target.sum():
        return np.zeros(len(raw))
    raw = raw + smooth
    target = target + smooth * len(raw) * raw / raw.sum()
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def score(docs: DataFrame, model: DsirModel, text: str = "text", keep: Sequence[str] = ("doc_id",), name: str = "log_weight") -> DataFrame:
    """``keep`` columns and the log importance of every whole text."""
    ratio, buckets, effective, prior = model.ratio, len(model.ratio), model.effective, model.prior

    def run(block: Block) -> list[pa.Array]:
        at, owner = grams(block, buckets)
        n = block.hi - block.lo
        total, count = np.bincount(owner, ratio[at], minlength=n).astype(np.float64), np.bincount(owner, minlength=n)
        return [pa.array(effective * total / (count + prior))]

    return add_columns(docs, text, run, f"`{name}` double", keep)


def gumbel_key(key: str = "doc_id", weight: str = "log_weight", seed: int = DsirConfig.seed) -> Column:
    """Log importance plus Gumbel noise, as an integer number of ``KEY_STEP``."""
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key).cast("string")), 11)
    noise = -F.log(-F.log((hashed + 0.5) / F.lit(float(1 << 53))))
    return F.round((F.col(weight) + noise) / KEY_STEP).cast("long")


def kth_largest(keys: DataFrame, column: str, k: int, bins: int = 4096) -> int | None:
    """The ``k``-th greatest value of an integer column, by a few rounds of histograms; None if there is none."""
    lo, hi, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k < 1:
        return None
    k = min(k, n)
    while lo < hi:
        width = -(-(hi - lo + 1) // bins)
        place = F.floor((F.col(column) - F.lit(lo)) / F.lit(width)).cast("long") if width > 1 else F.col(column) - F.lit(lo)
        counts = dict(keys.where(F.col(column).between(lo, hi)).groupBy(place.alias("b")).count().collect())
        for b in sorted(counts, reverse=True):
            if counts[b] >= k:
                lo, hi = lo + b * width, min(hi, lo + (b + 1) * width - 1)
                break
            k -= counts[b]
    return lo


def draw(scored: DataFrame, k: int, key: str = "doc_id", weight: str = "log_weight", seed: int = DsirConfig.seed) -> tuple[int | None, DataFrame]:
    """The least Gumbel key drawn (None if none is), and ``scored`` with ``gumbel`` (integer steps) and ``kept``;
    ``scored`` is read several times."""
    keyed = scored.withColumn("gumbel", gumbel_key(key, weight, seed))
    threshold = kth_largest(keyed, "gumbel", k)
    return threshold, keyed.withColumn("kept", F.lit(False) if threshold is None else F.col("gumbel") >= F.lit(threshold))


def production(spark, docs: DataFrame, sf_dir: str) -> tuple[int | None, DsirModel, DataFrame]:
    """The threshold over ``docs``, the model, and the verdicts by ``doc_id``."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    threshold, verdicts = draw(stash(score(docs, model), "importance"), model.k)
    return threshold, model, verdicts


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return production(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)[2]
