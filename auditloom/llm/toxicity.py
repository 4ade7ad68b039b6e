"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A feature is the presence in a text of a hashed word, pair of neighbours, or pair with one word between;
words also count by their stem (their first bytes), so that endings unseen in fitting do not hide them.
Every coordinate has its own learning rate; L1 leaves few coordinates other than zero, so that the model is
a short list of (coordinate, weight) that any task can hold.

Fitting uses at most ``FtrlConfig.sample`` labelled rows (those with the smallest hash of their id), dealt by
that hash to ``shards`` learners.  Each learner sees exactly its shard, wherever that runs, and its weights
count in the average in proportion to its cases.  Scoring reads every whole text in one pass.

Defined cases: a null or empty text has no feature and gets the score of the bias; very long texts are read
whole, a block of their own; repeated rows are scored row by row, and of the rows of a labelled id one,
that of the least text, counts as a case;
labels that are null, or of no document, are not used; of several labels of one document the greatest
counts; ids whose hashes tie at the end of the sample go by the smaller id; without labels of both classes
every score is the share of toxic labels (0 if none); a column listed in ``keep`` that is named like the
result is an error, other columns do not matter.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.arrow_map import add_columns
from auditloom.llm.text_blocks import Block, blocks, classes, ngrams

#: Stems are so many bytes of a word. Letters, digits and all bytes beyond ASCII make words.
STEM_BYTES = 5
_WORDS = classes(bytes(b for b in range(128) if not chr(b).isalnum()), lower=True)


@dataclass(frozen=True)
class FtrlConfig:
    """``sample`` bounds the labelled rows that are fitted; ``bits`` is the size of the hash space; a toxic
    row, being rarer, counts ``toxic_weight`` times."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.1
    toxic_weight: float = 4.0
    bits: int = 21
    epochs: int = 2
    sample: int = 24_000
    shards: int = 3


@dataclass(frozen=True)
class ToxicityModel:
    """Coordinates with their weights; ``bias`` is a log-odds."""

    bits: int
    bias: float
    index: np.ndarray
    weight: np.ndarray


def features(block: Block, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of all n-grams and skip-grams in a block, and the text that each belongs to; with repeats."""
    words = block.tokens(_WORDS)
    owner = words.owner()
    found = [(ngrams(words.hashes, (), 1), owner), (ngrams(block.tokens(_WORDS, STEM_BYTES).hashes, (), 4), owner)]
    for gap, salt in ((1, 2), (2, 3)):
        inside = owner[:-gap] == owner[gap:]
        found.append((ngrams(words.hashes, (gap,), salt)[inside], owner[:-gap][inside]))
    return np.concatenate([x for x, _ in found]) >> np.uint64(64 - bits), np.concatenate([o for _, o in found])


class Ftrl:
    """The learner's state: ``z`` and ``n`` a coordinate, the last coordinate being the bias (no L1 there)."""

    def __init__(self, config: FtrlConfig):
        self.config = config
        self.z = np.zeros((1 << config.bits) + 1)
        self.n = np.zeros((1 << config.bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        c, z, n = self.config, self.z[at], self.n[at]
        l1 = np.where(at == 1 << c.bits, 0.0, c.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((c.beta + np.sqrt(n)) / c.alpha + c.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum())))) - label
        g *= self.config.toxic_weight if label else 1.0
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.config.alpha * w
        self.n[at] = n + g * g


def learn(cases: list[tuple[int, np.ndarray]], config: FtrlConfig) -> tuple[np.ndarray, np.ndarray]:
    """Live coordinates and weights of one learner that is shown (label, distinct coordinates) ``epochs`` times,
    in an order drawn anew each time from the same seed."""
    model, bias = Ftrl(config), np.array([1 << config.bits], np.int64)
    rng = np.random.default_rng(7)
    for _ in range(config.epochs):
        for i in rng.permutation(len(cases)):
            label, at = cases[i]
            model.learn(np.concatenate([at.astype(np.int64), bias]), label)
    live = np.union1d(np.flatnonzero(np.abs(model.z) > config.l1), bias)
    return live, model.weights(live)


def shard_of(hashed: int, shards: int) -> int:
    return (hashed >> 20) % shards


def _least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows (id, hash, label, text) of each id that of the least text; nulls are empty."""
    held: dict = {}
    schema = None
    for batch in batches:
        schema = batch.schema
        for key, h, y, text in zip(*[c.to_pylist() for c in batch.columns]):
            if key not in held or (text or "") < held[key][3]:
                held[key] = (key, h, y, text or "")
    rows = list(held.values())
    for lo in range(0, len(rows), 1024):
        columns = zip(*rows[lo : lo + 1024])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", config: FtrlConfig = FtrlConfig()) -> ToxicityModel:
    """A model from the rows of ``labels``. The labelled sample is bounded, so it is broadcast to one scan of ``docs``."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max(F.col(label).cast("int")).alias("__y"))
    sample = known.withColumn("__h", F.xxhash64(F.col("__key").cast("string"))).orderBy("__h", "__key").limit(config.sample)
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(sample), "__key")
    # Of rows that repeat an id one is a case, each task sending on one: so the cases are as few as the sample.
    rows = rows.select("__key", "__h", "__y", "__text").mapInArrow(_least, rows.select("__key", "__h", "__y", "__text").schema)
    shard = F.pmod(F.shiftright("__h", 20), F.lit(config.shards))
    bits = config.bits

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[int, list] = {}
        last = None
        for batch in batches:
            for block in blocks(batch.column(3), 1 << 18):
                at, owner = features(block, bits)
                pairs = np.unique((owner.astype(np.uint64) << np.uint64(bits)) | at)
                cut = np.searchsorted(pairs >> np.uint64(bits), np.arange(block.hi - block.lo + 1))
                at = (pairs & np.uint64((1 << bits) - 1)).astype(np.uint32)
                for i in range(block.hi - block.lo):
                    case, hashed, label = (batch.column(c)[block.lo + i].as_py() for c in range(3))
                    if case != last:  # a copy, or the block's coordinates would all be kept
                        mine = at[cut[i] : cut[i + 1]].copy()
                        shards.setdefault(shard_of(hashed, config.shards), []).append((hashed, label, zlib.crc32(mine), mine))
                    last = case
        while shards:
            number, cases = shards.popitem()
            cases.sort(key=lambda c: c[:3])
            live, weights = learn([(y, at) for _, y, _, at in cases], config)
            same = lambda x: pa.array(np.full(len(live), x, np.int64))
            yield pa.RecordBatch.from_arrays([same(number), same(len(cases)), same(sum(c[1] for c in cases)), pa.array(live), pa.array(weights)], names=["shard", "cases", "toxic", "at", "w"])

    # A shard lies in one task whatever the partitioner does; that each gets a task of its own only saves time.
    # Sorted, the least text of an id comes first, so no task holds its texts.
    dealt = rows.repartitionByRange(config.shards, shard).sortWithinPartitions("__key", "__text").mapInArrow(fitted, "shard long, cases long, toxic long, at long, w double")
    # A shard's weights are as many as L1 leaves of a bounded sample, whatever the size of the corpus.
    found = dealt.collect()
    shards = {r["shard"]: (r["cases"], r["toxic"]) for r in found}
    total, toxic = sum(c for c, _ in shards.values()), sum(t for _, t in shards.values())
    if not 0 < toxic < total:
        share = min(max(toxic / total if total else 0.0, 1e-6), 1 - 1e-6)
        return ToxicityModel(bits, math.log(share / (1 - share)), np.zeros(0, np.int64), np.zeros(0))
    sums: dict[int, float] = {}
    for r in sorted(found, key=lambda r: r["shard"]):
        sums[r["at"]] = sums.get(r["at"], 0.0) + r["w"] * r["cases"] / total
    bias = sums.pop(1 << bits, 0.0)
    at = sorted(sums)
    return ToxicityModel(bits, bias, np.array(at, np.int64), np.array([sums[i] for i in at]))


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: Sequence[str] = ("doc_id",), name: str = "score") -> DataFrame:
    """``keep`` columns and the score of every whole text, 0 to 1."""
    bits = model.bits
    dense: dict[str, np.ndarray] = {}

    def run(block: Block) -> list[pa.Array]:
        if not dense:
            dense["w"] = np.zeros(1 << bits, np.float32)
            dense["w"][model.index] = model.weight
        at, owner = features(block, bits)
        live = dense["w"][at] != 0
        pairs = np.unique((owner[live].astype(np.uint64) << np.uint64(bits)) | at[live])
        total = np.bincount((pairs >> np.uint64(bits)).astype(np.int64), dense["w"][pairs & np.uint64((1 << bits) - 1)], minlength=block.hi - block.lo)
        return [pa.array(1 / (1 + np.exp(-np.clip(total + model.bias, -35, 35))))]

    return add_columns(docs, text, run, f"`{name}` double", keep)


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def fit_tables(spark, docs: DataFrame, sf_dir: str) -> ToxicityModel:
    """The production model: fitted on the labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return fit(docs, labels.select("doc_id", "toxic").where(~held_out()))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, fit_tables(spark, docs, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
