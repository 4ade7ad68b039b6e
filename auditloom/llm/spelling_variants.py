"""Spelling variants: words that differ by one inserted, deleted or replaced character, by rolling-hash deletions.

Two words are near in exactly two ways.  They have one length and agree once the character at one place is
taken out of both; or one of them is the other with one character taken out.  So every word is keyed by the hash
of itself and of each of its deletions.  With prefix and suffix sums of a polynomial hash all deletions of a word
cost a few integer operations in NumPy, however long it is.  Keys are dealt by their leading bits and sorted;
only keys that meet another word's go on.  These fetch their words, and are grouped by the very string that is
left, so that words whose hashes collide part again.

No pairs are made.  Words that agree but for one place (a group, never larger than the alphabet) need the
group's size and its two most frequent words; words one longer than another word are counted for it, and each
gets that word.  What the groups say is added up a word.  Forms are followed by pointer doubling: each step leads
to a word at least ``ratio`` times as frequent, so that a few rounds reach every root.

Defined cases: a null or empty text has no words; a null id counts as the empty name; rows that repeat an id are
counted row by row; very long texts are read whole, and a very long word costs some 20 bytes a character; words
of equal frequency that compete as a form go by code points; an empty table gives an empty result; only ``key``
and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.stash import stash
from auditloom.llm.text_blocks import blocks

_RUN = re.compile("[a-zÀ-ÿ]+")
#: Two prime moduli below 2**31 with a base each: a key has their residues side by side, 62 bits.
_PRIMES = ((2_147_483_647, 911_382_323), (2_147_483_629, 972_663_749))
#: Deletions of this many characters at a time.
_BATCH = 1 << 18
_WHOLE = -1


class VariantConfig(NamedTuple):
    least_length: int = 7
    least_n: int = 2
    ratio: int = 10
    damage: int = 31


def _damaged(name: bytes, run: str, divisor: int) -> str:
    """The run, less one character where its hash with the text's name says so."""
    h = zlib.crc32(name + run.encode())
    if h % divisor:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, text: str = "text", key: str = "doc_id", config: VariantConfig = VariantConfig()) -> DataFrame:
    """(word, n): how often each word occurs, of those long and frequent enough.  Every task adds up its texts'
    words, as far as memory allows, before they are shuffled."""
    least, divisor = config.least_length, config.damage

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        chars = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            names = batch.column(0).cast(pa.string()).fill_null("")
            for block in blocks(batch.column(1)):
                for i in range(block.hi - block.lo):
                    name = names[block.lo + i].as_py().encode() + b":"
                    for run, n in Counter(_RUN.findall(block.text(i).lower().decode())).items():
                        word = _damaged(name, run, divisor) if len(run) >= least else run
                        if len(word) >= least:
                            chars += len(word) if word not in held else 0
                            held[word] += n
                if chars > 1 << 22:
                    yield out()
                    held.clear()
                    chars = 0
        yield out()

    found = docs.select(F.col(key).cast("string").alias("__key"), F.col(text).alias("__text")).mapInArrow(counted, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= config.least_n)


def _sums(values: np.ndarray, of: np.ndarray, prime: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words of one length, a row each: hashes of all prefixes and of all suffixes, and the powers of the base."""
    n, length = values.shape
    prefix, suffix, power = np.zeros((n, length + 1), np.int64), np.zeros((n, length + 1), np.int64), np.ones(length + 1, np.int64)
    for i in range(length):
        prefix[:, i + 1] = (prefix[:, i] * base + values[:, i]) % prime
        power[i + 1] = power[i] * base % prime
    for i in range(length - 1, -1, -1):
        suffix[:, i] = (suffix[:, i + 1] + values[:, i] * power[length - 1 - i]) % prime
    return prefix, suffix, power


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of words of one length, in code points: (key of each whole word, keys of its deletions, a column a place,
    whether the character differs from the one before)."""
    length = len(words[0])
    values = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length).astype(np.int64) + 1
    whole, gone = np.zeros(len(words), np.int64), np.zeros((len(words), length), np.int64)
    for prime, base in _PRIMES:
        prefix, suffix, power = _sums(values, values, prime, base)
        whole = (whole << 31) | prefix[:, length]
        # What stands after the place keeps its weights; what stands before moves up by as many characters.
        gone = (gone << 31) | (prefix[:, :length] * power[length - 1 - np.arange(length)] + suffix[:, 1:]) % prime
    fresh = np.ones((len(words), length), bool)
    fresh[:, 1:] = values[:, 1:] != values[:, :-1]
    return whole, gone, fresh


def _keyed(words: DataFrame) -> DataFrame:
    """(key, tag, id): of each word (id, word) its own key, tagged -1, and those of its deletions, tagged with twice
    the place, and one more where the character differs from the one before: the other places of a run of equal
    characters leave the same string."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_length: dict[int, list[int]] = {}
            held = batch.column(1).to_pylist()
            for i, word in enumerate(held):
                by_length.setdefault(len(word), []).append(i)
            ids = batch.column(0).to_numpy()
            for length, places in by_length.items():
                step = max(1, _BATCH // length)
                for lo in range(0, len(places), step):
                    at = places[lo : lo + step]
                    whole, gone, fresh = deletion_keys([held[i] for i in at])
                    tags = 2 * np.arange(length, dtype=np.int32)[None, :] + fresh
                    keys = np.concatenate([whole, gone.ravel()])
                    tag = np.concatenate([np.full(len(at), _WHOLE, np.int32), tags.ravel().astype(np.int32)])
                    own = np.concatenate([ids[at], np.repeat(ids[at], length)])
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(tag), pa.array(own)], names=["key", "tag", "id"])

    return words.select("id", "word").mapInArrow(keyed, "key long, tag int, id long")


def _met(keys: np.ndarray, tags: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
    """Of rows sorted by (key, tag), those whose string another word has, by the hash: (key, place, id); a place of
    -1 is a word (place -1 and ``whole``) with those that are one longer."""
    n = len(keys)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    place = np.where(tags == _WHOLE, _WHOLE, tags >> 1)
    # Replaced: the same place of the same key, more than once.
    edge = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (place[1:] != place[:-1])]))
    many = np.repeat(np.diff(np.append(edge, n)) > 1, np.diff(np.append(edge, n))) & (tags != _WHOLE)
    # Inserted: a whole word, and the deletions that leave it.
    short = np.zeros(len(starts), bool)
    short[run[tags == _WHOLE]] = True
    longer = (tags != _WHOLE) & (tags & 1 == 1) & short[run]
    some = np.zeros(len(starts), bool)
    some[run[longer]] = True
    whole = (tags == _WHOLE) & some[run]
    held = [np.flatnonzero(many), np.flatnonzero(longer), np.flatnonzero(whole)]
    at = np.concatenate(held)
    group = np.concatenate([place[held[0]], np.full(len(held[1]) + len(held[2]), _WHOLE)])
    cut = np.concatenate([place[held[0]], place[held[1]], np.full(len(held[2]), _WHOLE)])
    return [keys[at], group.astype(np.int32), cut.astype(np.int32), ids[at]]


def meetings(keyed: DataFrame) -> DataFrame:
    """(key, place, cut, id): rows of ``_keyed`` whose string, by its hash, another word has as well.  ``place`` is
    where words of one length differ, or -1 for a word and those one longer; ``cut`` is the character that a row's
    word leaves out, -1 for none.  Keys are dealt by their leading bits and sorted, outside memory if need be."""
    names = ["key", "place", "cut", "id"]

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)]
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.concatenate([old, batch.column(i).to_numpy()]) for i, old in enumerate(rest)]
            # The last key may go on in the next batch.
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            rest = [x[last:] for x in rows]
            if last:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _met(*[x[:last] for x in rows])], names=names)
        if len(rest[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _met(*rest)], names=names)

    radix = F.shiftright("key", 62 - 20)
    return keyed.repartition(radix).sortWithinPartitions("key", "tag").mapInArrow(met, "key long, place int, cut int, id long")


def near_words(words: DataFrame) -> DataFrame:
    """(id, n_near, best): of each word (id, word, n) that has any, the number of words at one edit, and the most
    frequent of them as (n, word)."""
    rows = meetings(_keyed(words)).join(words, "id")
    # In code points; a cut at -1 leaves the word whole.
    left = F.when(F.col("cut") < 0, F.col("word")).otherwise(F.concat(F.expr("left(word, cut)"), F.expr("substr(word, cut + 2)")))
    order = F.struct((-F.col("n")).alias("down"), F.col("word").alias("word"))
    rows = rows.select("key", "place", "cut", "id", order.alias("own"), left.alias("left"))
    group = Window.partitionBy("key", "place", "left")
    rows = rows.withColumn("whole", F.col("cut") < 0).withColumn("at", F.row_number().over(group.orderBy("own")))
    one = rows.select("*", F.count(F.lit(1)).over(group).alias("size"), F.min(F.when(F.col("at") == 1, F.col("own"))).over(group).alias("first"), F.min(F.when(F.col("at") == 2, F.col("own"))).over(group).alias("second"),
                      F.min(F.when(F.col("whole"), F.col("own"))).over(group).alias("short"), F.min(F.when(~F.col("whole"), F.col("own"))).over(group).alias("long"))
    inserted = F.col("place") == _WHOLE
    count = F.when(~inserted, F.col("size") - 1).when(F.col("short").isNull(), F.lit(0)).when(F.col("whole"), F.col("size") - 1).otherwise(F.lit(1))
    best = F.when(~inserted, F.when(F.col("at") == 1, F.col("second")).otherwise(F.col("first"))).when(F.col("whole"), F.col("long")).otherwise(F.col("short"))
    told = one.select("id", count.alias("count"), best.alias("best")).where(F.col("count") > 0)
    return told.groupBy("id").agg(F.sum("count").alias("n_near"), F.min("best").alias("best"))


def follow(forms: DataFrame, ratio: int = VariantConfig.ratio, most: int = (1 << 63) - 1) -> DataFrame:
    """(word, root): where the chain of each word's form (word, form) ends.  Every round doubles the steps taken; a
    chain cannot be longer than a count that grows ``ratio``-fold a step can stay below ``most``."""
    roots, steps, longest = forms.select("word", F.col("form").alias("root")), 1, 1
    while ratio**longest <= most:
        longest += 1
    while steps < longest:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("__further"))
        roots = stash(roots.join(further, "root", "left").select("word", F.coalesce("__further", "root").alias("root"), F.col("__further").isNotNull().alias("__moved")), "roots")
        moved = roots.where("__moved").limit(1).count()
        roots = roots.drop("__moved")
        if not moved:
            break
        steps *= 2
    return roots


def variants(docs: DataFrame, text: str = "text", key: str = "doc_id", config: VariantConfig = VariantConfig()) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word: the number of near words, the most frequent one if it is
    ``ratio`` times as frequent, and the end of the chain of forms."""
    words = stash(count_words(docs, text, key, config).withColumn("id", F.monotonically_increasing_id()), "words")
    told = words.join(near_words(words), "id", "left").withColumn("form_n", -F.col("best.down"))
    formed = F.col("form_n") >= config.ratio * F.col("n")
    found = stash(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.word")).alias("form"), F.when(formed, F.col("form_n")).alias("form_n")), "forms")
    roots = follow(found.where(F.col("form").isNotNull()), config.ratio)
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
