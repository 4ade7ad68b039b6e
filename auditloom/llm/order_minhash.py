"""Order MinHash fingerprints, in built-in functions only.

A text's k-mers are runs of ``K`` words; in scripts that set no spaces between words each character is a
word.  Every k-mer is numbered by its occurrence and hashed with that number.  The hashes lie on a ring, and
each of ``SKETCHES`` = 64 sketches has a point of the ring: it keeps the two k-mers that come next after its
point, puts them back into text order, and hashes the ordered pair.  So a sketch agrees between two texts
only if both k-mers are in both, and in the same order, which is what an edit disturbs; and every sketch of
a text of two k-mers or more holds a pair, however short the text.  The likeness of two fingerprints is the
share of sketches that agree.

A k-mer is one integer of 33 bits of hash above 31 bits of position, more than an array can have places, so
that sorting and grouping work on plain arrays of integers.

Defined cases: null, empty and white-space texts have the empty fingerprint, and are wholly alike; texts of
fewer words than ``K`` have one k-mer, which all sketches hash alone; of k-mers whose hashes tie the one that
stands first in the text comes first; very long texts are read whole, in one array of a task.  In
``with_next``, documents are ordered by id; rows that repeat an id each get a result, next to the least text
of the next smaller id; a table of one id is next to itself; rows with a null id come last of all; an empty
table gives an empty result; of the table only the two named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.stash import stash

K, SKETCHES = 3, 64
_PLACE_BITS = 31
_PLACE = (1 << _PLACE_BITS) - 1
#: Scripts that set no spaces between words.
_UNSPACED = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}])"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _hashed(*parts: Column, place: Column) -> Column:
    return F.xxhash64(*parts).bitwiseAND(F.lit(~_PLACE)).bitwiseOR(place.cast("long"))


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_PLACE).cast("long"))


def _kind(x: Column) -> Column:
    return F.shiftright(x, _PLACE_BITS)


def _bin(x: Column) -> Column:
    """The number of sketch points up to a hash, from its sign on: sorted hashes have rising bins."""
    return F.shiftright(x, 58) + SKETCHES // 2


def _positions(items: Column) -> Column:
    return F.sequence(F.lit(0), F.size(items) - 1)


def _kmers(words: Column) -> Column:
    heads = F.slice(words, F.lit(1), F.greatest(F.size(words) - (K - 1), F.lit(1)))
    return F.transform(heads, lambda w, i: _hashed(w, *[F.get(words, i + j) for j in range(1, K)], place=i))


def _numbered(kmers: Column) -> Column:
    """Sorted k-mers, hashed again with their number among equal ones."""
    kind = lambda i: _kind(F.get(kmers, i))
    starts = F.filter(_positions(kmers), lambda i: (i == 0) | (kind(i) != kind(i - 1)))

    def runs(at: Column) -> Column:
        run = lambda s, j: F.slice(kmers, s + 1, F.coalesce(F.get(at, j + 1), F.size(kmers)) - s)
        return F.flatten(F.transform(at, lambda s, j: F.transform(run(s, j), lambda x, o: _hashed(_kind(x), o, place=_place(x)))))

    return _let(starts, runs)


def _sketches(items: Column) -> Column:
    """Of sorted occurrence-numbered k-mers, a number a sketch: its place above 32 bits of its pair's hash."""
    heads = F.filter(_positions(items), lambda i: (i == 0) | (_bin(F.get(items, i)) != _bin(F.get(items, i - 1))))
    bin_at = lambda i: _bin(F.get(items, i))

    def starts(at: Column) -> Column:
        """The item next after every sketch's point: a head for all bins since the head before, the first again
        for those after the last."""
        since = lambda h, j: F.when(j == 0, bin_at(h) + 1).otherwise(bin_at(h) - bin_at(F.get(at, j - 1)))
        upto = F.flatten(F.transform(at, lambda h, j: F.array_repeat(h, since(h, j).cast("int"))))
        return F.concat(upto, F.array_repeat(F.lit(0), F.lit(SKETCHES) - F.size(upto)))

    def sketch(i: Column, number: Column) -> Column:
        a, b = F.get(items, i), F.get(items, F.when(i + 1 < F.size(items), i + 1).otherwise(0))
        pair = F.when(F.size(items) == 1, F.xxhash64(_kind(a))).when(_place(a) < _place(b), F.xxhash64(_kind(a), _kind(b))).otherwise(F.xxhash64(_kind(b), _kind(a)))
        return F.shiftleft(number.cast("long"), 32).bitwiseOR(F.shiftrightunsigned(pair, 32))

    return _let(heads, lambda at: _let(starts(at), lambda all_starts: F.transform(all_starts, sketch)))


def signature(text: Column) -> Column:
    """The fingerprint of a text as an array of integers, a number a sketch."""
    space = " \t\n\x0b\x0c\r"
    apart = F.when(F.rlike(text, F.lit(_UNSPACED)), F.regexp_replace(text, _UNSPACED, " $1 ")).otherwise(text)
    trimmed = F.btrim(F.coalesce(apart, F.lit("")), F.lit(space))

    def full(t: Column) -> Column:
        split = lambda words: _let(F.sort_array(_kmers(words)), lambda kmers: _let(F.sort_array(_numbered(kmers)), _sketches))
        return F.when(t == "", F.array().cast("array<bigint>")).otherwise(_let(F.split(t, f"[{space}]+"), split))

    return _let(trimmed, full)


def as_text(sig: Column) -> Column:
    """A fingerprint as a string: eight hexadecimal digits a sketch."""
    return F.concat_ws("", F.transform(sig, lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")))


def likeness(a: Column, b: Column) -> Column:
    """The share of sketches in which two fingerprints agree, 0 to 1."""
    none = F.size(a) + F.size(b) == 0
    return F.when(none, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / SKETCHES)


def _takers(ids: DataFrame) -> DataFrame:
    """For ids (id, n): who takes text from each document, and from how long a text: (donor, taker, taker_n).
    Ids are dealt by range; only the first id of each range meets the other ranges' first ids."""
    ranged = stash(ids.repartitionByRange("id").withColumn("part", F.spark_partition_id()), "ranges")
    first = ranged.groupBy("part").agg(F.min(F.struct("id", "n")).alias("first"))
    over = Window.orderBy("part")  # a row a partition
    ends = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = first.select("part", F.coalesce(F.lead("first").over(over), F.first("first").over(ends)).alias("after"))
    inside = ranged.withColumn("taker", F.lead(F.struct("id", "n")).over(Window.partitionBy("part").orderBy("id")))
    found = inside.join(after, "part").withColumn("taker", F.coalesce("taker", "after"))
    return found.select(F.col("id").alias("donor"), F.col("taker.id").alias("taker"), F.col("taker.n").alias("taker_n"))


def with_next(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row a document: (key, n_chars, edited, sig, edited_sig, next_sig), the edited text having its last half
    replaced by the beginning of the next document in descending order of ids.  Texts are shuffled once by id,
    and what is taken of them once more."""
    # A null id is one before all others.
    kind = docs.schema[key].dataType
    ordered = F.struct(F.col(key).isNotNull().alias("known"), F.coalesce(F.col(key), F.lit(0).cast(kind)).alias("value"))
    base = docs.select(ordered.alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    ids = base.groupBy("id").agg(F.max(F.char_length("body")).alias("n"))
    signed = base.withColumn("sig", signature(F.col("body")))
    given = signed.join(_takers(ids), signed["id"] == F.col("donor")).select(F.col("taker").alias("id"), F.struct(F.left("body", F.floor(F.col("taker_n") / 2).cast("int")).alias("start"), F.col("sig").alias("next_sig")).alias("given"))
    given = given.groupBy("id").agg(F.min("given").alias("given"))
    n = F.char_length("body")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("body", n - half), F.left("given.start", half))
    both = signed.join(given, "id").select("id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sig", F.col("given.next_sig").alias("next_sig"))
    told = both.select(F.when(F.col("id.known"), F.col("id.value")).alias(key), "n_chars", "edited", "sig", "next_sig")
    return told.withColumn("edited_sig", signature(F.col("edited")))


def op9_order_minhash(spark, sf_dir: str) -> DataFrame:
    found = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("sig")).alias("fingerprint"), as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
