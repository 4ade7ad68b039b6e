"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint has eight positional bytes.  Two that differ in at most ``BITS`` = 4 bits differ in at most
four bytes, so they share at least ``SHARED`` = 4 positional bytes: that is the guaranteed count.  The index
has a list for every (position, byte); as a pair shares four of eight positions, it shares one of the first
five, so only those are indexed.  The fingerprints of a list meet in pairs: the positional bytes that a pair
shares are tallied, pairs that reach the guaranteed count are retained, and these are verified by their
differing bits.  A pair counts in one list only, that of its first shared position.

A list of one byte holds a 256th of all fingerprints.  Lists are therefore split by further positions: by as
many as bring their mean length under ``MEAN``, and those still longer than ``LONG`` once more, as often as it
takes.  By the same argument a list of ``d`` shared positions is split over the next of the first ``d + 5``.
When four whole bytes are shared, the other four go on by their eight half-bytes, of which a pair shares four
at least as well; so the longest list that is ever paired up holds 2**16 fingerprints.  No list is cut short.

Only distinct fingerprints are indexed, so exact copies cost nothing.  Lists are read in sorted order,
streamed, and never collected; a list's links come out as those of a spanning tree, not as all its pairs.

Defined cases: a null or empty text, or one of white space, has fingerprint zero and links like any other;
texts of fewer words than a shingle are one shingle; very long texts are read whole, their shingles' bits
summed 2**14 at a time; repeated rows are copies of each other; a bit that exactly half of the shingles set
(a tie) is 0; an empty table gives an empty result; of the columns only ``key`` and ``text`` are read, so
others may have any name.  ``key`` must be an integer; rows with a null key are fingerprinted, and link others
like any row, but their component is null where no key is linked to them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.arrow_map import add_columns
from auditloom.llm.components import components, with_least
from auditloom.llm.stash import stash
from auditloom.llm.text_blocks import Block

WIDTH, SEED, BITS, SHARED = 4, 42, 4, 4
#: Mean length of lists before any is split for its own length, and the length from which one is.
MEAN, LONG = 64, 2048
_BYTES, _HALVES = [0xFF << 8 * p for p in range(8)], [0xF << 4 * p for p in range(16)]


def _first_shared(digits: list[int], n: int) -> list[tuple[int, ...]]:
    """All that the first ``n`` shared ones of eight digits may be, if four or more are shared."""
    return [t for t in combinations(range(len(digits)), n) if all(p <= 4 + i for i, p in enumerate(t))]


def _levels() -> list[list[tuple[int, int]]]:
    """Lists by the number of shared digits: the mask of what a list's members share, and the list of the level
    before that it splits."""
    levels = [[(0, -1)]]
    whole = {(): 0}
    for n in range(1, 5):
        found = _first_shared(_BYTES, n)
        levels.append([(sum(_BYTES[p] for p in t), whole[t[:-1]]) for t in found])
        whole = {t: i for i, t in enumerate(found)}
    halves = {(t, ()): i for t, i in whole.items()}
    for n in range(1, 5):
        level, before, halves = [], halves, {}
        for t in whole:
            rest = [h for p in range(8) if p not in t for h in (2 * p, 2 * p + 1)]
            for u in _first_shared(rest, n):
                halves[t, u] = len(level)
                level.append((sum(_BYTES[p] for p in t) | sum(_HALVES[rest[i]] for i in u), before[t, u[:-1]]))
        levels.append(level)
    return levels


_LEVELS = _levels()
_MASKS = [np.array([m for m, _ in level], np.uint64) for level in _LEVELS]


def fingerprint(text: bytes) -> int:
    """The fingerprint of one text, as a signed 64-bit integer."""
    words = text.lower().split()
    if not words:
        return 0
    clean, digest = b" ".join(words), xxhash.xxh64_digest
    n = max(1, len(words) - WIDTH + 1)
    if n == 1:
        return int.from_bytes(digest(clean, SEED), "big", signed=True)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    hashed = b"".join([digest(clean[a:b], SEED) for a, b in zip((ends - sizes)[:n].tolist(), ends[WIDTH - 1 :].tolist(), strict=True)])
    raw = np.frombuffer(hashed, np.uint8).reshape(n, 8)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 14):
        ones += np.unpackbits(raw[lo : lo + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), name: str = "fp") -> DataFrame:
    """``keep`` columns and the fingerprint (bigint) of every whole text; no shuffle."""

    def run(block: Block) -> list[pa.Array]:
        return [pa.array([fingerprint(block.text(i)) for i in range(block.hi - block.lo)], pa.int64())]

    return add_columns(docs, text, run, f"`{name}` long", keep)


def _first_masks(differ: np.ndarray, level: int) -> np.ndarray:
    """The mask of the first ``level`` digits that pairs share, of their differing bits."""
    apart = differ.view(np.uint8).reshape(-1, 8) != 0
    order = np.argsort(apart, axis=1, kind="stable")
    found = np.bitwise_or.reduce(np.left_shift(np.uint64(0xFF), 8 * order[:, : min(level, SHARED)].astype(np.uint64)), axis=1)
    if level > SHARED:
        places = np.sort(order[:, SHARED:], axis=1)
        halves = np.stack([2 * places, 2 * places + 1], axis=2).reshape(-1, 8).astype(np.uint64)
        unlike = (differ[:, None] >> 4 * halves) & np.uint64(0xF) != 0
        first = np.argsort(unlike, axis=1, kind="stable")[:, : level - SHARED]
        found |= np.bitwise_or.reduce(np.left_shift(np.uint64(0xF), 4 * np.take_along_axis(halves, first, axis=1)), axis=1)
    return found


def near_pairs(differ: np.ndarray, lists: np.ndarray, level: int) -> np.ndarray:
    """Which pairs of list members, given by their differing bits and their lists, are links of those lists."""
    shared = 8 - np.count_nonzero(differ.view(np.uint8).reshape(-1, 8), axis=1)
    retained = np.flatnonzero(shared >= SHARED)  # the count filter
    retained = retained[np.bitwise_count(differ[retained]) <= BITS]  # verification
    mine = retained[_first_masks(differ[retained], level) == _MASKS[level][lists[retained]]] if len(retained) else retained
    out = np.zeros(len(differ), bool)
    out[mine] = True
    return out


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same members as the pairs (u, v) of row numbers: at most one a member."""
    if not len(u):
        return u, v
    rows, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(rows))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (a, b):
            np.minimum.at(new, end, low)
            np.minimum.at(new, label[end], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    apart = np.flatnonzero(label != np.arange(len(rows)))
    return rows[label[apart]], rows[apart]


def _pairs(level: int, long_list: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links (u, v) of sorted (list, bytes, fp) rows; of a list that is to be split, a row (u, null) a member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 3), np.int64)  # what is known of the list that may go on in the next batch
        hot = False  # whether that list has proved long; its members have come out then, but for a first one

        def linked(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Links of complete lists."""
            if not len(rows):
                return
            lists, fp = rows[:, 0], rows[:, 2].view(np.uint64)
            edge = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]))
            size = np.diff(np.append(edge, len(rows)))
            left = np.repeat(size, size) - (np.arange(len(rows)) - np.repeat(edge, size))
            u, v = [], []
            for step in range(1, int(size.max())):
                at = np.flatnonzero(left > step)
                at = at[near_pairs(fp[at] ^ fp[at + step], lists[at], level)]
                u.append(at)
                v.append(at + step)
                if step % 256 == 0:  # pairs give way to links before they grow many
                    joined = spanning(np.concatenate(u), np.concatenate(v))
                    u, v = [joined[0]], [joined[1]]
            a, b = spanning(np.concatenate([*u, np.zeros(0, int)]), np.concatenate([*v, np.zeros(0, int)]))
            if len(a):
                yield out(np.zeros(len(a), np.int64), fp[a].view(np.int64), pa.array(fp[b].view(np.int64)))

        def out(lists: np.ndarray, u: np.ndarray, v: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), pa.array(u), v], names=["list", "u", "v"])

        for batch in batches:
            new = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            if not len(new):
                continue
            seen = len(held) if hot else 0
            rows = np.concatenate([held, new])
            edge = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1), [True]]))
            size = np.diff(edge)
            long = size > long_list
            long[0] |= hot
            whole = np.repeat(~long, size)
            whole[edge[-2] :] = False  # the last list may go on
            yield from linked(rows[whole])
            gone = np.repeat(long, size)
            gone[:seen] = False
            split = rows[gone]
            if len(split):
                yield out(split[:, 0], split[:, 2], pa.nulls(len(split), pa.int64()))
            hot = bool(long[-1])
            held = rows[edge[-2] :][: 1 if hot else None]
        if not hot:
            yield from linked(held)

    return run


def _posted(level: int, parent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Postings (list, bytes, fp) at ``level`` of the members (list, u) of lists of the level ``parent``."""
    children: list[list[int]] = [[] for _ in _LEVELS[parent]]
    for i in range(len(_LEVELS[level])):
        up = i
        for depth in range(level, parent, -1):
            up = _LEVELS[depth][up][1]
        children[up].append(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for parent_list in np.unique(lists).tolist():
                mine = fps[lists == parent_list]
                for child in children[parent_list]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), child, np.int32)), pa.array((mine & _MASKS[level][child]).view(np.int64)), pa.array(mine.view(np.int64))], names=["list", "bytes", "fp"])

    return run


def links(distinct: DataFrame, name: str = "fp", mean: int = MEAN, long_list: int = LONG) -> DataFrame:
    """Links (u, v) between distinct fingerprints that join the same fingerprints as all pairs within ``BITS``
    bits do; each link is such a pair, or one that a list's pairs join."""
    n = distinct.count()
    level, parent = 1, 0
    while level < SHARED and n > mean * 256**level:
        level += 1
    members, found = distinct.select(F.lit(0).alias("list"), F.col(name).alias("u")), []
    while True:
        last = level == len(_LEVELS) - 1
        postings = members.mapInArrow(_posted(level, parent), "list int, bytes long, fp long")
        dealt = postings.repartition("list", "bytes").sortWithinPartitions("list", "bytes", "fp")
        seen = stash(dealt.mapInArrow(_pairs(level, 1 << 16 if last else long_list), "list int, u long, v long"), "links")
        found.append(seen.where("v is not null").select("u", "v"))
        members = seen.where("v is null").select("list", "u")
        if last or members.isEmpty():
            break
        level, parent = level + 1, level
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def classes(prints: DataFrame, first: Column, name: str = "fp") -> DataFrame:
    """(``name``, ``first``): the least ``first`` among the rows of a fingerprint's component, a row a distinct
    fingerprint.  ``prints`` is read several times."""
    distinct = stash(prints.groupBy(name).agg(F.min(first).alias("first")), "distinct")
    roots = components(links(distinct.select(name), name))
    # Roots are least fingerprints; most fingerprints are linked to none, and stand for themselves.
    members = distinct.join(roots, distinct[name] == roots["node"], "left").select(name, "first", F.coalesce("root", name).alias("root"))
    return with_least(members, "root", "first", "least", name).select(name, F.col("least").alias("first"))


def assign(prints: DataFrame, key: str = "doc_id", name: str = "fp") -> DataFrame:
    """``prints`` with ``component_id``: the smallest key reachable by links."""
    found = classes(prints, F.col(key), name)
    return prints.join(found.withColumnRenamed("first", "component_id"), name)


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``fp`` and ``component_id`` of every row."""
    return assign(stash(fingerprints(docs, text, (key,)), "fingerprints"), key)


def representatives(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: Sequence[str] = ("doc_id", "text")) -> DataFrame:
    """The ``keep`` columns of one row of every component: that of the least key, rows without a key coming last;
    of several rows with that key, any one."""
    source = docs.select(*keep).withColumn("__row", F.monotonically_increasing_id())
    numbered = stash(fingerprints(source, text, (*keep, "__row"), "__fp"), "numbered")
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("__row").alias("row"))
    chosen = classes(numbered.select("__fp", key, "__row"), order, "__fp").select(F.col("first.row").alias("__row")).distinct()
    return numbered.join(chosen, "__row", "left_semi").select(*keep)


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
