"""Vectorised tokenising and hashing of whole texts, a bounded block of UTF-8 bytes at a time.

Texts come as Arrow batches.  A block is a run of rows whose bytes together stay near ``BLOCK_BYTES``
(one longer text is a block of its own).  Tokens are runs of bytes of one class; a token's hash is a
random-coefficient polynomial over its bytes modulo 2**64, read off one prefix sum, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
ASCII_SPACE = b" \t\n\x0b\x0c\r"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_BASE = 0xD6E8FEB86659FD93
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for positions below ``n``."""
    if len(_powers.get("up", ())) < n:
        n = 1 << max(20, n.bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            _powers[name] = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))
    return _powers["up"], _powers["down"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span."""
    up, down = _power_table(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


class Classes(NamedTuple):
    """Byte classes: 0 separates; tokens are runs of one other class. ``fold`` maps bytes before hashing."""

    of: np.ndarray
    fold: np.ndarray


def classes(separators: bytes = ASCII_SPACE, other: bytes = b"", lower: bool = False) -> Classes:
    of = np.ones(256, np.uint8)
    of[list(separators)] = 0
    of[list(other)] = 2
    fold = np.arange(256)
    if lower:
        fold[65:91] += 32
    return Classes(of, _BYTE[fold])


class Tokens(NamedTuple):
    """Tokens of a block: byte spans, hashes, and where each text's tokens start (one entry more than texts)."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray

    def owner(self) -> np.ndarray:
        """The text's index in the block, a token."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


class Block(NamedTuple):
    """Rows ``lo`` to ``hi`` of a batch: their bytes end to end and the byte offsets of the texts."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def tokens(self, kinds: Classes, first: int | None = None) -> Tokens:
        """The tokens of all texts; ``first`` hashes no more than so many leading bytes of each (a stem)."""
        n = len(self.data)
        if not n:
            none = np.zeros(0, np.int64)
            return Tokens(none, none, np.zeros(0, np.uint64), np.zeros(len(self.offsets), np.int64))
        kind = kinds.of[self.data]
        edge = np.empty(n + 1, bool)
        edge[0] = edge[n] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
        edge[self.offsets] = True
        starts = np.flatnonzero(edge[:n] & (kind != 0))
        ends = np.flatnonzero(edge[1:] & (kind != 0)) + 1
        up, down = _power_table(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(kinds.fold[self.data] * up[:n], out=sums[1:])
        upto = ends if first is None else np.minimum(ends, starts + first)
        return Tokens(starts, ends, mix((sums[upto] - sums[starts]) * down[starts]), np.searchsorted(starts, self.offsets))


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The blocks of a string or binary column; nulls count as empty texts."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        yield Block(lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        lo = hi


def ngrams(hashes: np.ndarray, gaps: tuple[int, ...], salt: int) -> np.ndarray:
    """Hashes of token 0 with the tokens at ``gaps`` after it; the last ``max(gaps)`` tokens start none."""
    n = max(0, len(hashes) - max(gaps, default=0))
    x = mix(hashes[:n] + np.uint64(salt))
    for gap in gaps:
        x = mix(x * _ODD + hashes[gap : gap + n])
    return x
