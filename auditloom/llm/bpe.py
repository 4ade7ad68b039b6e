"""Byte-level BPE encoding and decoding by a walk of a trie of distinct words.

The encoding of any prefix of a word ends in one well-defined token, and the encoding of the prefix before
that token is the rest.  So one number, the last token, is the whole state of a trie node.  The node's last
token is the longest vocabulary entry that is a suffix of its path and that may follow the last token of
the path before it: two tokens may stand side by side if encoding their joined bytes gives just the two.
The distinct words of a block, sorted, are their trie in depth-first order; what a word shares with the one
before it is a path whose nodes are there already.  A node needs only nodes above it, so the states of all
nodes of one depth are found together, depth by depth, in arrays; words of more than ``TOGETHER`` bytes are
walked one after the other.

Text is split into words as the vocabulary's pre-tokeniser does: where there are but common characters, by
their classes, in arrays; what lies between two such borders and holds another character, by the pattern.
Strings of special tokens in a text become the special ids.  Each task holds one vocabulary and a bounded
table of words met lately.

Defined cases: a null text is an empty one, without ids; an empty table gives an empty result; a very long
text is encoded whole, about a megabyte at a time; merges of equal rank (ties) in a word go by the leftmost; columns
named in ``keep`` are carried along (one named like the result there is an error), others do not matter; ids outside the vocabulary decode to nothing;
null ids decode to an empty text; bytes that are not UTF-8 decode to U+FFFD; repeated rows are encoded row
by row; the vocabulary file must be readable by every executor at the same path.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.arrow_map import add_columns
from auditloom.llm.text_blocks import BLOCK_BYTES, Block, span_hashes

#: The fixed pattern of the public byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a task remembers, their bytes, and pairs of tokens that the walk of long words remembers; a table that has grown so large is emptied.
WORDS, HELD, PAIRS = 300_000, 1 << 25, 200_000
#: Words up to so many bytes are walked together, so many spans of bytes at a time.
TOGETHER, SPANS = 64, 1 << 18
_WHITE, _LETTER, _DIGIT, _MARK, _OTHER = range(5)
_PLAIN = bytes([*range(9, 14), *(b for b in range(32, 127) if b != 39)])  # 39 is the apostrophe
_SPACE = re.compile(rb" (?=[!-~\xc3-\xe0])")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _kinds() -> np.ndarray:
    """Kinds of bytes. Those of a two-byte Latin letter count as letters; other characters begin with another byte."""
    kinds = np.full(256, _OTHER, np.uint8)
    for b in _PLAIN:
        kinds[b] = _WHITE if b <= 32 else _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _MARK
    kinds[0x80:0xC0] = kinds[0xC3] = _LETTER
    return kinds


_KINDS = _kinds()
#: First bytes of characters none of which is white space.
_VISIBLE = np.isin(np.arange(256), [*range(33, 127), *range(0xC3, 0xE1), *range(0xE4, 0xF5)])


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of bytes in the vocabulary file: printable bytes stand for themselves, the
    others, in order, for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Table:
    """Numbers from 0 on by distinct 64-bit keys, looked up many at a time; -1 for others."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (8 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        at = self._slots(keys)
        while len(keys):
            free = self.values[at] < 0
            self.keys[at[free]], self.values[at[free]] = keys[free], values[free]
            left = self.keys[at] != keys
            keys, values, at = keys[left], values[left], (at[left] + 1) & self.last

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _MIX >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slots(keys)
        found = self.values[at]
        left = np.flatnonzero(found >= 0)
        left = left[self.keys[at[left]] != keys[left]]
        while len(left):
            at[left] = (at[left] + 1) & self.last
            found[left] = self.values[at[left]]
            left = left[(found[left] >= 0) & (self.keys[at[left]] != keys[left])]
        return found


class Pieces(NamedTuple):
    """The bytes of every id, end to end, and none after them."""

    data: np.ndarray
    begins: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, pieces: Sequence[bytes]) -> Pieces:
        sizes = np.array([*map(len, pieces), 0], np.int64)
        return cls(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes) - sizes, sizes)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, end to end."""
        out = []
        for lo in range(0, len(ids), SPANS):
            part = ids[lo : lo + SPANS]
            sizes = self.sizes[part]
            upto = np.cumsum(sizes)
            out.append(self.data[np.repeat(self.begins[part] - upto + sizes, sizes) + np.arange(upto[-1])])
        return np.concatenate(out) if out else np.zeros(0, np.uint8)


class Vocabulary:
    """Tokens, merge ranks and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        table = _byte_of_char()
        to_bytes = lambda s: bytes(map(table.__getitem__, s))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.id_of = {to_bytes(s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(self.id_of[a], self.id_of[b]): i for i, (a, b) in enumerate((to_bytes(a), to_bytes(b)) for a, b in merges)}
        size = 1 + max([*self.id_of.values(), *self.special.values()])
        self.bytes_of: list[bytes] = [b""] * size
        for b, i in self.id_of.items():
            self.bytes_of[i] = b
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.lengths = sorted({*map(len, self.id_of)}, reverse=True)
        self.longest = self.lengths[0]
        self.words = regex.compile(PATTERN)
        self.splits = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.left, self.right, self.made = [-1] * size, [-1] * size, [-1] * size
        for (x, y), i in self.rank.items():
            made = self.id_of[self.bytes_of[x] + self.bytes_of[y]]
            self.left[made], self.right[made], self.made[made] = x, y, i
        self._proper: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}  # what ``follows`` has said
        # Words met lately, each with its place among the sequences of ids in ``ids``, which part at ``cuts``.
        self.known: dict[bytes, int] = {}
        self.held = 0
        self.ids, self.cuts = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self._lefts, self._rights, self._made = (np.array(x, np.int32) for x in (self.left, self.right, self.made))
        self.pieces = Pieces.of(self.bytes_of)
        tokens = np.array([*self.id_of.values()], np.int64)
        keys = span_hashes(self.pieces.data, self.pieces.begins[tokens], self.pieces.begins[tokens] + self.pieces.sizes[tokens])
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two tokens of one hash")
        self._tokens = Table(keys, tokens)
        x, y = np.array([*self.rank], np.uint64).reshape(-1, 2).T
        self._ranks = Table(x << np.uint64(32) | y, np.array([*self.rank.values()], np.int32))
        self._is_proper = np.full(size, -1, np.int8)  # not known yet
        self._said = np.full(1 << 20, -1, np.int64)  # pairs that met lately, a bit each whether they may

    def merge(self, data: bytes) -> list[int]:
        """The encoding by definition: the merge of lowest rank first, the leftmost of equals."""
        ids = [self.id_of[data[i : i + 1]] for i in range(len(data))]
        while len(ids) > 1:
            best = min((self.rank.get(pair, len(self.rank)), i) for i, pair in enumerate(zip(ids, ids[1:])))
            if best[0] == len(self.rank):
                break
            i = best[1]
            ids[i : i + 2] = [self.id_of[self.bytes_of[ids[i]] + self.bytes_of[ids[i + 1]]]]
        return ids

    def proper(self, token: int) -> bool:
        """Whether a token is the encoding of its own bytes."""
        found = self._proper.get(token)
        if found is None:
            found = self._proper[token] = self.merge(self.bytes_of[token]) == [token]
        return found

    def follows(self, last: int, token: int) -> bool:
        """Whether ``token`` may stand right after ``last`` in an encoding; -1 is the start of a word.

        It may unless, at some time while the two were being built, the piece of ``last`` and the piece of
        ``token`` that then met would have merged before either was merged into its own token. The pieces
        that meet are found by undoing, one at a time, the later of the last two merges beside the border.
        """
        if not self.proper(token):
            return False
        if last < 0:
            return True
        rank, made = self.rank.get, self.made
        until_x = until_y = len(made)
        x, y = last, token
        while True:
            meet = rank((x, y))
            if meet is not None and meet < until_x and meet <= until_y:
                return False
            if made[x] > made[y]:
                until_x, x = made[x], self.right[x]
            elif made[y] >= 0:
                until_y, y = made[y], self.left[y]
            else:
                return True

    def follow(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        """``follows`` for many pairs of which ``token`` is proper."""
        pair = last.astype(np.int64) << 32 | token
        slot = (pair.view(np.uint64) * _MIX >> np.uint64(44)).astype(np.int64)
        said = self._said[slot]
        at = np.flatnonzero(said >> 1 != pair)
        if len(at):
            said[at] = pair[at] << 1 | self._follow(last[at], token[at])
            self._said[slot[at]] = said[at]
        return (said & 1).astype(bool)

    def _follow(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        may = np.ones(len(last), bool)
        at = np.flatnonzero(last >= 0)
        x, y = last[at], token[at]
        until_x = until_y = np.full(len(at), len(self.made), np.int32)
        while len(at):
            meet = self._ranks(x.astype(np.uint64) << np.uint64(32) | y.astype(np.uint64))
            no = (meet >= 0) & (meet < until_x) & (meet <= until_y)
            may[at[no]] = False
            made_x, made_y = self._made[x], self._made[y]
            undo = made_x > made_y
            on = np.flatnonzero(~no & (undo | (made_y >= 0)))
            at, x, y, undo = at[on], x[on], y[on], undo[on]
            until_x, until_y = np.where(undo, made_x[on], until_x[on]), np.where(undo, until_y[on], made_y[on])
            x, y = np.where(undo, self._rights[x], x), np.where(undo, y, self._lefts[y])
        return may

    def encode_words(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Distinct words with their ids as 32-bit integers."""
        for some, ids, counts in self.walk(words):
            raw, cuts = ids.tobytes(), (4 * np.cumsum(counts)).tolist()
            yield from zip(some, [raw[a:b] for a, b in zip([0, *cuts], cuts)])

    def walk(self, words: Iterable[bytes]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
        """Distinct words, some at a time, with their ids end to end and the number of ids of each, by a walk of the
        trie of the sorted words."""
        words = sorted(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        spans = np.cumsum(np.where(sizes <= TOGETHER, sizes * (sizes + 1) // 2, 0))
        lo = 0
        while lo < len(words):
            hi = max(lo + 1, int(np.searchsorted(spans, (spans[lo - 1] if lo else 0) + SPANS, side="right")))
            short = [w for w in words[lo:hi] if len(w) <= TOGETHER]
            if short:
                yield short, *self._by_depth(short)
            if len(short) < hi - lo:
                long = [w for w in words[lo:hi] if len(w) > TOGETHER]
                yield long, *self._one_by_one(long)
            lo = hi

    def _by_depth(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of sorted words; all nodes of one depth of the trie at a time."""
        raw = b"".join(words)
        data = np.frombuffer(raw, np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begins = np.cumsum(sizes) - sizes
        shared = np.zeros(len(words), np.int64)  # leading bytes, with the word before
        both = np.minimum(sizes[1:], sizes[:-1])
        at, n = np.arange(1, len(words)), 0
        while len(at):
            at = at[both[at - 1] > n]
            at = at[data[begins[at] + n] == data[begins[at - 1] + n]]
            n += 1
            shared[at] = n
        # Places are a word's prefixes, from the empty one on; nodes are numbered by depth, 0 is the root.
        word = np.repeat(np.arange(len(words)), sizes)
        depth = np.arange(len(data)) - begins[word] + 1
        order = np.argsort(depth.astype(np.uint8), kind="stable")
        word, depth = word[order], depth[order]
        new = depth > shared[word]
        roots = begins + np.arange(len(words))
        node_at = np.zeros(len(data) + len(words), np.int64)
        node_at[roots[word] + depth] = np.cumsum(new)
        word, depth = word[new], depth[new]
        # The spans of bytes that end in a node, the longest first.
        reach = np.minimum(depth, self.longest)
        upto = np.cumsum(reach)
        node = np.repeat(np.arange(len(word)), reach)
        length = np.repeat(upto, reach) - np.arange(upto[-1])
        ends = (begins[word] + depth)[node]
        token = self._tokens(span_hashes(data, ends - length, ends))
        at = np.flatnonzero(token >= 0)
        token = token[at]
        unknown = np.unique(token[self._is_proper[token] < 0])
        self._is_proper[unknown] = [self.proper(t) for t in unknown.tolist()]
        good = (self._is_proper[token] > 0) & (self.pieces.sizes[token] == length[at])
        at, token = at[good], token[good]
        node = node[at]
        before = node_at[(roots[word] + depth)[node] - length[at]]
        node += 1
        state, rest, count = np.full(len(word) + 1, -1, np.int32), np.zeros(len(word) + 1, np.int64), np.zeros(len(word) + 1, np.int64)
        borders = np.searchsorted(node, 1 + np.searchsorted(depth, np.arange(1, depth[-1] + 2)))
        for lo, hi in zip(borders.tolist(), borders[1:].tolist()):
            at = lo + np.flatnonzero(self.follow(state[before[lo:hi]], token[lo:hi]))
            at = at[np.append(True, node[at[1:]] != node[at[:-1]])] if len(at) else at
            here, back = node[at], before[at]
            state[here], rest[here], count[here] = token[at], back, count[back] + 1
        if (state[1:] < 0).any():
            raise ValueError("a vocabulary without all single bytes")
        at = node_at[roots + sizes]
        counts = count[at]
        to = np.cumsum(counts) - 1
        ids = np.empty(to[-1] + 1, np.int32)
        while len(at):
            ids[to] = state[at]
            on = np.flatnonzero(rest[at])
            at, to = rest[at[on]], to[on] - 1
        if not np.array_equal(self.pieces.joined(ids), data):  # a span with the hash of another token
            return self._one_by_one(words)
        return ids, counts

    def _one_by_one(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of sorted words, one word after the other."""
        out, counts = array("i"), []
        state: list[int] = [-1]  # the last token of every prefix of the path
        path = b""
        id_of, bytes_of, lengths, pairs, follows = self.id_of.get, self.bytes_of, self.lengths, self.pairs, self.follows
        if len(pairs) > PAIRS:
            pairs.clear()
        for word in words:
            n = min(len(path), len(word))
            shared = n if path[:n] == word[:n] else next(i for i in range(n) if path[i] != word[i])
            del state[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for start in [end - n for n in lengths if n <= end]:
                    token = id_of(word[start:end])
                    if token is not None:
                        pair = state[start] << 20 | token
                        good = pairs.get(pair)
                        if good is None:
                            good = pairs[pair] = follows(state[start], token)
                        if good:
                            state.append(token)
                            break
                else:
                    raise ValueError("a vocabulary without all single bytes")
            path, at, ids = word, len(word), []
            while at:
                ids.append(state[at])
                at -= len(bytes_of[state[at]])
            ids.reverse()
            out.extend(ids)
            counts.append(len(ids))
        return np.array(out, np.int32), np.array(counts, np.int64)

    def parts(self, text: bytes) -> Iterator[tuple[bytes, bool]]:
        """A text cut beside special strings, and at word borders where it is long, and whether a part is such a string."""
        if self.splits is not None and any(s.encode() in text for s in self.special):
            for part in self.splits.split(text.decode()):
                if part in self.special:
                    yield part.encode(), True
                else:
                    yield from ((p, False) for p in _cut(part.encode()))
        else:
            yield from ((p, False) for p in _cut(text))

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text as 32-bit integers end to end."""
        ids, at = self.encode_bytes([t.encode() for t in texts])
        raw, cuts = ids.tobytes(), (4 * at).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode_bytes(self, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of UTF-8 texts end to end, and where those of each text begin and the last ones end."""
        ids, counts, group, owners, held = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64), [], [], 0
        for i, text in enumerate(texts):
            for part in self.parts(text):
                if held + len(part[0]) > BLOCK_BYTES and group:
                    ids.append(self._encode(group, owners, counts))
                    group, owners, held = [], [], 0
                group.append(part)
                owners.append(i)
                held += len(part[0])
        if held:
            ids.append(self._encode(group, owners, counts))
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(counts)])

    def _encode(self, parts: list[tuple[bytes, bool]], owners: list[int], counts: np.ndarray) -> np.ndarray:
        """The ids of parts end to end; their numbers are added to ``counts`` of the owners."""
        raw = b"".join(p for p, _ in parts)
        at = np.cumsum([0, *(len(p) for p, _ in parts)])
        starts, odd = _borders(np.frombuffer(raw, np.uint8), at, [i for i, (_, special) in enumerate(parts) if special])
        offsets = np.append(starts, len(raw)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        of = words.indices.to_numpy()
        _, borders, distinct = words.dictionary.buffers()
        cuts, distinct = np.frombuffer(borders, np.int32, len(words.dictionary) + 1).tolist(), distinct.to_pybytes()
        keys = [distinct[a:b] for a, b in zip(cuts, cuts[1:])]
        if len(self.known) > WORDS or self.held > HELD:
            self.known.clear()
        if not self.known:
            self.ids, self.cuts, self.held = np.zeros(0, np.int32), np.zeros(1, np.int64), 0
            self._keep([s.encode() for s in self.special], np.array([*self.special.values()], np.int32), np.ones(len(self.special), np.int64))
        place = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(place < 0)
        if len(new):
            split = np.zeros(len(keys), bool)
            split[of[odd]] = True
            self.learn([keys[i] for i in new[~split[new]].tolist()], [keys[i] for i in new[split[new]].tolist()])
            place[new] = [self.known[keys[i]] for i in new.tolist()]
        ids, upto = self._ids_at(place[of])
        np.add.at(counts, owners, np.diff(upto[np.searchsorted(starts, at)]))
        return ids

    def _ids_at(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequences of ids end to end, and where each begins and the last one ends."""
        begins = self.cuts[place]
        sizes = self.cuts[place + 1] - begins
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return self.ids[np.repeat(begins - upto[:-1], sizes) + np.arange(upto[-1])], upto

    def learn(self, words: list[bytes], stretches: list[bytes]) -> None:
        """Words, and stretches of text that are still to be split by the pattern."""
        made = {s: [w.encode() for w in self.words.findall(s.decode())] for s in stretches}
        if made:
            words = set(words).union(*made.values()).difference(self.known)
        found = [*self.walk(words)]
        self._keep([w for some, _, _ in found for w in some], *(np.concatenate([np.zeros(0, np.int32), *(f[i] for f in found)]) for i in (1, 2)))
        made = {s: w for s, w in made.items() if s not in self.known}  # the others are one word
        if made:
            ids, upto = self._ids_at(np.array([self.known[w] for s in made.values() for w in s]))
            self._keep([*made], ids, np.diff(upto[np.cumsum([0, *map(len, made.values())])]))

    def _keep(self, words: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.cuts) - 1, len(self.cuts) - 1 + len(words))))
        self.held += sum(map(len, words))
        self.ids, self.cuts = np.concatenate([self.ids, ids]), np.concatenate([self.cuts, self.cuts[-1] + np.cumsum(counts)])


def _cut(text: bytes) -> Iterator[bytes]:
    lo = 0
    while lo < len(text):
        space = _SPACE.search(text, lo + BLOCK_BYTES) if len(text) - lo > BLOCK_BYTES else None
        hi = space.start() if space else len(text)
        yield text[lo:hi]
        lo = hi


def _borders(data: np.ndarray, at: np.ndarray, whole: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of parts that begin at ``at`` begin, and which of them are still to be split. The ``whole``
    parts stay whole.

    A border lies before every single space that a character other than white space follows. What lies between
    two of these borders and holds a character that is not common stays whole, too.
    """
    kind = _KINDS[data]
    white = kind == _WHITE
    ends, starts = at[1:][np.diff(at) > 0] - 1, at[:-1][np.diff(at) > 0]
    main = np.zeros(len(data), bool)
    main[:-1] = _VISIBLE[data[1:]]
    main[ends] = False
    main &= data == 32
    edge = np.zeros(len(data), bool)
    edge[:-1] = white[:-1] & ~white[1:]  # the last of a run of white space is its own or the next word's
    edge[ends] = False
    edge[1:] |= (kind[1:] != kind[:-1]) & ~main[:-1]
    main[starts] = True
    edge |= main
    odd = kind == _OTHER
    odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # the signs of times and division
    for i in whole:
        odd[at[i]], main[at[i] + 1 : at[i + 1]] = True, False
    if odd.any():
        first = np.flatnonzero(main)
        inside = np.repeat(np.logical_or.reduceat(odd, first), np.diff(np.append(first, len(data))))
        edge = edge & ~inside | main
    else:
        inside = odd
    starts = np.flatnonzero(edge)
    return starts, np.flatnonzero(inside[starts])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def token_bytes(path: str) -> Pieces:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    table, special = _byte_of_char(), {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = {i: bytes(map(table.__getitem__, s)) for s, i in spec["model"]["vocab"].items() if s not in special} | {i: s.encode() for s, i in special.items()}
    return Pieces.of([tokens.get(i, b"") for i in range(max(tokens) + 1)])


def encode(docs: DataFrame, path: str, text: str = "text", keep: Sequence[str] = ("doc_id",), name: str = "ids") -> DataFrame:
    """``keep`` columns and the ids (array<int>) of every whole text."""

    def run(block: Block) -> list[pa.Array]:
        ids, at = vocabulary(path).encode_bytes([block.text(i) for i in range(block.hi - block.lo)])
        return [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))]

    return add_columns(docs, text, run, f"`{name}` array<int>", keep)


def _texts(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """Texts of UTF-8 bytes end to end; bytes that are not UTF-8 become U+FFFD."""
    raw = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([b.decode("utf-8", "replace") for b in raw.to_pylist()], pa.string())


def decode(encoded: DataFrame, path: str, ids: str = "ids", keep: Sequence[str] = ("doc_id", "ids"), name: str = "decoded") -> DataFrame:
    """``keep`` columns and the text that the ids stand for, special tokens included."""
    if name.lower() in {c.lower() for c in keep}:
        raise ValueError(f"column {name} is made here; rename it before")
    source = encoded.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{ids}`").alias("__ids"))
    schema = encoded.select(*[F.col(f"`{c}`") for c in keep], F.lit("").alias(name)).schema

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = token_bytes(path)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            at = np.concatenate([[0], column.value_lengths().fill_null(0).to_numpy().astype(np.int64).cumsum()])
            lo = 0
            while lo < len(column):
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + SPANS, side="right")) - 1)
                flat = column.slice(lo, hi - lo).flatten().fill_null(-1).to_numpy()
                ids = np.where((flat >= 0) & (flat < len(pieces.sizes)), flat, len(pieces.sizes) - 1)
                sizes = np.concatenate([[0], np.cumsum(pieces.sizes[ids])])
                texts = _texts(pieces.joined(ids), sizes[at[lo : hi + 1] - at[lo]])
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns - 1)] + [texts], names=schema.names)
                lo = hi

    return source.mapInArrow(mapped, schema)


def op8_bpe_encoding(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    both = decode(encode(docs, path), path)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
