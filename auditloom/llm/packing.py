"""Packing token ids into fixed-length sequences by cutting stock over the histogram of piece lengths.

Documents are cut into pieces: whole sequences first, then what the binary form of the rest calls for
down to ``TAIL``, then a tail.  So there are few lengths, and the histogram, which is all that the driver
sees, is of fixed size.  Its patterns are turned into rank ranges a length; pieces are ranked within their
length (by buckets of a hash, so that no length's pieces meet in one task) and take their place by rank.

Defined cases: a null text is an empty one, of the end id alone; a very long text is encoded whole, a block of
its own, and cut into as many whole sequences as it fills; repeated rows, and rows with a null key, are packed
as rows of their own, with equal pieces (ties) ranked in no set order; an empty table gives no sequence;
``key`` may be any type; only ``key`` and ``text`` are read, so other columns may be named like results.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.cutting_stock import plan
from auditloom.llm.stash import stash
from auditloom.llm.text_blocks import BLOCK_BYTES, blocks, span_hashes

LENGTH, TAIL, END = 2048, 256, 1
#: Words that a task remembers, and pieces that a rank's bucket holds at most on average.
WORDS, BUCKET = 300_000, 100_000
#: The fixed pattern of the public vocabulary; below ``_LATIN``, text is composed as it stands.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_LATIN = "\u0100"


def _kinds() -> np.ndarray:
    """Kinds of bytes: 0 white space, 1 in letters, 2 marks, 3 digits, 4 what the plain cut leaves to the pattern."""
    kinds = np.full(256, 4, np.uint8)
    for b in range(33, 127):
        kinds[b] = 1 if chr(b).isalpha() else 3 if chr(b).isdigit() else 2
    kinds[list(b" \t\n\x0b\x0c\r")] = 0
    kinds[list(b"'<")] = 4
    kinds[0x80:0xC0] = kinds[0xC3] = 1
    return kinds


_KINDS, _SPACE = _kinds(), re.compile(rb"[ \t\n\x0b\x0c\r]")


class ChunkEncoder:
    """Ids of texts, as little-endian 32-bit bytes, by way of white-space-separated chunks: the vocabulary
    drops white space, so a text's ids are its chunks' ids end to end.  Chunks of ASCII and of the letters from
    U+00C0 to U+00FF come apart into lower-case words, digits and marks, a block at a time; other chunks stay
    whole and, if of Latin letters, come apart by the pattern.  A part met again isn't encoded.  Words are
    encoded many at a time; their ids part where a token bears the vocabulary's end of word."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            end = json.load(f)["model"]["end_of_word_suffix"]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith(end)]] = True
        self.known: dict[bytes, bytes] = {}

    def one(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        for lo in range(0, len(words), 1024):
            part = words[lo : lo + 1024]
            ids = self.one(" ".join(part))
            cuts = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            if len(cuts) != len(part) + 1:
                raise ValueError("words must end in a token that ends a word")
            raw = ids.tobytes()
            yield from zip(part, [raw[a:b] for a, b in zip(cuts, cuts[1:])])

    def learn(self, plain: list[bytes], whole: list[bytes]) -> None:
        """Words, and chunks that the plain cut leaves whole."""
        self.known.update(zip(plain, [ids for _, ids in self.words([w.decode() for w in plain])]))
        apart: dict[bytes, list[str]] = {}
        for chunk in whole:
            s = chunk.decode()
            if max(s) < _LATIN and "<|" not in s:
                apart[chunk] = _WORDS.findall(s.lower())
            else:
                self.known[chunk] = self.one(s).tobytes()
        ids_of = dict(self.words(list(set().union(*apart.values()))))
        self.known.update((c, b"".join(map(ids_of.__getitem__, words))) for c, words in apart.items())

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text; a text beyond a block is cut at white space, so that memory is a block's."""
        if sum(map(len, texts)) <= BLOCK_BYTES:
            return self._together(texts)
        return [b"".join(self._together([part])[0] for part in _parts(text)) for text in texts]

    def _together(self, texts: list[bytes]) -> list[bytes]:
        if len(self.known) > WORDS:
            self.known.clear()
        raw = b"".join(texts)
        data, at = np.frombuffer(raw, np.uint8), np.cumsum([0, *map(len, texts)])
        if not raw:
            return [b""] * len(texts)
        data, kind = _folded(data, at)
        edge = np.ones(len(raw) + 1, bool)
        edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 3)
        edge[at] = True
        part = kind != 0
        starts, ends = np.flatnonzero(edge[:-1] & part), np.flatnonzero(edge[1:] & part) + 1
        if not len(starts):
            return [b""] * len(texts)
        _, first, of = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        where, back = np.flatnonzero(part), starts[first][of] - starts
        same = ((ends - starts) == (ends - starts)[first][of]).all() and np.array_equal(data[where], data[where + np.repeat(back, ends - starts)])
        if not same:  # two parts of one hash: every part counts as its own
            first = of = np.arange(len(starts))
        raw = data.tobytes()
        keys = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        new: tuple[dict, dict] = {}, {}
        for key, left in zip(keys, (kind[starts[first]] == 4).tolist()):
            if key not in self.known:
                new[left][key] = None
        self.learn(*map(list, new))
        ids = [self.known[k] for k in keys]
        sizes = np.array([len(x) // 4 for x in ids])
        begins, counts = np.cumsum(sizes) - sizes, sizes[of]
        upto = np.concatenate([[0], np.cumsum(counts)])
        out = np.frombuffer(b"".join(ids), "<u4")[np.repeat(begins[of] - upto[:-1], counts) + np.arange(upto[-1])].tobytes()
        cuts = (4 * upto[np.searchsorted(starts, at)]).tolist()
        return [out[a:b] for a, b in zip(cuts, cuts[1:])]


def _parts(text: bytes) -> Iterator[bytes]:
    lo = 0
    while lo < len(text):
        space = _SPACE.search(text, lo + BLOCK_BYTES)
        hi = space.start() if space else len(text)
        yield text[lo:hi]
        lo = hi


def _folded(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes, in lower case where their chunk comes apart plainly, and their kinds; a chunk that does not is all of kind 4."""
    kind = _KINDS[data]
    wide = np.concatenate([[False], data[:-1] == 0xC3])
    odd = (kind == 4) | wide & ((data == 0x97) | (data == 0xB7))  # the signs of times and division
    upper = (data >= 65) & (data <= 90) | wide & (data >= 0x80) & (data <= 0x9E)
    if odd.any():
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = (kind[1:] == 0) != (kind[:-1] == 0)
        edge[at] = True
        starts = np.flatnonzero(edge)  # of chunks and of what is between
        lengths = np.diff(starts)
        inside = np.repeat(np.logical_or.reduceat(odd, starts[:-1]), lengths)
        kind[inside] = 4
        upper &= ~inside
    return data + (upper.view(np.uint8) << 5), kind


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def cuts(tokens: int) -> list[int]:
    """The lengths of a document's pieces, in order."""
    whole, rest = divmod(tokens, LENGTH)
    out, part = [LENGTH] * whole, LENGTH // 2
    while part >= TAIL:
        if rest & part:
            out.append(part)
        part //= 2
    return out + [rest % TAIL] * bool(rest % TAIL)


def pieces(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """A row a piece: key, start, length, ids_crc32, doc_tokens and, if asked for, the ids (binary)."""
    source = docs.select(F.col(f"`{key}`").alias("doc_key"), F.col(f"`{text}`").alias("__text"))
    extra = ", ids binary" if with_ids else ""
    key_type = source.schema["doc_key"].dataType.simpleString()

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                rows = []
                for i, ids in enumerate(encoder(path).encode([block.text(i) for i in range(block.hi - block.lo)])):
                    ids += END.to_bytes(4, "little")
                    start, total = 0, len(ids) // 4
                    for n in cuts(total):
                        part = ids[4 * start : 4 * (start + n)]
                        rows.append((block.lo + i, start, n, zlib.crc32(part), total, *[part] * with_ids))
                        start += n
                columns = list(zip(*rows))
                made = [pa.array(c, pa.int64()) for c in columns[1:5]] + [pa.array(c, pa.binary()) for c in columns[5:]]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0])), *made], names=["doc_key", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])

    return source.mapInArrow(mapped, f"doc_key {key_type}, start long, length long, ids_crc32 long, doc_tokens long{extra}").withColumnRenamed("doc_key", key)


def place(cut: DataFrame, key: str = "doc_id") -> DataFrame:
    """``cut`` pieces with ``sequence_id`` and ``offset``; ``cut`` is read three times."""
    cut = cut.withColumn("__size", F.col("length").cast("int"))
    histogram = dict(cut.groupBy("__size").count().collect())  # a row a length
    total = sum(histogram.values())
    rows = plan(histogram, LENGTH)
    spark = cut.sparkSession
    # As many rows as patterns have lengths: bounded by the square of the number of lengths.
    planned = spark.createDataFrame(rows, "p_size int, p_lo long, p_hi long, p_sequence long, p_each long, p_slot long")
    buckets = max(64, -(-total // BUCKET))
    bucketed = cut.withColumn("__bucket", F.pmod(F.xxhash64(key, "start"), F.lit(buckets)))
    counts = bucketed.groupBy("__size", "__bucket").count()
    before = counts.withColumn("__before", F.sum("count").over(Window.partitionBy("__size").orderBy("__bucket")) - F.col("count")).select("__size", "__bucket", "__before")
    ranked = bucketed.join(before, ["__size", "__bucket"]).withColumn("__rank", F.col("__before") + F.row_number().over(Window.partitionBy("__size", "__bucket").orderBy(key, "start")) - 1)
    at = F.col("__rank") - F.col("p_lo")
    placed = ranked.join(F.broadcast(planned), (F.col("__size") == F.col("p_size")) & (F.col("__rank") >= F.col("p_lo")) & (F.col("__rank") < F.col("p_hi")))
    placed = placed.withColumn("sequence_id", F.col("p_sequence") + F.floor(at / F.col("p_each")).cast("long")).withColumn("__slot", F.col("p_slot") + at % F.col("p_each"))
    order = Window.partitionBy("sequence_id").orderBy("__slot")
    placed = placed.withColumn("offset", F.sum("length").over(order) - F.col("length"))
    return placed.select(*[c for c in cut.columns if c != "__size"], "sequence_id", "offset")


def pack(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """All documents' pieces with their places; with ids, the rows of a sequence by offset are its content."""
    return place(stash(pieces(docs, path, text, key, with_ids), "pieces"), key)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
