"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

A line's hidden state is its role and whether it opens a turn; what is seen of it is its speaker marker and
how plain that is, whether a blank line stands before it, whether it ends in a question mark, and its length
class.  The model is counted from transcripts with known roles; Viterbi's best path gives the states, so that
turns without a marker are told from their surroundings, and lines inside a turn that only look like a marker
("Answer: 42", "A) first") stay as they are: a marker is taken off where the path opens a turn of its role.

Transcripts come as pieces (conversation, position, text).  A conversation is decoded in chunks of ``CHUNK``
positions, each in a task of its own: every chunk gives the best score from each state before it to each
state at its end.  These small matrices are multiplied (maximum for sum, sum for product) ``FAN`` at a time,
level by level, until a conversation has few; then the states at the borders are found from the top level
down, and each chunk finds its own path between its borders.  So no task holds more than ``FAN`` matrices or
one chunk, however long a conversation is, and the result is a best path of all.

Defined cases: null pieces are empty; blank lines inside a turn stay, those at the end of a piece belong to
nothing; pieces at one position are ordered by their text, so repeated rows follow each other; rows with a
null conversation or position are left out; a conversation without a line has no turn; an empty table gives
an empty result; a very long piece is one value of a task, read whole; where paths tie, one of the best is
taken, the same at every run; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.stash import stash

ROLES = ("system", "user", "assistant")
#: State 2 * r opens a turn of role r, state 2 * r + 1 goes on with it.
STATES, CHUNK, FAN = 6, 64, 64
_WORDS = {"system": "system|sys|instructions|context", "user": "user|human|you|me|prompter|prompt|customer|question|instruction|input|q", "assistant": "assistant|bot|ai|gpt|model|agent|answer|response|output|a"}
_MARKER = re.compile(r"^\s*(?:(?P<open><\|im_start\|>|[\[<*#(|]+)\s*)?(?:" + "|".join(f"(?P<{r}>{w})" for r, w in _WORDS.items()) + r")\s*(?P<close>[\]>*)|]+:?|:[*]*|$)\s*", re.I)
#: Words that are a marker even if they stand alone on their line.
_ALONE = frozenset("system user human assistant bot".split())
_END = re.compile(r"\s*<\|im_end\|>\s*$")
#: None, or three roles whose markers are weak or strong; blank line before; question; length class.
SYMBOLS = 7 * 2 * 2 * 3


def split_marker(line: str) -> tuple[int, bool, str]:
    """The marked role (1 to 3; 0: none), whether brackets or the like make it plain, and the line without it."""
    m = _MARKER.match(line)
    if not m or not (m["open"] or m["close"] or m[0].strip().lower() in _ALONE):
        return 0, False, line
    return 1 + next(i for i, r in enumerate(ROLES) if m[r]), bool(m["open"]), line[m.end() :]


class Line(NamedTuple):
    """A line with text: what is seen of it, its piece, its text, its marked role, its text without the marker,
    and the number of blank lines before it in its piece."""

    symbol: int
    piece: int
    text: str
    marker: int
    bare: str
    blank: int


def lines_of(pieces: list[str | None]) -> list[Line]:
    """The lines with text; a marker that stands alone on its line is read with the line after it."""
    out = []
    for i, piece in enumerate(pieces):
        blank, head = 0, ""
        for line in (piece or "").split("\n"):
            line = _END.sub("", line)
            if not line.strip():
                blank += not head
                continue
            marker, strong, bare = split_marker(line)
            if head and not marker:  # the marker's line counts with this one
                out.pop()
                marker, strong, _ = split_marker(head)
                bare, line, blank = line, f"{head}\n{line}", before
            size = 0 if len(bare) < 40 else 1 if len(bare) < 200 else 2
            kind = marker + 3 * strong if marker else 0
            out.append(Line(kind * 12 + (blank > 0) * 6 + line.rstrip().endswith("?") * 3 + size, i, line, marker, bare, blank))
            head, before, blank = line if marker and not bare.strip() else "", blank, 0
    return out


@dataclass(frozen=True)
class RoleModel:
    """Log probabilities: of the first state, of state after state, of symbol in state."""

    first: np.ndarray
    step: np.ndarray
    seen: np.ndarray


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int = 2) -> Iterator[tuple[tuple, list[tuple]]]:
    rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
    for key, group in groupby(rows, lambda r: r[:n_keys]):
        yield key, [r[n_keys:] for r in group]


def _dealt(df: DataFrame, *order: str) -> DataFrame:
    """Rows by their first two columns, each pair's in order in one partition."""
    return df.repartition("conv_id", df.columns[1]).sortWithinPartitions("conv_id", df.columns[1], *order)


def _chunked(pieces: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """The pieces with a place, by conversation and chunk."""
    placed = pieces.select("conv_id", F.floor(F.col("turn") / CHUNK).cast("long").alias("chunk"), "turn", "text", *extra)
    return placed.where(F.col("conv_id").isNotNull() & F.col("chunk").isNotNull())


def fit(labelled: DataFrame) -> RoleModel:
    """The model, counted over (conv_id, turn, text, role): each piece is one turn of a known role."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, step, seen = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, SYMBOLS))
        for (_, chunk), rows in _groups(batches):
            before, piece = -1, -1
            for line in lines_of([r[1] for r in rows]):
                state = 2 * ROLES.index(rows[line.piece][2]) + (line.piece == piece)
                seen[state, line.symbol] += 1
                if before >= 0:
                    step[before, state] += 1
                elif chunk == 0:
                    first[state] += 1
                before, piece = state, line.piece
        flat = np.concatenate([first, step.ravel(), seen.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["at", "n"])

    known = _chunked(labelled.where(F.col("role").isin(*ROLES)), ("role",))
    counted = _dealt(known, "turn", "text").mapInArrow(count, "at long, n double").groupBy("at").agg(F.sum("n").alias("n"))
    flat = np.zeros(STATES + STATES * STATES + STATES * SYMBOLS)
    for r in counted.collect():  # one row a parameter
        flat[r["at"]] = r["n"]
    first, step, seen = flat[:STATES], flat[STATES : STATES + STATES**2].reshape(STATES, STATES), flat[STATES + STATES**2 :].reshape(STATES, SYMBOLS)
    norm = lambda x: np.log((x + 0.1) / (x + 0.1).sum(axis=-1, keepdims=True))
    step = norm(step)
    for a in range(STATES):
        for r in range(3):
            if a // 2 != r:
                step[a, 2 * r + 1] = -np.inf  # a role begins with an opening line
    first = norm(first)
    first[1::2] = -np.inf
    return RoleModel(first, step, norm(seen))


def transfer(model: RoleModel, symbols: list[int]) -> np.ndarray:
    """Best scores from each state before the lines (row ``STATES``: from the start) to each state at their end."""
    score = np.full((STATES + 1, STATES), -np.inf)
    score[:STATES][np.diag_indices(STATES)] = 0
    steps = np.concatenate([model.step, model.first[None]])
    for n, symbol in enumerate(symbols):
        score = (steps if n == 0 else (score[:, :, None] + model.step).max(axis=1)) + model.seen[:, symbol]
    return score


def compose(matrices: list[np.ndarray]) -> np.ndarray:
    """The matrix of consecutive stretches from those of each."""
    score = matrices[0]
    for m in matrices[1:]:
        score = (score[:, :, None] + m[:STATES]).max(axis=1)
    return score


def walk(matrices: list[np.ndarray], before: int, last: int | None) -> list[tuple[int, int]]:
    """The best states before and at the end of each stretch, given those of all (``last`` None: the best one)."""
    score, back = np.full(STATES + 1, -np.inf), []
    score[before] = 0
    for m in matrices:
        ways = score[:, None] + m
        back.append(ways.argmax(axis=0))
        score = np.append(ways.max(axis=0), -np.inf)
    end, found = int(score.argmax()) if last is None else last, []
    for pointers in reversed(back):
        found.append((int(pointers[end]), end))
        end = found[-1][0]
    return found[::-1]


def path(model: RoleModel, symbols: list[int], before: int, last: int) -> list[int]:
    """The best states of the lines, given those before them (``STATES``: the start) and at their end."""
    score = (model.first if before == STATES else model.step[before]) + model.seen[:, symbols[0]]
    back = []
    for symbol in symbols[1:]:
        ways = score[:, None] + model.step
        back.append(ways.argmax(axis=0))
        score = ways.max(axis=0) + model.seen[:, symbol]
    states = [last]
    for pointers in reversed(back):
        states.append(int(pointers[states[-1]]))
    return states[::-1]


def _matrix(flat: list[float]) -> np.ndarray:
    return np.array(flat).reshape(STATES + 1, STATES)


def _up(place: str) -> Column:
    return F.floor(F.col(place) / FAN).cast("long")


def borders(matrices: DataFrame, lo: int, hi: int, key_type: str) -> DataFrame:
    """(conv_id, chunk, before, last) of the matrices (conv_id, chunk, scores) of chunks ``lo`` to ``hi``."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, up), rows in _groups(batches):
            yield pa.RecordBatch.from_pydict({"conv_id": [conv], "chunk": [up], "scores": [compose([_matrix(r[1]) for r in rows]).ravel().tolist()]})

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, _), rows in _groups(batches):
            before, last = rows[0][2], rows[0][3]
            ends = walk([_matrix(r[1]) for r in rows], before, None if last < 0 else last)
            yield pa.RecordBatch.from_pydict({"conv_id": [conv] * len(rows), "chunk": [r[0] for r in rows], "before": [b for b, _ in ends], "last": [e for _, e in ends]})

    scores, ends = f"conv_id {key_type}, chunk long, scores array<double>", f"conv_id {key_type}, chunk long, before long, last long"
    levels = [matrices]
    while hi - lo >= 2 * FAN:
        by_up = levels[-1].select("conv_id", _up("chunk").alias("up"), "chunk", "scores")
        levels.append(stash(_dealt(by_up, "chunk").mapInArrow(fold, scores), "matrices"))
        lo, hi = lo // FAN, hi // FAN
    top = levels.pop().select("conv_id", F.lit(0).alias("up"), "chunk", "scores", F.lit(STATES).cast("long").alias("before"), F.lit(-1).cast("long").alias("last"))
    found = stash(_dealt(top, "chunk").mapInArrow(walked, ends), "borders")
    for level in reversed(levels):
        below = level.select("conv_id", _up("chunk").alias("up"), "chunk", "scores").join(found.withColumnRenamed("chunk", "up"), ["conv_id", "up"])
        found = stash(_dealt(below, "chunk").mapInArrow(walked, ends), "borders")
    return found


def recover(pieces: DataFrame, model: RoleModel) -> DataFrame:
    """(conv_id, turn_no, role, text, rendered), a row a recovered turn, of transcript pieces (conv_id, turn, text)."""
    chunks = _chunked(pieces)
    key_type = pieces.schema["conv_id"].dataType.simpleString()

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, chunk), rows in _groups(batches):
            symbols = [line.symbol for line in lines_of([r[1] for r in rows])]
            if symbols:
                yield pa.RecordBatch.from_pydict({"conv_id": [conv], "chunk": [chunk], "scores": [transfer(model, symbols).ravel().tolist()]})

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, chunk), rows in _groups(batches):
            found = lines_of([r[1] for r in rows])
            states = path(model, [line.symbol for line in found], rows[0][2], rows[0][3])
            parts: list[list] = []
            opened = 0
            for state, line in zip(states, found):
                opened += state % 2 == 0
                opens = state % 2 == 0
                text = line.bare if opens and line.marker == 1 + state // 2 else line.text
                if parts and parts[-1][0] == opened:
                    parts[-1][2] += [""] * line.blank + [text]
                else:
                    parts.append([opened, ROLES[state // 2], ([] if opens else [""] * line.blank) + [text]])
            n = len(parts)
            yield pa.RecordBatch.from_pydict({"conv_id": [conv] * n, "chunk": [chunk] * n, "opened": [p[0] for p in parts], "role": [p[1] for p in parts], "part": ["\n".join(p[2]) for p in parts], "total": [opened] * n})

    placed = chunks.agg(F.min("chunk"), F.max("chunk")).first()
    lo, hi = (placed[0], placed[1]) if placed[0] is not None else (0, 0)
    scored = _dealt(chunks, "turn", "text").mapInArrow(matrices, f"conv_id {key_type}, chunk long, scores array<double>")
    ends = borders(stash(scored, "matrices") if hi - lo >= 2 * FAN else scored, lo, hi, key_type)
    joined = chunks.join(ends, ["conv_id", "chunk"]).select("conv_id", "chunk", "turn", "text", "before", "last")
    parts = stash(_dealt(joined, "turn", "text").mapInArrow(decode, f"conv_id {key_type}, chunk long, opened long, role string, part string, total long"), "turns")
    numbered = parts.join(_earlier(parts), ["conv_id", "chunk"]).withColumn("turn_no", F.col("earlier") + F.col("opened") - 1)
    # A turn has a part in every chunk that it reaches into.
    whole = numbered.groupBy("conv_id", "turn_no").agg(F.first("role").alias("role"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "part"))), lambda p: p["part"]), "\n").alias("text"))
    whole = whole.withColumn("text", F.btrim("text", F.lit(" \t\r\n")))
    return whole.withColumn("rendered", F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n")))


def _earlier(parts: DataFrame) -> DataFrame:
    """(conv_id, chunk, earlier): how many turns were opened in earlier chunks, summed over stretches of chunks and
    within them."""
    totals = parts.groupBy("conv_id", "chunk").agg(F.max("total").alias("total")).withColumn("stretch", F.floor(F.col("chunk") / 4096))
    before = lambda n, window: F.sum(n).over(window) - F.col(n)
    stretches = totals.groupBy("conv_id", "stretch").agg(F.sum("total").alias("n")).withColumn("base", before("n", Window.partitionBy("conv_id").orderBy("stretch")))
    inside = totals.withColumn("inside", before("total", Window.partitionBy("conv_id", "stretch").orderBy("chunk")))
    return inside.join(stretches, ["conv_id", "stretch"]).select("conv_id", "chunk", (F.col("base") + F.col("inside")).alias("earlier"))


_STYLES = {
    "system": ("System: ", "[system] ", "### System\n", "**System:** ", "<|im_start|>system\n", "### Instructions:\n"),
    "user": ("User: ", "[human] ", "### Human\n", "**You:** ", "<|im_start|>user\n", "### Instruction:\n"),
    "assistant": ("Assistant: ", "[assistant] ", "### Assistant\n", "**Bot:** ", "<|im_start|>assistant\n", "### Response:\n"),
}
_LURES = ("Answer: ", "A) ", "Question: ", "User: ", "a > ", "Context: ")


def as_transcripts(turns: DataFrame, unmarked: int = 8, close: int = 3, airy: int = 3, lured: int = 4) -> DataFrame:
    """Raw transcript pieces of the table's turns, and what is said in each (``said``): a marker style a
    conversation; about one turn in ``unmarked`` without its marker, one in ``close`` without a blank line before
    it, one in ``airy`` with blank lines inside, and one in ``lured`` with a line inside that looks like a marker."""
    pick = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "conv_id", "turn"), F.lit(n)).cast("int")
    style = F.pmod(F.xxhash64(F.lit(1), F.col("conv_id")), F.lit(6)).cast("int")
    mark = F.lit("")
    for role, marks in _STYLES.items():
        mark = F.when(F.col("role") == role, F.get(F.array(*map(F.lit, marks)), style)).otherwise(mark)
    said = F.coalesce("text", F.lit(""))
    cut = F.instr(said, "\n")
    lure = F.get(F.array(*map(F.lit, _LURES)), pick(6, len(_LURES)))
    said = F.when((pick(5, lured) == 0) & (cut > 0), F.concat(F.left(said, cut), lure, F.substr(said, cut + 1))).otherwise(said)
    said = F.when(pick(4, airy) == 0, F.replace(said, F.lit("\n"), F.lit("\n\n"))).otherwise(said)
    ending = F.when((style == 4), F.lit("<|im_end|>")).otherwise(F.lit(""))
    raw = F.concat(F.when(pick(3, close) == 0, F.lit("")).otherwise(F.lit("\n")), F.when(pick(2, unmarked) == 0, F.lit("")).otherwise(mark), said, ending, F.lit("\n"))
    return turns.select("conv_id", "turn", "role", raw.alias("text"), F.btrim(said, F.lit(" \t\r\n")).alias("said"))


def held_out() -> Column:
    return F.crc32(F.col("conv_id").cast("string")) % 5 == 0


def accuracy(turns: DataFrame) -> DataFrame:
    """Of the held-out conversations' turns (a row): how many there are, and the shares whose role, and whose role
    and text, are recovered in a turn of their own."""
    raw = as_transcripts(turns)
    found = recover(raw.where(held_out()).select("conv_id", "turn", "text"), fit(raw.where(~held_out())))
    got = found.select("conv_id", "role", "text").withColumn("by_role", F.lit(1)).dropDuplicates()
    want = raw.where(held_out()).select("conv_id", "role", F.col("said").alias("text"))
    both = want.join(got, ["conv_id", "role", "text"], "left")
    counts = found.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_found")).join(want.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "conv_id")
    same = counts.agg(F.avg((F.col("n_found") == F.col("n")).cast("double")).alias("same_number_of_turns"))
    return both.agg(F.count(F.lit(1)).alias("n_turns"), F.avg(F.coalesce("by_role", F.lit(0))).alias("role_and_text")).crossJoin(same)


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    """Roles recovered from transcripts of ``conversations``, which the decoder sees without their roles; the model
    is counted on the conversations that are not held out (crc32 of the id modulo 5 is not 0)."""
    raw = as_transcripts(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return recover(raw.select("conv_id", "turn", "text"), fit(raw.where(~held_out())))
