"""Approximate nearest neighbours by learned partitions.

A bounded sample of the vectors makes a graph: each is linked to its nearest few.  The graph is cut into parts of
equal size with few links between them: halves along the longest axis first, then rounds in which vectors move to
the part that holds most of their neighbours, as far as there is room.  A small network learns to tell from a vector
the parts of its neighbours.  It deals every vector of the table to its most probable part, and each query to its
most probable parts, until these hold a certain probability; vectors found there are ranked by their exact cosine.

How much probability a query needs is measured: for some vectors that the network has not seen the true nearest are
found among all vectors, and the least probability is taken that finds ``recall`` of them.  So well separated data
are searched in few parts, and data without any structure in most.

Only the sample, its graph and a number a part reach the driver, all of fixed size.  Parts, of vectors and of
queries, are split into blocks by their size, and each pair of blocks meets in a row of its own, so that neither a
part that holds a third of all vectors nor one that all queries want is a task's work.

Defined cases: vectors that are null, empty or zero or hold a null or non-finite component take no part, nor do those
of another length than most (of equally frequent lengths the lesser counts); equal vectors and rows that repeat an
id are vectors of their own, each a candidate of the other; a null id makes no query and comes last among ties; a
query is given parts until these hold ``k`` other vectors, so all are found where there are fewer; ties go to the
smaller id; a table without vectors gives an empty result; only ``key`` and ``vector`` are read, so other columns
may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.stash import stash


class PartitionConfig(NamedTuple):
    #: At most so many vectors are sampled, of which at most ``held`` measure the recall.
    sample: int = 16_384
    held: int = 256
    links: int = 10
    #: A part for every so many vectors of the sample.
    per_part: int = 64
    #: By how much a part may be larger than the mean.
    slack: float = 0.05
    hidden: int = 128
    epochs: int = 24
    recall: float = 0.97
    block: int = 1024


class Router(NamedTuple):
    """A network of one hidden layer with a probability a part."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of vectors, a row each."""
        z = np.maximum(_unit(x) @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled first, so that no square overflows or vanishes."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    """A batch's vectors, a row each."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, vector) of the rows that can be compared."""
    found = rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(F.size("vector") > 0)
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return found.where(~odd & F.exists("vector", lambda x: x != 0))


def sample(rows: DataFrame, n: int, config: PartitionConfig) -> np.ndarray:
    """Up to ``config.sample`` different vectors of ``n``, those of the least hashes, in that order."""
    span = 1 << 30
    share = min(span, -(-span * 2 * config.sample // max(n, 1)))
    hashed = rows.select("vector", F.xxhash64("vector").alias("h")).where(F.pmod("h", F.lit(span)) < share)
    found = hashed.groupBy("h", "vector").agg(F.lit(1)).orderBy(F.pmod("h", F.lit(span)), "h", "vector").limit(config.sample).select("vector").collect()
    return np.array([r["vector"] for r in found], np.float64).reshape(len(found), -1)


def graph(spark, x: np.ndarray, links: int) -> np.ndarray:
    """The ``links`` nearest others of every vector of the sample, a row each; the work is dealt to tasks."""
    n, links = len(x), min(links, len(x) - 1)
    if links < 1:
        return np.zeros((n, 0), np.int64)
    units = spark.sparkContext.broadcast(_unit(x).astype(np.float32))  # bounded by the sample
    step = 256

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = units.value
        for batch in batches:
            for number in batch.column(0).to_pylist():
                lo, hi = number * step, min(n, number * step + step)
                near = u[lo:hi] @ u.T
                near[np.arange(hi - lo), np.arange(lo, hi)] = -2
                top = np.argpartition(-near, links - 1, axis=1)[:, :links]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, hi)), pa.array(list(np.sort(top, axis=1).astype(np.int64)))], names=["i", "near"])

    found = np.zeros((n, links), np.int64)
    slices = -(-n // step)
    for r in spark.range(0, slices, 1, min(slices, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(linked, "i long, near array<long>").collect():
        found[r["i"]] = r["near"]
    units.destroy()
    return found


def cut(x: np.ndarray, near: np.ndarray, parts: int, slack: float, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """The part of every vector of the sample: ``parts`` (a power of two) of nearly equal size with few links between."""
    n, of, rng = len(x), np.zeros(len(x), np.int64), np.random.default_rng(seed)
    unit = _unit(x) if n else x
    for _ in range(parts.bit_length() - 1):
        halves = np.zeros(n, np.int64)
        for part in np.unique(of):
            at = np.flatnonzero(of == part)
            own = unit[at] - unit[at].mean(axis=0)
            axis = np.linalg.eigh(own.T @ own)[1][:, -1]
            halves[at[np.argsort(own @ axis, kind="stable")[len(at) // 2 :]]] = 1
        of = 2 * of + halves
    room = int(np.ceil(n / parts * (1 + slack)))
    # Links count both ways.
    a, b = np.concatenate([np.repeat(np.arange(n), near.shape[1]), near.ravel()]), np.concatenate([near.ravel(), np.repeat(np.arange(n), near.shape[1])])
    for _ in range(rounds if parts > 1 else 0):
        ties = np.bincount(a * parts + of[b], minlength=n * parts).reshape(n, parts)
        best = ties.argmax(axis=1)
        gain = ties[np.arange(n), best] - ties[np.arange(n), of]
        wish = np.flatnonzero((gain > 0) & (rng.random(n) < 0.5))  # half at a time, so that neighbours don't swap for ever
        if not len(wish):
            continue
        wish = wish[np.argsort(-gain[wish], kind="stable")]
        sizes = np.bincount(of, minlength=parts)
        for i in wish.tolist():
            if sizes[best[i]] < room:
                sizes[of[i]] -= 1
                sizes[best[i]] += 1
                of[i] = best[i]
    return of


def learn(x: np.ndarray, near: np.ndarray, of: np.ndarray, parts: int, config: PartitionConfig, seed: int = 7) -> Router:
    """A network that tells the parts of a vector's neighbours and its own, by Adam on the cross-entropy."""
    n, rng = len(x), np.random.default_rng(seed)
    unit = _unit(x)
    d = unit.shape[1]
    held = np.concatenate([of[:, None], of[near]], axis=1)
    wanted = np.bincount((np.arange(n)[:, None] * parts + held).ravel(), minlength=n * parts).reshape(n, parts) / held.shape[1]
    weights = [rng.normal(0, np.sqrt(2.0), (d, config.hidden)), np.zeros(config.hidden), rng.normal(0, np.sqrt(1 / config.hidden), (config.hidden, parts)), np.zeros(parts)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    batch, t = 256, 0
    steps = config.epochs * -(-n // batch)
    for _ in range(config.epochs):
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            at, t = order[lo : lo + batch], t + 1
            xs = unit[at]
            h = np.maximum(xs @ weights[0] + weights[1], 0)
            z = h @ weights[2] + weights[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            dz = (p / p.sum(axis=1, keepdims=True) - wanted[at]) / len(at)
            dh = (dz @ weights[2].T) * (h > 0)
            rate = 0.01 * (1 - (t - 1) / steps)
            for i, g in enumerate((xs.T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                weights[i] = weights[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return Router(*weights)


def fit(spark, drawn: np.ndarray, config: PartitionConfig) -> tuple[Router, np.ndarray]:
    """The network, and the vectors that were kept from it to measure its recall."""
    held = min(config.held, len(drawn) // 4)
    known = drawn[held:]
    parts = 1 << max(0, (len(known) // config.per_part).bit_length() - 1)
    near = graph(spark, known, config.links)
    return learn(known, near, cut(known, near, parts, config.slack), parts, config), drawn[:held]


def deal(rows: DataFrame, router: Router) -> DataFrame:
    """(id, vector, part) of every vector."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = router.probabilities(_matrix(batch.column(1))).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(part.astype(np.int32))], names=["id", "vector", "part"])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, vector array<double>, part int"
    return rows.select("id", "vector").mapInArrow(dealt, schema)


def _before(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts by falling probability, and how much probability lies in those before each of them."""
    order = np.argsort(-p, axis=1, kind="stable")
    sums = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1)
    return order, np.concatenate([np.zeros((len(p), 1)), sums[:, :-1]], axis=1)


def needed(dealt: DataFrame, router: Router, held: np.ndarray, k: int, recall: float) -> float:
    """The probability that a query's parts must hold to find ``recall`` of the ``k`` nearest: the vectors kept from the
    network are held against every vector.  A task returns the nearest that it has, the rest is put together here;
    a vector equal to one of ``held`` is left out, being itself."""
    if not len(held):
        return 1.0
    queries = _unit(held)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, part = np.full((len(queries), 0), 0.0), np.zeros((len(queries), 0), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0))
            near = queries @ _unit(x).T
            own = near > 1 - 1e-12
            score = np.concatenate([score, np.where(own, -2.0, near)], axis=1)
            part = np.concatenate([part, np.broadcast_to(batch.column(1).to_numpy().astype(np.int64), near.shape)], axis=1)
            if score.shape[1] > k:
                top = np.argpartition(-score, k - 1, axis=1)[:, :k]
                score, part = np.take_along_axis(score, top, axis=1), np.take_along_axis(part, top, axis=1)
        q = np.repeat(np.arange(len(queries)), score.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(score.ravel()), pa.array(part.ravel())], names=["q", "score", "part"])

    best = dealt.select("vector", "part").mapInArrow(found, "q long, score double, part long").where(F.col("score") > -2)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "part"))).where(F.col("rank") <= k)
    order, before = _before(router.probabilities(held))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :].repeat(len(order), axis=0), axis=1)
    asked = sorted(before[r["q"], place[r["q"], r["part"]]] for r in best.select("q", "part").collect())  # k rows a held vector
    return float(np.nextafter(asked[min(len(asked) - 1, int(np.ceil(recall * len(asked))) - 1)], 2)) if asked else 1.0


def _route(queries: DataFrame, router: Router, mass: float, sizes: np.ndarray, k: int) -> DataFrame:
    """(row, id, vector, part): every query, once for each part that it is to be searched in."""

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            order, before = _before(router.probabilities(_matrix(batch.column(2))))
            held = np.cumsum(sizes[order], axis=1) - sizes[order]
            take = (before < mass) | (held <= k)
            at = np.repeat(np.arange(batch.num_rows), take.sum(axis=1))
            for lo in range(0, len(at), 4096):
                some = batch.take(pa.array(at[lo : lo + 4096]))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(order[take][lo : lo + 4096].astype(np.int32))], names=["row", "id", "vector", "part"])

    schema = f"row long, id {queries.schema['id'].dataType.simpleString()}, vector array<double>, part int"
    return queries.select("row", "id", "vector").mapInArrow(routed, schema)


def _counts(rows: DataFrame, parts: int) -> np.ndarray:
    found = np.zeros(parts, np.int64)
    for r in rows.groupBy("part").count().collect():  # a row a part
        found[r["part"]] = r["count"]
    return found


def _blocks(rows: DataFrame, numbers: np.ndarray, others: np.ndarray, mine: str, theirs: str, block: int) -> DataFrame:
    """(part, mine, theirs, ids, rows, vectors): rows packed by part and number of block, once for every block of the
    other side that they meet."""
    kind = rows.schema["id"].dataType.simpleString()
    of = lambda a: F.element_at(F.array(*map(F.lit, a.tolist())), F.col("part") + 1)
    dealt = rows.withColumn("number", F.pmod("row", of(numbers)).cast("int"))
    dealt = dealt.repartition("part", "number").sortWithinPartitions("part", "number")

    def pack(group: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(group).combine_chunks()
        for lo in range(0, table.num_rows, block):
            some = table.slice(lo, block).combine_chunks().to_batches()[0]
            x = _matrix(some.column(2))
            ids, own = (pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), some.column(i)) for i in (1, 0))
            yield pa.RecordBatch.from_arrays([some.column(3).slice(0, 1), some.column(4).slice(0, 1), ids, own, pa.array([x.tobytes()], pa.binary())], names=["part", mine, f"{mine}_ids", f"{mine}_rows", f"{mine}_vectors"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, key, held = [], None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part, number = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            edges = [0, *(np.flatnonzero((part[1:] != part[:-1]) | (number[1:] != number[:-1])) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if group and (key != (part[lo], number[lo]) or held >= 8 * block):
                    yield from pack(group)
                    group, held = [], 0
                group.append(batch.slice(lo, hi - lo))
                key, held = (part[lo], number[lo]), held + hi - lo
        if group:
            yield from pack(group)

    found = dealt.select("row", "id", "vector", "part", "number").mapInArrow(packed, f"part int, {mine} int, {mine}_ids array<{kind}>, {mine}_rows array<long>, {mine}_vectors binary")
    return found.withColumn(theirs, F.explode(F.sequence(F.lit(0), (of(others) - 1).cast("int"))))


def _meet(pairs: DataFrame, kind: str, k: int, dims: int) -> DataFrame:
    """(query_row, query_id, row, id, score): of each pair of blocks, the ``k`` nearest of each query, by the exact
    cosine, which is summed in the same way for equal vectors wherever they stand."""
    names = ["query_row", "query_id", "row", "id", "score"]

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, rows, x, q_ids, q_rows, y = (batch.column(c)[i] for c in range(6))
                x, y = (np.frombuffer(v.as_buffer(), np.float64).reshape(-1, dims) for v in (x, y))
                a, b = _unit(x), _unit(y)
                own, asked, id_values = rows.values.to_numpy(), q_rows.values.to_numpy(), ids.values
                id_order = id_values.to_numpy(zero_copy_only=False) if not id_values.null_count else np.array([np.inf if v is None else v for v in id_values.to_pylist()])
                at, to, score = [], [], []
                for lo in range(0, len(b), 128):
                    near = b[lo : lo + 128] @ a.T
                    near[asked[lo : lo + 128, None] == own[None, :]] = -3
                    edge = np.partition(near, max(0, near.shape[1] - k), axis=1)[:, max(0, near.shape[1] - k)] - 1e-9
                    q, r = np.nonzero((near >= edge[:, None]) & (near > -3))
                    exact = (b[lo + q] * a[r]).sum(axis=1)
                    order = np.lexsort((own[r], id_order[r], -exact, q))
                    q, r, exact = q[order], r[order], exact[order]
                    first = np.searchsorted(q, q)
                    keep = np.arange(len(q)) - first < k
                    at.append(lo + q[keep]), to.append(r[keep]), score.append(exact[keep])
                at, to, score = np.concatenate(at), np.concatenate(to), np.concatenate(score)
                yield pa.RecordBatch.from_arrays([pa.array(asked[at]), q_ids.values.take(pa.array(at)), pa.array(own[to]), id_values.take(pa.array(to)), pa.array(score)], names=names)

    return pairs.select("block_ids", "block_rows", "block_vectors", "asked_ids", "asked_rows", "asked_vectors").mapInArrow(met, f"query_row long, query_id {kind}, row long, id {kind}, score double")


def search(rows: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5, config: PartitionConfig = PartitionConfig()) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest found of the rows whose ``key`` (here named ``id``) meets the
    condition ``queries``, among all other rows."""
    spark = rows.sparkSession
    known = usable(rows, key, vector)
    kind = known.schema["id"].dataType.simpleString()
    lengths = [(-r["count"], r["n"]) for r in known.groupBy(F.size("vector").alias("n")).count().collect()]
    if not lengths:
        return spark.createDataFrame([], f"query_id {kind}, rank int, id {kind}, score double")
    count, dims = min(lengths)
    known = known.where(F.size("vector") == dims)
    router, held = fit(spark, sample(known, -count, config), config)
    parts = router.w2.shape[1]
    dealt = stash(deal(known, router).withColumn("row", F.monotonically_increasing_id()), "dealt")
    sizes = _counts(dealt, parts)
    mass = needed(dealt, router, held, k, config.recall)
    asked = stash(_route(dealt.where(queries), router, mass, sizes, k), "asked")
    n_blocks, n_asked = np.maximum(1, -(-sizes // config.block)), -(-_counts(asked, parts) // config.block)
    wanted = F.element_at(F.array(*map(F.lit, n_asked.tolist())), F.col("part") + 1) > 0
    left = _blocks(dealt.where(wanted), n_blocks, np.maximum(1, n_asked), "block", "asked", config.block)
    right = _blocks(asked, np.maximum(1, n_asked), n_blocks, "asked", "block", config.block)
    found = _meet(left.join(right, ["part", "block", "asked"]), kind, k, dims)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op12_learned_partitions(spark, sf_dir: str) -> DataFrame:
    found = search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)
    return found.withColumnRenamed("id", "vec_id")
