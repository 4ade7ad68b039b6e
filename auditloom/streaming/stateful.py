"""Streams with state that ends by itself: a result cache with a lifetime and a capacity, and alerts that resolve when
their time is up, whether or not another value comes.

State is kept a key in the state store, on disk and in the checkpoint, so that it outlives executors.  Rows of a batch
are taken in the order of their event time, and whatever was due before a row is done before it; event-time timers do
what is due after the last row.  So the outcome does not depend on how rows are dealt to batches, as long as batches
come in order.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Rows that are Python objects at a time.
PART = 16_384
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_on_disk(spark: SparkSession):
    """Streams started herein keep their state in RocksDB, which state with timers calls for."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def _sorted(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(["at", "id"], kind="stable")


def _in_order(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Times, ids and flags (null: false) of a key's rows by time and id, some at a time; of all rows only these three are
    held, in 17 bytes. Rows without a time have no place."""
    held = array("q"), array("q"), bytearray()
    for frame in frames:
        frame = frame[frame["at"].notna()]
        for column, values in zip(held, (frame["at"].astype(np.int64), frame["id"].astype(np.int64), frame["bad"].eq(True).astype(np.uint8))):
            raw = values.to_numpy().tobytes()
            column.extend(raw) if isinstance(column, bytearray) else column.frombytes(raw)
    at, ids, bad = (np.frombuffer(x, kind) for x, kind in zip(held, (np.int64, np.int64, np.uint8)))
    order = np.lexsort((ids, at))
    for lo in range(0, len(order), PART):
        part = order[lo : lo + PART]
        yield at[part], ids[part], bad[part].astype(bool)


class _Cache(StatefulProcessor):
    """State a shard: the entries (key: when it was kept, in microseconds, and the id that it came from)."""

    def __init__(self, lifetime: int, capacity: int):
        self.lifetime, self.capacity = lifetime * 1_000_000, capacity

    def init(self, handle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "key string", "at long, id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {k[0]: tuple(v) for k, v in self.entries.iterator()}
        held = dict(sorted(held.items(), key=lambda e: e[1]))  # oldest first, and so it stays
        before, out = dict(held), []
        for row in _sorted(rows).itertuples():
            kept = held.get(row.key)
            if kept and row.at - kept[0] < self.lifetime:
                out.append((key[0], row.id, True, kept[1]))
                continue
            held.pop(row.key, None)
            held[row.key] = (row.at, row.id)
            if len(held) > self.capacity:
                del held[next(iter(held))]
            out.append((key[0], row.id, False, row.id))
        for k in before.keys() - held.keys():
            self.entries.removeKey((k,))
        for k, v in held.items():
            if before.get(k) != v:
                self.entries.updateValue((k,), v)
        self._wake(held.values())
        yield pd.DataFrame(out, columns=["shard", "id", "hit", "result_id"])

    def _wake(self, kept) -> None:
        """A timer for when the oldest entry's time is up, in the place of any before."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
        if kept:
            self.handle.registerTimer((min(v[0] for v in kept) + self.lifetime) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, left = expiredTimerInfo.getExpiryTimeInMs() * 1000, []
        for k, v in list(self.entries.iterator()):
            if v[0] + self.lifetime <= now:
                self.entries.removeKey(tuple(k))
            else:
                left.append(v)
        if left:
            self.handle.registerTimer((min(v[0] for v in left) + self.lifetime) // 1000 + 1)
        return iter([])

    def close(self) -> None:
        pass


def cached(requests: DataFrame, lifetime: int = 3600, capacity: int = 1000, late: str = "0 seconds") -> DataFrame:
    """(shard, id, hit, result_id) of a stream of requests (shard, key, ts, id): whether a result not older than
    ``lifetime`` seconds is kept for the key, and the id of the request that made it.  Otherwise the request's own result
    is kept; past ``capacity`` entries a shard the oldest goes.  A shard's entries are all that its task holds."""
    rows = requests.withWatermark("ts", late).select(F.col("shard").cast("string").alias("shard"), F.col("key").cast("string").alias("key"), F.unix_micros("ts").alias("at"), F.col("id").cast("long").alias("id"), "ts")
    return rows.groupBy("shard").transformWithStateInPandas(_Cache(lifetime, capacity), "shard string, id long, hit boolean, result_id long", "Append", "EventTime")


class _Resolution(StatefulProcessor):
    """State a metric: how many of the newest values are fine, and the open alerts in order (id, when, due)."""

    def __init__(self, last: int, age: int):
        self.last, self.age = last, age * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.fine = handle.getValueState("fine", "n long")
        self.open = handle.getListState("open", "id long, at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fine = self.fine.get()[0] if self.fine.exists() else 0
        changed = 0  # since when the newest values are fine
        held = None  # open alerts (ids, times) are read only if some may be resolved
        fresh = array("q"), array("q")
        out = array("q"), array("q"), array("q")
        first = 0  # of the open alerts that are held

        def due(now: int, strictly: bool) -> None:
            """Alerts whose time was up before ``now``, with the newest values fine, are resolved when it was up."""
            nonlocal held, first
            if fine < self.last:
                return
            if held is None:
                held = self._held()
            for mine, new in zip(held, fresh):
                mine.extend(new)
                del new[:]
            ids, times = held
            while first < len(times) and (times[first] + self.age < now or not strictly and times[first] + self.age == now):
                for column, x in zip(out, (ids[first], times[first], max(times[first] + self.age, changed))):
                    column.append(x)
                first += 1
            if first > PART:
                del ids[:first], times[:first]
                first = 0

        for at, ids, bad in _in_order(rows):
            for now, number, wrong in zip(at.tolist(), ids.tolist(), bad.tolist()):
                due(now, True)
                if wrong:
                    fine = 0
                    fresh[0].append(number)
                    fresh[1].append(now)
                else:
                    fine += 1
                    if fine == self.last:
                        changed = now
                    due(now, False)
            if len(out[0]) >= PART:
                yield self._resolved(key, out)
        self.fine.update((fine,))
        if held is not None:
            ids, times = (mine[first:] + new for mine, new in zip(held, fresh))
            self.open.clear()
            held = ids, times
        else:
            ids, times = fresh
        for lo in range(0, len(ids), PART):
            self.open.appendList(list(zip(ids[lo : lo + PART], times[lo : lo + PART])))
        self._wake(fine, None if held is None else list(zip(ids[:1], times[:1])))
        yield self._resolved(key, out)

    def _held(self) -> tuple[array, array]:
        found = array("q"), array("q")
        for x in self.open.get() if self.open.exists() else ():
            found[0].append(x[0])
            found[1].append(x[1])
        return found

    def _resolved(self, key, out: tuple[array, ...]) -> pd.DataFrame:
        """The rows of ``out``, which is emptied."""
        made = pd.DataFrame({"metric": key[0], **{n: np.array(x, np.int64) for n, x in zip(("id", "at", "resolved_at"), out)}})
        for x in out:
            del x[:]
        return made[["metric", "id", "at", "resolved_at"]]

    def _wake(self, fine: int, held) -> None:
        """With the newest values fine, a timer for when the time of the first open alert is up."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
        if fine >= self.last:
            first = held[0] if held else next((tuple(x) for x in self.open.get()), None) if self.open.exists() else None
            if first:
                self.handle.registerTimer(-(-(first[1] + self.age) // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(x) for x in self.open.get()] if self.open.exists() else []
        done = [a for a in held if a[1] + self.age <= now]
        rest = held[len(done) :]
        self.open.put(rest) if rest else self.open.clear()
        if rest:
            self.handle.registerTimer(-(-(rest[0][1] + self.age) // 1000))
        yield pd.DataFrame([(key[0], a[0], a[1], a[1] + self.age) for a in done], columns=["metric", "id", "at", "resolved_at"])

    def close(self) -> None:
        pass


def resolutions(metrics: DataFrame, thresholds: DataFrame, last: int = 5, age: int = 300, late: str = "0 seconds") -> DataFrame:
    """(metric, id, ts, resolved_ts) of a stream of metrics: every value that reaches its warning is an alert; it is
    resolved ``age`` seconds later if the newest ``last`` values are fine by then, else with the first that makes them so.
    The table of thresholds has a row a metric name."""
    judged = metrics.withWatermark("ts", late).join(thresholds, "metric")
    rows = judged.select("metric", F.unix_micros("ts").alias("at"), F.col("id").cast("long").alias("id"), (F.col("value") >= F.col("warning")).alias("bad"), "ts")
    found = rows.groupBy("metric").transformWithStateInPandas(_Resolution(last, age), "metric string, id long, at long, resolved_at long", "Append", "EventTime")
    return found.select("metric", "id", F.timestamp_micros("at").alias("ts"), F.timestamp_micros("resolved_at").alias("resolved_ts"))
