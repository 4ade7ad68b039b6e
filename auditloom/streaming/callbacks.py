"""What happens with each batch of a stream: several sinks, each told once of a batch, and metrics of the run itself."""

from __future__ import annotations

import threading
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from auditloom.sources.shared import exists, mark

Sink = Callable[[DataFrame, int], None]


def files_sink(path: str, condition: Column | None = None) -> Sink:
    """Rows (those of the condition) as Parquet, a folder a batch: a batch that comes again takes its own place."""

    def write(batch: DataFrame, number: int) -> None:
        (batch if condition is None else batch.where(condition)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def call_sink(send: Callable[[int, list], None], size: int = 1000) -> Sink:
    """``send`` of the batch's number and up to ``size`` rows at a time, on the executors.  A task that runs again sends
    again, with the same number: that is for the receiver to tell by."""

    def deliver(batch: DataFrame, number: int) -> None:
        def each(rows) -> None:
            held = []
            for row in rows:
                held.append(row.asDict())
                if len(held) == size:
                    send(number, held)
                    held = []
            if held:
                send(number, held)

        batch.foreachPartition(each)

    return deliver


def fan_out(sinks: dict[str, Sink], ledger: str) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: every sink gets every batch.  A sink that is done with a batch is noted under
    ``ledger``, in the shared folder, and is not told of it again; one that fails does not stop the others, is noted
    with its error, and gets the batch anew when it is replayed."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        todo = {n: s for n, s in sinks.items() if not exists(spark, f"{ledger}/done/{n}/{number}")}
        if not todo:
            return
        kept = batch.persist()
        try:
            for name, sink in todo.items():
                try:
                    sink(kept, number)
                except Exception as error:
                    mark(spark, f"{ledger}/failed/{name}/{number}", f"{type(error).__name__}: {error}"[:2000])
                else:
                    mark(spark, f"{ledger}/done/{name}/{number}", "done")
        finally:
            kept.unpersist()

    return each


def deliveries(spark: SparkSession, ledger: str) -> DataFrame:
    """(sink, batch, state, error) of what the ledger holds."""
    found = spark.read.option("recursiveFileLookup", True).option("wholetext", True).text(ledger).select(F.input_file_name().alias("file"), "value")
    part = lambda k: F.element_at(F.split("file", "/"), F.lit(k))
    return found.select(part(-2).alias("sink"), part(-1).cast("long").alias("batch"), part(-3).alias("state"), F.when(part(-3) == "failed", F.col("value")).alias("error"))


class Progress(NamedTuple):
    """A number of one trigger of a query."""

    query: str
    batch: int
    ts: str
    metric: str
    value: float


class ProgressLog(StreamingQueryListener):
    """Listens to streams and keeps a row a trigger and number: rows, rates, durations, state, and whatever the stream
    observes.  ``rows`` hands them over as a metric table for the monitoring operators."""

    def __init__(self, most: int = 100_000):
        self.most, self.kept, self.ended = most, [], threading.Event()

    def onQueryStarted(self, event) -> None:
        self.ended.clear()

    def onQueryProgress(self, event) -> None:
        p = event.progress
        numbers = {"input_rows": p.numInputRows, "input_rate": p.inputRowsPerSecond, "rate": p.processedRowsPerSecond, "state_rows": sum(s.numRowsTotal for s in p.stateOperators)}
        numbers |= {f"ms_{phase}": ms for phase, ms in (p.durationMs or {}).items()}
        for name, row in (p.observedMetrics or {}).items():
            numbers |= {f"{name}_{k}": v for k, v in row.asDict().items()}
        self.kept += [Progress(p.name or str(p.id), p.batchId, p.timestamp, k, float(v)) for k, v in numbers.items() if isinstance(v, (int, float)) and v == v]
        del self.kept[: -self.most]  # the oldest go

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()

    def rows(self, spark: SparkSession) -> DataFrame:
        """(query, metric, ts, value, id) of all that was heard; the id is the number of the batch."""
        schema = "query string, id long, ts string, metric string, value double"
        return spark.createDataFrame([tuple(x) for x in self.kept], schema).select("query", "metric", F.to_timestamp("ts").alias("ts"), "value", "id")


def listened(spark: SparkSession, run: Callable[[], None], wait: float = 30.0) -> ProgressLog:
    """The log of the stream that ``run`` starts and waits for."""
    log = ProgressLog()
    spark.streams.addListener(log)
    try:
        run()
        log.ended.wait(wait)  # news of a stream come after it
    finally:
        spark.streams.removeListener(log)
    return log


def observed(stream: DataFrame, name: str, *counts: Column) -> DataFrame:
    """``stream`` whose progress also tells ``counts`` of each trigger."""
    return stream.observe(name, *counts)

