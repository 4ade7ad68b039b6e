"""Adding columns that are computed from a text column's blocks, in one pass without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.text_blocks import Block, blocks

_TEXT = "__text"


def add_columns(df: DataFrame, text: str, run: Callable[[Block], list[pa.Array]], added: str, keep: Sequence[str]) -> DataFrame:
    """The ``keep`` columns of ``df`` and, after them, the ``added`` ones (a DDL string): what ``run`` makes of
    each block of ``text``, an array a column with a value a row."""
    new = T.StructType.fromDDL(added)
    clash = {c.lower() for c in keep} & {f.name.lower() for f in new}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are made here; rename them before")
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(_TEXT))
    schema = T.StructType([source.schema[c] for c in keep] + new.fields)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for block in blocks(texts):
                kept = [batch.column(i).slice(block.lo, block.hi - block.lo) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(kept + run(block), names=schema.names)

    return source.mapInArrow(mapped, schema)
