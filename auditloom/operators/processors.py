"""A registry of named processors: each is a column expression over a record, and gives every record a result row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import text as X
from auditloom.operators import quality

Processor = Callable[[DataFrame], Column]


class Registry:
    """Processors by name. ``register`` adds one or takes the place of one."""

    def __init__(self, known: dict[str, Processor] | None = None):
        self.known: dict[str, Processor] = dict(known or {})

    def register(self, name: str, processor: Processor) -> None:
        self.known[name] = processor

    def run(self, records: DataFrame, key: str, names: list[str]) -> DataFrame:
        """(key, processor, success, result, error): a row a record and processor, results as JSON. A processor succeeds
        where its result is not null. All processors share one reading of the records."""
        missing = [n for n in names if n not in self.known]
        if missing:
            raise ValueError(f"processors that are not registered: {', '.join(missing)}")
        told = [F.struct(F.lit(n).alias("processor"), F.to_json(F.struct(self.known[n](records).alias("value"))).alias("json"), self.known[n](records).isNotNull().alias("success")) for n in names]
        rows = records.select(F.col(key), F.explode(F.array(*told)).alias("r"))
        return rows.select(key, "r.processor", "r.success", F.when(F.col("r.success"), F.col("r.json")).alias("result"), F.when(~F.col("r.success"), F.lit("no result")).alias("error"))


def summary(results: DataFrame) -> DataFrame:
    """(processor, total, successful, failed, success_rate)."""
    row = results.groupBy("processor").agg(F.count(F.lit(1)).alias("total"), F.count_if("success").alias("successful"))
    return row.select("processor", "total", "successful", (F.col("total") - F.col("successful")).alias("failed"), (F.col("successful") / F.col("total")).alias("success_rate"))


def standard() -> Registry:
    """Cleaning, completeness and text measures of records with ``content``; records without content have no result."""
    has = ~quality.blank(F.col("content"))
    return Registry({
        "text_cleaning": lambda df: F.when(has, F.length(X.basic_clean(F.col("content")))),
        "quality_check": lambda df: F.when(has, quality.completeness(df)),
        "feature_extraction": lambda df: F.when(has, F.struct(F.length("content").alias("char_count"), F.size(X.tokens(F.col("content"))).alias("word_count"))),
    })
