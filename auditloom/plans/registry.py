"""All queries of the report analytics, with the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from auditloom.plans import activity_queries, check_queries, explain_queries, family_queries, intake_queries, learner_queries, learning_queries, report_queries, segment_queries, state_queries, stream_queries, summary_queries

MODULES = (report_queries, activity_queries, learning_queries, intake_queries, summary_queries, explain_queries, family_queries, segment_queries, state_queries, stream_queries, learner_queries, check_queries)
Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistical scores of all documents, their levels counted by language."""
    return report_queries.level_by_lang(spark, sf_dir)
