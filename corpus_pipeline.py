"""The corpus pipeline: toxicity filter, quality filter, near-duplicate removal, packing.

Each stage takes the documents that the one before kept and writes what it keeps; the last returns packed
pieces.  Models are fitted on the labels of the documents that reach the stage.

Defined cases: a stage reads and returns ``COLUMNS``, so further columns, whatever their names, are left
behind by the first; an empty table passes every stage as an empty one; very long texts are read whole;
ties and repeated rows are said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm import packing, quality_classifier, simhash, toxicity
from auditloom.llm.stash import stash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that score below one half; null and empty texts score as the model's bias says."""
    scored = toxicity.score(docs, toxicity.fit_tables(spark, docs, sf_dir), keep=COLUMNS)
    return scored.where(F.col("score") < 0.5).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that importance resampling draws, those tied with the last one among them; texts are
    scored again rather than shuffled. Null and empty texts have log importance 0 and are drawn like any other;
    without labels of the documents that arrive here, none is drawn."""
    threshold, model, _ = quality_classifier.production(spark, docs, sf_dir)
    if threshold is None:
        return docs.select(*COLUMNS).limit(0)
    scored = quality_classifier.score(docs, model, keep=COLUMNS)
    return scored.where(quality_classifier.gumbel_key() >= F.lit(threshold)).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every group of near-duplicates: that of the least id. Rows without an id come last; of
    repeated rows one stays; null, empty and white-space texts are one group."""
    return simhash.representatives(docs, keep=COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, packed into sequences; repeated rows are packed row by row, null texts as the end id alone."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity_stage), ("quality_classifier", quality_stage), ("simhash_near_dedup", near_dedup_stage), ("packing", packing_stage)]

#: Fitted models and tokenizers are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
