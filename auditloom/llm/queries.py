"""The queries of the training-data operators, with their oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from auditloom.llm.archives import op4_warc
from auditloom.llm.bpe import op8_bpe_encoding
from auditloom.llm.chat_format import op1_chat_format
from auditloom.llm.html_density import op5_html_extraction
from auditloom.llm.learned_partitions import op12_learned_partitions
from auditloom.llm.order_minhash import op9_order_minhash
from auditloom.llm.packing import op6_packing
from auditloom.llm.quality_classifier import op7_quality_classifier
from auditloom.llm.quality_rules import OP2_SQL, op2_quality_rules
from auditloom.llm.simhash import op10_simhash_near_dedup
from auditloom.llm.spelling_variants import op11_spelling_variants
from auditloom.llm.target_sampling import op13_importance_sampling
from auditloom.llm.toxicity import op3_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_chat_format, op2_quality_rules, op3_toxicity, op4_warc, op5_html_extraction, op6_packing, op7_quality_classifier, op8_bpe_encoding, op9_order_minhash, op10_simhash_near_dedup, op11_spelling_variants, op12_learned_partitions, op13_importance_sampling)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": OP2_SQL}
