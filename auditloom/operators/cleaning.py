"""Cleaning with its steps told: which step changed a text, and the statistics of a whole batch from the same reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from auditloom.functions import text as X
from auditloom.functions.unicode import nfkc

#: Steps that are told of every text, whether or not they found anything.
ALWAYS = ("unicode_normalized", "control_chars_removed", "whitespace_normalized", "punctuation_normalized", "quotes_normalized")
#: Steps whose shares the statistics give.
COUNTED = ("html_removed", "encoding_fixed", "duplicates_removed")


def stepwise(texts: DataFrame, key: str, text: str = "content", retry: bool = False) -> DataFrame:
    """(key, original, cleaned, steps, issues, quality, length_reduction, reduction_ratio) of every text.  ``retry`` reads
    texts a second time that UTF-8 was read as Latin-1 in.  An empty text has no steps and quality 0."""
    size = lambda c: F.length(F.col(c))
    t = texts.select(key, F.col(text).alias("original")).withColumn("t0", F.coalesce("original", F.lit("")))
    t = t.withColumn("t1", X.strip_tags(F.col("t0")))
    t = t.withColumn("t2", X.drop_astral(X.redecoded(F.col("t1")) if retry else F.col("t1")))
    t = t.withColumn("t3", nfkc("t2"))
    t = t.withColumn("t4", X.commas_to_spaces(F.trim(X.normalise_space(X.drop_controls(F.col("t3"))))))
    t = t.withColumn("t5", X.without_sentences(F.col("t4"), X.LEXICONS.disclaimer))
    t = t.withColumn("t6", X.without_sentences(F.col("t5"), X.LEXICONS.advertisement))
    t = t.withColumn("t7", X.without_contacts(F.col("t6")))
    t = t.withColumn("t8", X.without_repeats(F.col("t7")))
    shorter = lambda name, before, after: F.when(size(after) < size(before), F.lit(name))
    steps = [shorter("html_removed", "t0", "t1"), F.when(F.col("t2") != F.col("t1"), F.lit("encoding_fixed")), *map(F.lit, ALWAYS), shorter("disclaimers_removed", "t4", "t5"), shorter("advertisements_removed", "t5", "t6"), shorter("contact_info_removed", "t6", "t7"), shorter("duplicates_removed", "t7", "t8")]
    none = F.col("t0") == ""
    told = t.withColumns({
        "cleaned": X.closed(F.col("t8")),
        "steps": F.when(none, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*steps))),
        "issues": F.when(none, F.array(F.lit("empty_or_invalid_input"))).otherwise(X.issues(F.col("t8"))),
    })
    reduction = size("t0") - size("cleaned")
    quality = F.when(none, F.lit(0.0)).otherwise(X.clean_quality(F.col("t0"), F.col("cleaned"), F.col("issues")))
    return told.select(key, "original", "cleaned", "steps", "issues", quality.alias("quality"), reduction.alias("length_reduction"), (reduction / F.greatest(size("t0"), F.lit(1))).alias("reduction_ratio"))


def observed(cleaned: DataFrame, name: str = "cleaning") -> tuple[DataFrame, Observation]:
    """``stepwise`` rows, and an observation that counts them while they are written or read: no second pass."""
    seen = Observation(name)
    counts = [F.count_if(F.size("steps") > 0).alias("total_processed"), F.count_if(F.size("steps") > 0).alias("total_cleaned")]
    counts += [F.count_if(F.array_contains("steps", s)).alias(s) for s in COUNTED]
    return cleaned.observe(seen, *counts, F.avg("quality").alias("mean_quality")), seen


def statistics(seen: Observation) -> dict[str, float]:
    """Counts and rates of an observation whose rows have been written."""
    found = seen.get
    total = max(found["total_processed"], 1)
    rates = {"html_removal_rate": found["html_removed"] / total, "encoding_fix_rate": found["encoding_fixed"] / total, "duplicate_removal_rate": found["duplicates_removed"] / total}
    return {"total_processed": found["total_processed"], "total_cleaned": found["total_cleaned"], "cleaning_rate": found["total_cleaned"] / total, **rates, "mean_quality": found["mean_quality"] or 0.0}
