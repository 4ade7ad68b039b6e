"""Feature tables of reports: text, numbers, time, keywords, training vectors, splits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.config import LEXICONS
from auditloom.functions import text as X
from auditloom.functions.scalars import days_between
from auditloom.sources.shared import stash


def text_features(reports: DataFrame, positive: Sequence[str] = LEXICONS.positive, negative: Sequence[str] = LEXICONS.negative, end: str = LEXICONS.sentence_end) -> DataFrame:
    """Counts, shares and readability of every text; empty pieces count as sentences."""
    t, words = F.coalesce(F.col("content"), F.lit("")), X.tokens(F.col("content"))
    n, chars, sentences = F.size(words), F.length(t), F.size(F.split(t, end))
    parts = {
        "char_count": chars, "word_count": n, "sentence_count": sentences, "paragraph_count": F.size(X.pieces(t, r"\n")), "words_per_sentence": n / sentences, "unique_ratio": X.ratio(F.size(F.array_distinct(words)), n), "mean_word": X.mean_length(words),
        "digit_count": F.regexp_count(t, F.lit("[0-9]")), "percent_count": F.regexp_count(t, F.lit("[0-9]%")), "comma_count": F.regexp_count(t, F.lit(",")), "upper_ratio": X.ratio(F.regexp_count(t, F.lit("[A-Z]")), chars),
        "positive_ratio": X.ratio(X.count_in(words, positive), n), "negative_ratio": X.ratio(X.count_in(words, negative), n), "readability": 1 / (1 + (n / sentences) / 20),
    }
    return reports.select("report_id", *[v.alias(k) for k, v in parts.items()])


def numeric_features(rows: DataFrame, key: str, price: Column, current: Column, pe: Column, growth: Column) -> DataFrame:
    return rows.select(key, F.log1p(price).alias("log_price"), F.sqrt(price).alias("sqrt_price"), (pe / 50).alias("pe_norm"), ((growth + 50) / 100).alias("growth_norm"), F.when(current != 0, price / current - 1).alias("upside"), F.when(growth != 0, pe / growth).alias("peg"))


def temporal_features(rows: DataFrame, key: str, ts: str, as_of: Column) -> DataFrame:
    """Parts of a timestamp, Monday being weekday 0, trading flags, circles and age."""
    t, pi = F.col(ts), 3.141592653589793
    hour, weekday, month = F.hour(t), F.weekday(t), F.month(t)
    parts = {
        "year": F.year(t), "month": month, "day": F.dayofmonth(t), "hour": hour, "weekday": weekday, "quarter": F.quarter(t), "is_weekend": weekday >= 5, "is_trading_hour": (weekday < 5) & hour.between(9, 14),
        "month_sin": F.sin(2 * pi * month / 12), "month_cos": F.cos(2 * pi * month / 12), "hour_sin": F.sin(2 * pi * hour / 24), "hour_cos": F.cos(2 * pi * hour / 24), "age_days": days_between(as_of, t),
    }
    return rows.select(key, *[v.alias(k) for k, v in parts.items()])


def word_shares(reports: DataFrame, k: int = 10) -> DataFrame:
    """(report_id, n_words, top_share, topk_share): shares of a report's most frequent words. Texts are dealt by report
    before their words are counted, so that the shuffle moves them once and no words after them."""
    words = reports.select("report_id", "content").repartition("report_id").select("report_id", F.explode(X.tokens(F.col("content"))).alias("word"))
    counted = words.groupBy("report_id", "word").agg(F.count(F.lit(1)).alias("n"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("report_id").orderBy(F.desc("n"), "word")))
    found = ranked.groupBy("report_id").agg(F.sum("n").alias("n_words"), F.max("n").alias("top"), F.sum(F.when(F.col("rank") <= k, F.col("n"))).alias("topk"))
    return found.select("report_id", "n_words", (F.col("top") / F.col("n_words")).alias("top_share"), (F.col("topk") / F.col("n_words")).alias("topk_share"))


def author_repetition(reports: DataFrame, above: float = 0.8) -> DataFrame:
    """(report_id, author, similarity, repetitive): word Jaccard with the author's row before, in order of ``at``. Only
    ids go through the window, as an author may have a third of all rows; word sets are joined by id."""
    order = Window.partitionBy("author").orderBy("at", "report_id")
    pairs = reports.select("report_id", "author", "at").withColumn("before", F.lag("report_id").over(order)).drop("at")
    words = stash(reports.select("report_id", F.array_distinct(X.tokens(F.col("content"))).alias("words")), "words")
    earlier = words.select(F.col("report_id").alias("before"), F.col("words").alias("words_before"))
    found = pairs.join(words, "report_id").join(earlier, "before", "left")
    found = found.withColumn("similarity", F.when(F.col("words_before").isNull(), F.lit(0.0)).otherwise(X.jaccard(F.col("words"), F.col("words_before"))))
    return found.select("report_id", "author", "similarity", (F.col("similarity") > above).alias("repetitive"))


#: Scores of ratings and codes of report types.
RATING_SCORES = {"买入": 1.0, "增持": 0.75, "中性": 0.5, "减持": 0.25, "卖出": 0.0}
TYPE_CODES = {"公司研究": 1, "行业研究": 2, "策略研究": 3, "债券研究": 4}


def metadata_features(author: Column, stocks: Column, institution: Column, rating: Column, kind: Column, ratings: dict[str, float] = RATING_SCORES, kinds: dict[str, int] = TYPE_CODES) -> dict[str, Column]:
    """Lengths, counts and codes of a record's metadata; what is unknown counts 0, a rating one half."""
    on = lambda e: F.coalesce(F.exists(stocks, lambda s: F.endswith(s, F.lit(f".{e}"))), F.lit(False)).cast("int")
    n = F.greatest(F.coalesce(F.size(stocks), F.lit(0)), F.lit(0))
    chosen = lambda column, table, other: reduce(lambda c, t: c.when(column == t[0], t[1]), list(table.items())[1:], F.when(column == next(iter(table)), next(iter(table.values())))).otherwise(other)
    return {
        "author_length": F.length(F.coalesce(author, F.lit(""))), "stock_count": n, "is_multi_stock": (n > 1).cast("int"), "has_sz": on("SZ"), "has_sh": on("SH"), "has_bj": on("BJ"),
        "institution_length": F.length(F.coalesce(institution, F.lit(""))), "rating_score": chosen(rating, ratings, 0.5), "type_code": chosen(kind, kinds, 0),
    }


def engineered(stock_count: Column, rating_score: Column, target: Column | None = None, current: Column | None = None, flags: Sequence[Column] = ()) -> dict[str, Column]:
    """Features made of those of ``text_features``, whose columns must be at hand, and of metadata; of a target and a
    current price, and of flags of timeliness (recent, trading day, market hours), where these are given."""
    c = F.col
    more = {}
    if target is not None and current is not None:
        change = F.when(current > 0, F.abs(target - current))
        more |= {"price_change": change, "relative_price_change": change / F.when(current > 0, current)}
    if flags:
        more["timeliness"] = reduce(lambda a, b: a + b, [f.cast("double") for f in flags]) / len(flags)
    return more | {
        "content_per_stock": c("char_count") / F.greatest(stock_count, F.lit(1)), "alignment": F.abs(c("positive_ratio") - rating_score), "intensity": c("positive_ratio") + c("negative_ratio"),
        "complexity": (c("unique_ratio") + F.least(c("words_per_sentence") / 50, F.lit(1.0)) + 1 - c("readability")) / 3,
    }


def feature_statistics(table: DataFrame, key: str) -> DataFrame:
    """(feature, n, mean, std, least, greatest) of every numeric column of a feature table but its key."""
    names = [f.name for f in table.schema if f.name != key and f.dataType.typeName() in ("double", "float", "integer", "long", "short", "boolean")]
    row = long_form(table, key, names).groupBy("feature")
    return row.agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("least"), F.max("value").alias("greatest"))


def long_form(table: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """(key, feature, value): a row a feature."""
    return table.select(key, *[F.col(n).cast("double").alias(n) for n in names]).unpivot([key], list(names), "feature", "value")


#: Where a parsed report keeps its texts, its categories and what is said of the file.
RECORD_TEXTS = {"title": "$.basic_info.title", "stock_name": "$.basic_info.stock_name", "report_type": "$.basic_info.report_type", "investment_summary": "$.core_content.investment_summary", "risk_warning": "$.core_content.risk_warning"}
RECORD_LISTS = {"main_logic": "$.core_content.main_logic", "key_insights": "$.deep_analysis.analysis_summary.key_insights", "analysis_strengths": "$.deep_analysis.analysis_summary.analysis_strengths", "potential_weaknesses": "$.deep_analysis.analysis_summary.potential_weaknesses"}
RECORD_CATEGORIES = {"institution": "$.basic_info.institution", "report_type": "$.basic_info.report_type", "rating": "$.investment_advice.rating", "rating_change": "$.investment_advice.rating_change", "extraction_method": "$.meta_info.extraction_method", "success": "$.meta_info.success"}
RECORD_META = {"publish_date": "$.basic_info.publish_date", "source_file": "$.source_file", "load_timestamp": "$.load_timestamp", "file_path": "$.meta_info.file_path", "processor_version": "$.meta_info.processor_version"}


def record_features(parsed: DataFrame, key: str, data: str = "data") -> DataFrame:
    """(key, texts, categories, meta) of parsed reports (variant): three structures of strings; lists are joined by
    spaces, and what a report lacks is an empty string."""
    text = lambda path: F.coalesce(F.try_variant_get(data, path, "string"), F.lit(""))
    listed = lambda path: F.coalesce(F.array_join(F.try_variant_get(data, path, "array<string>"), " "), text(path))
    texts = [text(p).alias(n) for n, p in RECORD_TEXTS.items()] + [listed(p).alias(n) for n, p in RECORD_LISTS.items()]
    return parsed.select(key, F.struct(*texts).alias("texts"), F.struct(*[text(p).alias(n) for n, p in RECORD_CATEGORIES.items()]).alias("categories"), F.struct(*[text(p).alias(n) for n, p in RECORD_META.items()]).alias("meta"))


def dynamic_numbers(rows: DataFrame, key: str, data: str = "data") -> DataFrame:
    """(key, name, value) of the top-level entries of an open record (variant): a number, or the first of a list."""
    entries = rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col(data).outer()))
    value = F.coalesce(F.try_variant_get("value", "$", "double"), F.try_variant_get("value", "$[0]", "double"))
    return entries.select(key, F.col("key").alias("name"), value.alias("value"))


#: Ratings as numbers.
RATINGS = {"买入": 1.0, "增持": 0.8, "中性": 0.5, "减持": 0.2, "卖出": 0.0}


def training_vectors(parsed: DataFrame) -> DataFrame:
    """Eight features of parsed reports (``data``: variant), and the label: a quality of 7 or more."""
    get = lambda path, kind: F.try_variant_get("data", path, kind)
    rating = F.coalesce(*[F.when(F.contains(F.coalesce(get("$.investment_advice.rating", "string"), F.lit("")), F.lit(k)), F.lit(v)) for k, v in RATINGS.items()], F.lit(0.5))
    parts = {
        "quality": get("$.meta_info.quality_score", "double"), "confidence": get("$.meta_info.confidence", "double"), "length": get("$.meta_info.text_length", "double") / 1e4, "tables": get("$.meta_info.table_count", "double"),
        "pe": F.least(get("$.financial_metrics.PE[0]", "string").try_cast("double") / 100, F.lit(2.0)), "rating": rating, "summary": F.least(F.length(get("$.core_content.investment_summary", "string")) / 1000, F.lit(2.0)), "logic": get("$.deep_analysis.logic_strength", "double"),
    }
    return parsed.select("file", *[F.coalesce(v, F.lit(0.0)).alias(k) for k, v in parts.items()]).withColumn("label", (F.col("quality") >= 7).cast("int"))


def split(rows: DataFrame, key: str, shares: tuple[float, float] = (0.7, 0.2), seed: int = 42) -> DataFrame:
    """``rows`` with ``part`` (train, validation, test), drawn by a hash of the key: the same on every run and at every size."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return rows.withColumn("part", F.when(u < shares[0], "train").when(u < sum(shares), "validation").otherwise("test"))
