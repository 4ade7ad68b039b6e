"""Record quality of reports: completeness, consistency, accuracy, timeliness, uniqueness, business rules.

A report has report_id, title, content, author, analysts, stocks, rating, prices, dates (as text), e-mail and
phone; columns that are absent count as null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.config import LEXICONS
from auditloom.functions.scalars import days_between, parse_date, parse_number

#: Ranges of numeric fields, patterns of codes and contacts, weights and level borders.
RANGES = {"growth_rate": (-100.0, 1000.0), "pe_ratio": (0.0, 200.0), "market_cap": (0.0, 100000.0)}
STOCK = r"^\d{6}(\.(SZ|SH|BJ))?$"
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
EXCHANGE = r"\.(SZ|SH|BJ)$"
FLAGS = {"repeated_block": r"(?s)(.{20,}?)\1{2,}", "repeated_marks": "[。！？.!?]{3,}", "mixed_scripts": r"[A-Za-z]{10,}[\x{4e00}-\x{9fff}]{10,}"}
PHONE = r"^(\+86)?1[3-9]\d{9}$|^\d{3,4}-?\d{7,8}$"
WEIGHTS = {"completeness": 0.3, "consistency": 0.25, "accuracy": 0.25, "timeliness": 0.1, "uniqueness": 0.1}
LEVELS = ((0.9, "EXCELLENT"), (0.8, "GOOD"), (0.6, "FAIR"), (0.4, "POOR"))


def _sum(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(f.cast("int"), F.lit(0)) for f in flags], F.lit(0))


def _column(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def completeness(df: DataFrame) -> Column:
    """1 less a third for each missing field; a tenth less for a length outside [100, 100000]."""
    n = F.length(F.coalesce(_column(df, "content"), F.lit("")))
    return (1 - _sum([blank(_column(df, c)) for c in ("content", "author", "title")]) / 3) * F.when((n > 0) & ((n < 100) | (n > 100000)), 0.9).otherwise(1.0)


def numeric_errors(df: DataFrame) -> Column:
    price = parse_number(_column(df, "target_price").cast("string"))
    current = parse_number(_column(df, "current_price").cast("string"))
    outside = [~parse_number(_column(df, c).cast("string")).between(*r) for c, r in RANGES.items()]
    return _sum([price <= 0, current <= 0, *outside])


def format_errors(df: DataFrame) -> Column:
    bad = F.size(F.filter(F.coalesce(_column(df, "stocks", "array<string>"), F.array().cast("array<string>")), lambda s: ~s.rlike(STOCK)))
    return bad + _sum([~_column(df, "email").rlike(EMAIL), ~_column(df, "phone").rlike(PHONE)])


def date_issues(df: DataFrame, as_of: Column) -> tuple[Column, Column]:
    """Errors (published before the analysis) and warnings (dates beyond the day after ``as_of``)."""
    published, analysed = parse_date(_column(df, "publish_date").cast("string")), parse_date(_column(df, "analysis_date").cast("string"))
    late = as_of + F.expr("interval 1 day")
    return _sum([published < analysed]), _sum([published > late, analysed > late])


def timeliness(published: Column, as_of: Column) -> Column:
    """1 up to a year of age, then a line to 0 at two years; unknown dates count 1."""
    age = days_between(as_of, published)
    return F.when(age > 365, F.greatest(F.lit(0.0), 1 - (age - 365) / 365)).otherwise(1.0)


def _business(df: DataFrame) -> dict[str, Column]:
    rating, analysts, stocks = _column(df, "rating"), _column(df, "analysts", "array<string>"), _column(df, "stocks", "array<string>")
    return {"rating": ~blank(rating) & ~rating.isin(*LEXICONS.ratings), "analysts": analysts.isNotNull() & ~F.size(analysts).between(1, 10), "exchange": F.exists(stocks, lambda s: F.contains(s, F.lit(".")) & ~s.rlike(EXCHANGE))}


def business_score(df: DataFrame) -> Column:
    return F.greatest(F.lit(0.0), 1 - 0.3 * _sum(list(_business(df).values())))


def business_problems(df: DataFrame) -> Column:
    """Names of the broken business rules, joined by commas."""
    return F.concat_ws(",", *[F.when(bad, F.lit(name)) for name, bad in _business(df).items()])


def text_flags(text: Column) -> dict[str, Column]:
    return {name: text.rlike(pattern) for name, pattern in FLAGS.items()}


def check(reports: DataFrame, as_of: Column) -> DataFrame:
    """(report_id, the five scores, business, score, level, passed)."""
    errors, warnings = date_issues(reports, as_of)
    numeric, formats = numeric_errors(reports), format_errors(reports)
    published = parse_date(_column(reports, "publish_date").cast("string"))
    text = F.coalesce(_column(reports, "content"), F.lit(""))
    marks = _sum([text_flags(text)["repeated_marks"]])
    parts = {
        "completeness": completeness(reports), "consistency": F.greatest(F.lit(0.0), 1 - 0.1 * (errors + warnings + numeric + formats)),
        "accuracy": F.greatest(F.lit(0.0), 1 - 0.2 * formats - 0.1 * marks), "timeliness": timeliness(published, as_of), "uniqueness": F.lit(1.0), "business": business_score(reports),
    }
    score = reduce(lambda a, b: a + b, [F.col(k) * w for k, w in WEIGHTS.items()])
    found = reports.select("report_id", *[v.cast("double").alias(k) for k, v in parts.items()], ((F.length(text) < 200) | (errors + numeric + formats > 0)).alias("has_issue")).withColumn("score", score)
    named = reduce(lambda c, t: c.when(F.col("score") >= t[0], t[1]), LEVELS[1:], F.when(F.col("score") >= LEVELS[0][0], LEVELS[0][1])).otherwise("UNACCEPTABLE")
    return found.withColumn("level", named).withColumn("passed", (F.col("score") >= 0.6) & ~F.col("has_issue"))


def statistics(checked: DataFrame) -> DataFrame:
    return checked.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.avg(F.col("passed").cast("double")).alias("pass_rate"))


def standardise(records: DataFrame, default_title: str = "untitled") -> tuple[DataFrame, DataFrame]:
    """Reports with ids and titles, and the records that have no content."""
    content = F.col("content")
    good = records.where(~blank(content)).withColumn("report_id", F.concat(F.lit("report_"), F.substring(F.md5(content.cast("binary")), 1, 8))).withColumn("title", F.coalesce(_column(records, "title"), _column(records, "name"), F.lit(default_title)))
    return good, records.where(blank(content))


def feedback_valid(feedback: DataFrame) -> Column:
    """Ids present, rating 1 to 10, and no correct prediction of an incorrect type."""
    return ~blank(F.col("report_id")) & (F.col("rating").isNull() | F.col("rating").between(1, 10)) & ~((F.col("feedback_type") == "INCORRECT") & F.col("is_correct"))
