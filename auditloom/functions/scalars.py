"""Column expressions over numbers, codes, dates and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.config import THRESHOLDS


def attach(df: DataFrame, row: DataFrame) -> DataFrame:
    """``df`` with the columns of a table of one row, by a scalar subquery: neither a join nor a collect."""
    one = df.withColumn("__row", row.select(F.struct(*row.columns)).scalar())
    return one.select(*df.columns, *[F.col("__row")[c].alias(c) for c in row.columns])


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def level(score: Column) -> Column:
    """CRITICAL, HIGH, MEDIUM, LOW or NORMAL."""
    return reduce(lambda c, t: c.when(score >= t[0], t[1]), THRESHOLDS.levels[1:], F.when(score >= THRESHOLDS.levels[0][0], THRESHOLDS.levels[0][1])).otherwise("NORMAL")


def weighted(scores: list[Column], weights: tuple[float, ...]) -> Column:
    return reduce(lambda a, b: a + b, [s * w for s, w in zip(scores, weights)])


def z_score(x: Column, mean: Column, std: Column) -> Column:
    return F.abs(x - mean) / F.greatest(std, F.lit(1e-6))


def ratio_score(r: Column, high: float = 2.0) -> Column:
    """How far a ratio lies above ``high`` or below its inverse, 0 to 1."""
    return F.when(r > high, F.least((r - high) / high, F.lit(1.0))).when(r < 1 / high, F.least((1 / high - r) * high, F.lit(1.0))).otherwise(0.0)


def stock_code(code: Column) -> Column:
    """Six digits get their exchange's suffix."""
    c = F.trim(code)
    bare = c.rlike(r"^\d{6}$")
    return F.when(bare & c.rlike("^(00|30)"), F.concat(c, F.lit(".SZ"))).when(bare & c.rlike("^60"), F.concat(c, F.lit(".SH"))).when(bare & c.rlike("^(43|83|87)"), F.concat(c, F.lit(".BJ"))).otherwise(c)


def parse_date(text: Column) -> Column:
    """The first of five formats that reads the text."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-M-d", "yyyy/M/d", "yyyy年M月d日", "yyyy-M-d H:m:s", "yyyyMMdd")])


def parse_number(text: Column) -> Column:
    """A number with or without percent sign and unit; null if none can be read."""
    t = F.trim(F.replace(text, F.lit("%"), F.lit("")))
    units = (("万", 1e4), ("亿", 1e8), ("千", 1e3), ("百", 1e2))
    read = [F.when(F.contains(t, F.lit(u)), F.replace(t, F.lit(u), F.lit("")).try_cast("double") * k) for u, k in units]
    return F.coalesce(*read, t.try_cast("double"))


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days, rounded down."""
    return F.floor((F.unix_timestamp(later) - F.unix_timestamp(earlier)) / 86400)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda acc, v: acc + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def euclidean_similarity(a: Column, b: Column) -> Column:
    return 1 / (1 + F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p.cast("double") - q) * (p.cast("double") - q)), F.lit(0.0), lambda acc, v: acc + v)))


def trend_class(n: Column, slope: Column, mean: Column, std: Column, least: int = 3) -> Column:
    """VOLATILE, IMPROVING, DECLINING, STABLE; UNKNOWN for too few values."""
    return F.when(n < least, "UNKNOWN").when((mean != 0) & (std / F.abs(mean) > 0.2), "VOLATILE").when(slope > 0.01, "IMPROVING").when(slope < -0.01, "DECLINING").otherwise("STABLE")
