"""Taking records in: market tables, key-value rows, caches, validation of requests and settings, extraction from
parsed reports, and row shaping."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Risks that a report may name, patterns of its figures, and what a quality of 100 is made of.
RISKS = ("市场风险", "政策风险", "技术风险", "经济风险", "竞争风险", "汇率风险", "流动性风险")
FIGURES = {"pe_ratios": r"PE[^0-9]*(\d+\.?\d*)", "growth_rates": r"增长[^0-9]*(\d+\.?\d*)%", "revenue_billions": r"收入[^0-9]*(\d+\.?\d*)亿"}
KEY_STOCKS = {"三花智控": ("电新", "电新"), "宇通客车": ("汽车", "汽车"), "杰瑞股份": ("机械", "机械"), "道通科技": ("科技", "海外科技"), "蓝思科技": ("电子", "电子"), "华秦科技": ("军工", "军工"), "上海港湾": ("建材", "建筑建材"), "瀚蓝环境": ("环保", "环保公用"), "安克创新": ("商社", "商社"), "亚香股份": ("化工", "能源化工")}
POINTS = {"theme": 10, "type": 10, "investment_advice": 10, "publish_date": 10, "highlights": 10, "risks": 10, "forecast": 5, "stocks": 10}
LENGTHS = ((1000, 15), (500, 10), (200, 5))


def collect(requested: DataFrame, bars: DataFrame, start: Column, end: Column) -> DataFrame:
    """(stock, status, n, first, last) of the requested stocks: what bars there are from ``start`` to before ``end``."""
    inside = bars.where((F.col("date") >= start) & (F.col("date") < end)).groupBy("stock").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))
    found = requested.select("stock").distinct().join(inside, "stock", "left")
    return found.select("stock", F.when(F.col("n").isNull(), "failed").otherwise("success").alias("status"), F.coalesce("n", F.lit(0)).alias("n"), "first", "last")


def normalised(rows: DataFrame, names: dict[str, tuple[str, str]]) -> DataFrame:
    """A connector's columns under their standard names and types: ``names`` maps standard to (source, type)."""
    return rows.select(*[F.col(source).cast(kind).alias(name) for name, (source, kind) in names.items()])


def one_record(rows: DataFrame, key: str, item: str, value: str, items: Sequence[str]) -> DataFrame:
    """Key-value rows as a record a key."""
    return rows.groupBy(key).pivot(item, list(items)).agg(F.first(value))


def fresh(cache: DataFrame, as_of: Column, hours: float) -> DataFrame:
    """The cached rows (key, updated, ...) that are not older than ``hours``, the newest of each key."""
    young = cache.where(F.unix_timestamp("updated") > F.unix_timestamp(as_of) - F.lit(hours * 3600))
    others = [c for c in cache.columns if c not in ("key", "updated")]
    return young.groupBy("key").agg(F.max(F.struct("updated", *others)).alias("r")).select("key", "r.*")


def problems(checks: dict[str, Column]) -> Column:
    """The names of the checks that fail, joined by commas; a check that is null fails too."""
    return F.concat_ws(",", *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])


def request_problems(content: Column, thresholds: Column, start: Column, end: Column, action: Column, actions: Sequence[str] = ("resolve", "dismiss", "escalate")) -> Column:
    """A request: a text of 10 to 50 000 characters, thresholds from 0 to 1, a range that does not run backwards, a known action."""
    return problems({"content": F.length(content).between(10, 50_000), "thresholds": F.forall(thresholds, lambda t: t.between(0.0, 1.0)), "range": end > start, "action": action.isin(*actions)})


def batch_problems(sizes: Column) -> Column:
    return problems({"size": sizes.between(1, 100)})


def settings_problems(settings: DataFrame) -> DataFrame:
    """(version, problems) of settings (version, kind, name, value): thresholds must lie from 0 to 1, the ensemble's
    weights must sum to 1 within a hundredth."""
    value = F.col("value")
    row = settings.groupBy("version").agg(F.count_if((F.col("kind") == "threshold") & ~F.coalesce(value.between(0.0, 1.0), F.lit(False))).alias("bad"), F.sum(F.when(F.col("kind") == "weight", value)).alias("weights"))
    checks = {"thresholds": F.col("bad") == 0, "weights": F.col("weights").isNull() | (F.abs(F.col("weights") - 1) <= 0.01)}
    return row.select("version", problems(checks).alias("problems"))


def named(text: Column, phrases: Sequence[str] = RISKS) -> Column:
    """The phrases that a text contains, in their order."""
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(p)), F.lit(p)) for p in phrases]))


#: A number somewhere after a name. Where no digit follows, every name would be tried up to the text's end; a match that
#: takes the rest along and holds no number keeps this linear.
_AFTER, _AFTER_OR_REST = r"[^0-9]*(\d+\.?\d*)", r"[^0-9]*+(?:(\d+\.?\d*)|\z)"


def figures(text: Column, patterns: dict[str, str] = FIGURES) -> dict[str, Column]:
    """What each pattern's group captures, in order."""

    def found(p: str) -> Column:
        if not p.endswith(_AFTER):
            return F.regexp_extract_all(text, F.lit(p), F.lit(1))
        return F.filter(F.regexp_extract_all(text, F.lit(p.removesuffix(_AFTER) + _AFTER_OR_REST), F.lit(1)), lambda x: x != "")

    return {name: found(p) for name, p in patterns.items()}


def key_stocks(text: Column, stocks: dict[str, tuple[str, str]] = KEY_STOCKS, other: str = "未分类") -> Column:
    """(number, sector, stock) of the listed stocks that a text names; the sector, if the text names its mark too."""
    rows = [F.when(F.contains(text, F.lit(s)), F.struct(F.lit(f"1.{i}").alias("number"), F.when(F.contains(text, F.lit(mark)), F.lit(sector)).otherwise(other).alias("sector"), F.lit(s).alias("stock"))) for i, (s, (mark, sector)) in enumerate(stocks.items(), 1)]
    return F.array_compact(F.array(*rows))


def intake_quality(present: dict[str, Column], core_length: Column, whole_length: Column) -> Column:
    """0 to 100: points for each part that is present, for the length of the core, and for a rich record."""
    parts = [F.when(F.coalesce(ok, F.lit(False)), POINTS[k]).otherwise(0) for k, ok in present.items()]
    size = reduce(lambda c, t: c.when(core_length > t[0], t[1]), LENGTHS[1:], F.when(core_length > LENGTHS[0][0], LENGTHS[0][1])).otherwise(0)
    return F.least(reduce(lambda a, b: a + b, parts) + size + F.when(whole_length > 5000, 10).otherwise(0), F.lit(100))


def rounded(df: DataFrame, places: int = 3) -> DataFrame:
    """All doubles, those in structs, arrays and maps among them, rounded half to even."""

    def of(c: Column, kind) -> Column:
        name = kind.typeName()
        if name in ("double", "float"):
            return F.bround(c, places)
        if name == "struct":
            return F.when(c.isNotNull(), F.struct(*[of(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        if name == "array":
            return F.transform(c, lambda x: of(x, kind.elementType))
        if name == "map":
            return F.transform_values(c, lambda k, v: of(v, kind.valueType))
        return c

    return df.select(*[of(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def localised(ts: Column, zone: str, form: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """A UTC time as text in a zone."""
    return F.date_format(F.from_utc_timestamp(ts, zone), form)


def page(rows: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def attempted(rows: DataFrame, steps: dict[str, Callable[[Column], Column]], text: str = "content") -> DataFrame:
    """``rows`` with a column a named step, and ``error``: the names of steps whose result is null for a text that is not."""
    made = {name: step(F.col(text)) for name, step in steps.items()}
    failed = F.concat_ws(",", *[F.when(F.col(text).isNotNull() & c.isNull(), F.lit(n)) for n, c in made.items()])
    return rows.withColumns({**made, "error": failed})
