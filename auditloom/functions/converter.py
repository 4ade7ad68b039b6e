"""Plain-text reports to structured ones: dates, ratings, sections, companies and style, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.text import ratio

#: Key words and patterns of the sections.
RATINGS = {"买入": ("买入", "强烈推荐", "强推"), "增持": ("增持", "推荐", "跑赢大盘"), "中性": ("中性", "持有", "观望", "中立"), "减持": ("减持", "卖出", "回避", "弱于大市")}
DRIVERS = ("关键假设", "驱动因素", "核心驱动", "主要驱动", "业绩驱动", "增长驱动", "催化剂", "投资逻辑", "投资建议", "投资要点")
RISKS = ("风险提示", "风险因素", "风险警示", "风险点", "主要风险")
DATE_MARKERS = ("发布日期", "报告日期", "研究日期", "日期", "Date")
DATE = r"(\d{4})[-/年](\d{1,2})[-/月](\d{1,2})"
SECTIONS = {"has_investment_advice": "投资建议[：:]", "has_key_assumptions": "关键假设[：:]", "has_risk_tips": "风险提示[：:]", "has_price_catalyst": "股价催化剂[：:]", "has_different_views": "有别于大众的认识[：:]", "has_tables": r"表\s*\d+[：:]", "has_charts": r"图\s*\d+[：:]"}
TITLE_WORDS = "报告|研究|分析|策略|行业|公司"


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def file_date(name: Column) -> Column:
    """A date of eight digits in a file's name, with hyphens."""
    d = F.regexp_extract(name, r"(\d{8})", 1)
    return F.when(d != "", F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2)))


def publish_date(text: Column, default: Column) -> Column:
    """The first marked date of the beginning, else the first date there, else ``default``."""
    head = F.substring(text, 1, 2000)

    def read(pattern: str) -> Column:
        year, month, day = (F.regexp_extract(head, pattern, i) for i in (1, 2, 3))
        return F.when(year != "", F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")))

    return F.coalesce(*[read(f"{m}[：:]\\s*{DATE}") for m in DATE_MARKERS], read(DATE), default)


def rating(text: Column) -> Column:
    """The first rating, in the order of the table, of which a key word occurs."""
    hits = [(name, reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])) for name, words in RATINGS.items()]
    return reduce(lambda c, h: c.when(h[1], h[0]), hits[1:], F.when(hits[0][1], hits[0][0])).otherwise("未明确")


def _items(sections: Column) -> Column:
    split = F.flatten(F.transform(sections, lambda s: F.split(F.trim(s), r"\d+[\.、]|；|;")))
    return F.array_distinct(F.filter(F.transform(split, F.trim), lambda x: x != ""))


def drivers(text: Column) -> Column:
    """What the driver sections list; else the first three sentences of the advice."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(f"(?s){k}[：:](.*?)(?:\\n\\n|风险提示|股价催化剂|有别于大众的认识)"), F.lit(1)) for k in DRIVERS])
    advice = F.regexp_extract(text, r"(?s)投资建议[：:](.*?)(?:\n\n|关键假设|风险提示)", 1)
    first = F.array_distinct(F.filter(F.transform(F.slice(F.split(advice, "[。；;]"), 1, 3), F.trim), lambda x: x != ""))
    listed = _items(found)
    return F.when(F.size(listed) > 0, listed).otherwise(first)


def risks(text: Column) -> Column:
    return _items(F.concat(*[F.regexp_extract_all(text, F.lit(f"(?s){k}[：:](.*?)(?:\\n\\n|$)"), F.lit(1)) for k in RISKS]))


def companies(text: Column) -> Column:
    """(code, name) of each stock code with a name after it."""
    pattern = r"(\d{6})[\.。]([A-Z]{2})\s*([^\s\d\(（]+)"
    code, market, name = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2, 3))
    return F.transform(F.arrays_zip(code.alias("c"), market.alias("m"), name.alias("n")), lambda x: F.struct(F.concat_ws(".", x["c"], x["m"]).alias("code"), x["n"].alias("name")))


def title(text: Column, default: str = "research report") -> Column:
    """The first line if of fair length; else the shortest of the first ten lines, those with a title word before others."""
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 10), F.trim)
    first = F.get(lines, F.lit(0))
    heading = r"^(目录|内容|第.*章|[0-9]+\.|表格|图表)"
    fair = F.filter(lines, lambda x: (x != "") & (F.length(x) <= 50) & ~x.rlike(heading))
    names = F.filter(F.transform(fair, lambda x: F.trim(F.get(F.split(x, "[:：]"), F.lit(0)))), lambda x: x != "")
    ranked = F.array_sort(F.transform(names, lambda x, i: F.struct((~x.rlike(TITLE_WORDS)).alias("a"), F.length(x).alias("b"), i.alias("i"), x.alias("x"))))
    good = (F.length(first) > 5) & (F.length(first) < 50) & ~first.rlike(r"^(目录|内容|第.*章|[0-9]+\.)")
    return F.when(good, first).otherwise(F.coalesce(F.get(ranked, F.lit(0))["x"], F.lit(default)))


def style(text: Column) -> dict[str, Column]:
    """Length, paragraphs, densities and which sections stand."""
    n = F.length(text)
    paragraphs = F.filter(F.split(text, r"\n{2,}"), lambda p: F.trim(p) != "")
    total = F.aggregate(paragraphs, F.lit(0), lambda a, p: a + F.length(p))
    return {
        "total_length": n, "paragraph_count": F.size(paragraphs), "avg_paragraph_length": ratio(total, F.size(paragraphs)), "digit_density": ratio(F.regexp_count(text, F.lit("[0-9]")), n), "punctuation_density": ratio(F.regexp_count(text, F.lit("[，。；：（）、？！]")), n),
        **{k: text.rlike(p) for k, p in SECTIONS.items()}, "has_toc": F.substring(text, 1, 1000).rlike("内容目录|目录"),
    }


def convert(texts: DataFrame, default_date: Column, text: str = "content", name: str = "file") -> DataFrame:
    """A structured report a text: metadata, content, and the style structs. White space is collapsed first, as the
    original order has it, so that titles and paragraphs see one line."""
    t = F.col("full_text")
    flat = texts.select(F.col(name).alias("file"), collapse(F.coalesce(F.col(text), F.lit(""))).alias("full_text"))
    metadata = F.struct(title(t).alias("title"), F.coalesce(file_date(F.col("file")), publish_date(t, default_date)).alias("publish_date"), F.col("file").alias("source_file"))
    content = F.struct(rating(t).alias("investment_rating"), drivers(t).alias("driving_factors"), risks(t).alias("risk_factors"), companies(t).alias("target_companies"))
    return flat.select(F.concat(F.lit("report_"), F.regexp_replace("file", r"\.[^.]*$", "")).alias("report_id"), metadata.alias("metadata"), F.struct("full_text").alias("content"), F.struct(*[v.alias(k) for k, v in style(t).items()]).alias("style"), content.alias("content_features"))


#: Typed number patterns.
TYPED = {"money_wan": r"(\d+\.?\d*)\s*万元", "money_yi": r"(\d+\.?\d*)\s*亿元", "money_yuan": r"(\d+\.?\d*)\s*元", "percentage": r"(\d+\.?\d*)%", "pe_ratio": r"市盈率\s*(\d+\.?\d*)", "pb_ratio": r"市净率\s*(\d+\.?\d*)", "multiple": r"(\d+\.?\d*)\s*倍", "target_price": r"目标价\s*(\d+\.?\d*)", "year": r"(\d{4})年", "shares_wan": r"(\d+\.?\d*)\s*万股"}


def financial_numbers(text: Column) -> Column:
    """(kind, value, text) of all typed numbers, kind by kind."""

    def of(kind: str, pattern: str) -> Column:
        pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("v"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("t"))
        return F.transform(pairs, lambda p: F.struct(F.lit(kind).alias("kind"), p["v"].try_cast("double").alias("value"), p["t"].alias("text")))

    return F.concat(*[of(k, p) for k, p in TYPED.items()])
