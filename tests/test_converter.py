"""Plain-text reports to structured ones."""

from pyspark.sql import functions as F

from auditloom.functions import converter
from auditloom.operators import similarity

TEXT = "行业研究报告\n发布日期：2025年1月3日\n投资建议：维持买入评级。\n600066.SH 宇通客车\n驱动因素：1.销量增长；2.出口提升\n\n风险提示：需求下滑；成本上升"


def test_parts(spark):
    df = spark.createDataFrame([(TEXT,)], "t string")
    t = F.col("t")
    row = df.select(converter.title(t).alias("title"), converter.publish_date(t, F.lit("x")).alias("date"), converter.rating(t).alias("rating"), converter.drivers(t).alias("drivers"), converter.risks(t).alias("risks"), converter.companies(t).alias("companies")).first()
    assert (row["title"], row["date"], row["rating"]) == ("行业研究报告", "2025-01-03", "买入")
    assert row["drivers"][:2] == ["销量增长", "出口提升"] and row["risks"] == ["需求下滑", "成本上升"]
    assert [(c["code"], c["name"]) for c in row["companies"]] == [("600066.SH", "宇通客车")]


def test_convert_and_edges(spark):
    df = spark.createDataFrame([("a_20250102.txt", TEXT), ("b.txt", None)], "file string, content string")
    got = {r["report_id"]: r for r in converter.convert(df, F.lit("2024-01-01")).collect()}
    assert got["report_a_20250102"]["metadata"]["publish_date"] == "2025-01-02" and got["report_a_20250102"]["style"]["has_risk_tips"]
    assert got["report_b"]["metadata"]["publish_date"] == "2024-01-01" and got["report_b"]["style"]["total_length"] == 0


def test_numbers_and_similarity(spark):
    row = spark.createDataFrame([("营收 3.5亿元 市盈率 20 增长 5%",)], "t string").select(converter.financial_numbers(F.col("t")).alias("n")).first()["n"]
    assert [(x["kind"], x["value"]) for x in row] == [("money_yi", 3.5), ("percentage", 5.0), ("pe_ratio", 20.0)]
    pair = spark.range(1).select(similarity.mixed_similarity({"a": F.lit(10.0), "s": F.lit("ab")}, {"a": F.lit(5.0), "s": F.lit("abcd")}, {"a": "number", "s": "string"}).alias("r")).first()
    assert pair["r"] == 0.5
