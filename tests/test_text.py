"""Chinese texts and edge cases, which the tables do not hold."""

import pytest
from pyspark.sql import functions as F

from auditloom.config import LEXICONS
from auditloom.functions import scalars as S
from auditloom.functions import text as X
from auditloom.functions.unicode import decode_bytes, nfkc, unescape
from auditloom.operators import fusion, quality, semantic


def one(spark, column, **values):
    kinds = {bool: "boolean", int: "long", float: "double", str: "string", list: "array<string>"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("r")).first()["r"]


def test_tokens(spark):
    assert one(spark, X.tokens(F.col("t")), t="利好 消息 a 12 ok") == ["利好", "消息", "ok"]
    assert one(spark, X.tokens(F.col("t")), t="") == []
    assert one(spark, X.sentiment(X.tokens(F.col("t"))), t="利好 上涨 风险 其他") == 0.25


def test_numbers(spark):
    assert one(spark, X.numbers(F.col("t")), t="增长 20% 目标价 35.5元") == [20.0, 35.5, 20.0, 35.5]


@pytest.mark.parametrize("t,want", [("aaaaaa bb", "aaa bb"), ("好好好好好。好。好", "好好好。好"), ("", "")])
def test_repeats(spark, t, want):
    assert one(spark, X.without_repeats(F.col("t")), t=t) == want


def test_clean(spark):
    assert one(spark, X.clean(F.col("t")), t="<p>内容。</p>本报告仅供参考。联系 010-12345678。内容") == "内容。联系。"
    assert one(spark, X.strip_tags(F.col("t")), t="<b>a &lt; b</b>&zzz;") == "a < b"
    assert one(spark, X.closed(F.col("t")), t=" 完 ") == "完。"
    assert one(spark, X.drop_controls(F.col("t")), t="a\n​b") == "ab"


def test_top_share(spark):
    assert one(spark, X.top_share(F.split("t", " ")), t="a b a c") == 0.5
    assert one(spark, X.top_share(F.array().cast("array<string>"))) == 0.0


def test_unicode(spark):
    assert one(spark, nfkc(F.col("t")), t="，！Ａ") == ",!A"
    assert one(spark, unescape(F.col("t")), t="&eacute;&amp;") == "é&"
    assert spark.createDataFrame([(bytearray("中文".encode("gbk")),)], "b binary").select(decode_bytes(F.col("b"))).first()[0] == "中文"


@pytest.mark.parametrize("code,want", [("000001", "000001.SZ"), (" 600000", "600000.SH"), ("830001", "830001.BJ"), ("600000.SH", "600000.SH"), ("abc", "abc")])
def test_stock_code(spark, code, want):
    assert one(spark, S.stock_code(F.col("t")), t=code) == want


@pytest.mark.parametrize("text,want", [("12%", 12.0), ("3.5亿", 3.5e8), ("2万", 2e4), ("x", None)])
def test_number(spark, text, want):
    assert one(spark, S.parse_number(F.col("t")), t=text) == want


def test_rules(spark):
    text = "利好消息很多但是然而不过。风险压力也大相反。据可靠消息表示 1 2 3 4。"
    # Four words and two sentences, both polarities, four numbers.
    assert one(spark, semantic.contradiction_score(F.col("t")), t=text) == pytest.approx(0.4 + 0.2 + 0.1)
    assert one(spark, semantic.source_score(F.col("t")), t="据内部消息。据可靠消息") == pytest.approx(0.2)
    assert one(spark, semantic.consistency_score(F.col("t")), t="利好\n风险\n利好") == pytest.approx(0.4)
    assert one(spark, semantic.answer_score(F.col("t")), t="存在严重矛盾") == 0.9


def test_sequence_ratio(spark):
    got = spark.createDataFrame([("abcd", "bcde"), (None, "")], "a string, b string").select(semantic.sequence_ratio("a", "b").alias("r")).collect()
    assert [r["r"] for r in got] == [0.75, 1.0]


def test_one_live_family(spark):
    row = fusion.fuse(spark.createDataFrame([(1, 0.135, None, None, None), (2, None, None, None, None)], "report_id long, statistical double, behavioral double, market double, semantic double")).orderBy("report_id").collect()
    assert (row[0]["score"], row[0]["level"], row[0]["confidence"], row[0]["low"]) == (0.135, "NORMAL", 0.75, 0.135)
    assert row[1]["score"] == 0.0 and row[1]["alerts"] == ""


def test_consensus(spark):
    row = fusion.fuse(spark.createDataFrame([(1, 0.9, 0.9, 0.9, 0.7)], "report_id long, statistical double, behavioral double, market double, semantic double")).first()
    assert row["alerts"] == "IMMEDIATE,CONSENSUS" and row["level"] == "CRITICAL" and row["key_families"].count(",") == 3


def test_quality(spark):
    rows = [(1, "t", "好" * 300, "a", ["600000", "bad"], "买入", "2025-01-01", "2024-12-01"), (2, None, None, None, None, "x", None, None)]
    found = quality.check(spark.createDataFrame(rows, "report_id long, title string, content string, author string, stocks array<string>, rating string, publish_date string, analysis_date string"), F.lit("2025-02-01").cast("timestamp")).orderBy("report_id").collect()
    assert found[0]["completeness"] == 1.0 and found[0]["consistency"] == pytest.approx(0.9) and found[0]["business"] == 1.0 and not found[0]["passed"]
    assert found[1]["completeness"] == 0.0 and found[1]["business"] == pytest.approx(0.7)


def test_lexicons_are_distinct():
    for name in ("positive", "negative", "contradiction", "uncertainty", "formal", "casual"):
        words = getattr(LEXICONS, name)
        assert len(words) == len(set(words))
