"""Readers and writers on small files; streams against the batch operators."""

import json

from pyspark.sql import functions as F

from auditloom.operators import features, forest, learning
from auditloom.sources import files
from auditloom.streaming import monitoring


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"content": "x"}, {"content": "y"}]))
    (tmp_path / "b.csv").write_text("content,author\n\"a, b\",c\n")
    (tmp_path / "c.txt").write_text("one\n\n \n\ntwo")
    (tmp_path / "g.bin").write_bytes("中文".encode("gbk"))
    assert files.read_reports(spark, str(tmp_path / "a.json")).count() == 2
    assert files.read_reports(spark, str(tmp_path / "b.csv")).first()["content"] == "a, b"
    assert [tuple(r) for r in files.read_reports(spark, str(tmp_path / "c.txt")).collect()] == [("txt_report_1", "one"), ("txt_report_3", "two")]
    assert files.read_any_encoding(spark, str(tmp_path / "g.bin")).first()["content"] == "中文"
    assert files.list_files(spark, str(tmp_path), "*.csv").count() == 1
    assert len(files.file_hashes(spark, str(tmp_path / "b.csv")).first()["md5"]) == 32


def test_parsed_reports(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"meta_info": {"quality_score": 8.6, "confidence": 0.92, "text_length": 3247, "table_count": 3}, "financial_metrics": {"PE": ["35.62"]}, "investment_advice": {"rating": "买入"}, "core_content": {"investment_summary": "x" * 102}, "deep_analysis": {"logic_strength": 0.85}}))
    (tmp_path / "2.json").write_text("not json")
    parsed = files.read_parsed_reports(spark, str(tmp_path))
    row = features.training_vectors(parsed).first()
    assert parsed.count() == 1
    assert [round(row[c], 4) for c in ("quality", "confidence", "length", "tables", "pe", "rating", "summary", "logic")] == [8.6, 0.92, 0.3247, 3.0, 0.3562, 1.0, 0.102, 0.85]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1])], "id long, t string, arr array<int>")
    for form in ("json", "csv", "xml", "markdown", "text"):
        files.write_results(df, str(tmp_path / form), form)
        assert spark.read.text(str(tmp_path / form)).count() >= 1
    flat = files.flatten(spark.range(1).select(F.struct(F.struct(F.lit(1).alias("c")).alias("b")).alias("a")))
    assert flat.columns == ["a_b_c"]


def test_upsert_and_weights(spark):
    old, new = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, at int, v string"), spark.createDataFrame([(1, 2, "c")], "k int, at int, v string")
    assert sorted(tuple(r) for r in learning.upsert(old, new, "k", "at").collect()) == [(1, 2, "c"), (2, 1, "b")]
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "feature string, weight double")
    wrong = spark.createDataFrame([("a", 0.9)], "feature string, importance double")
    got = {r["feature"]: r["adapted"] for r in learning.adjust_feature_weights(weights, wrong).collect()}
    assert round(got["a"] / got["b"], 6) == 0.9 and round(got["a"] + got["b"], 6) == 4.0


def test_isolation_forest_finds_the_far_one(spark):
    rows = [(i, float(i % 7), float(i % 5)) for i in range(200)] + [(999, 100.0, -100.0)]
    got = forest.outliers(spark.createDataFrame(rows, "id long, a double, b double"), "id", ["a", "b"], trees=30, sample=64, contamination=0.02)
    assert got.orderBy(F.desc("score")).first()["id"] == 999
