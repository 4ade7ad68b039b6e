"""Cleaning steps and their statistics; sinks of a stream and the numbers of its run."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from auditloom.functions import text as X
from auditloom.operators import cleaning, summaries
from auditloom.streaming import callbacks, monitoring

TEXTS = [
    None, "", "plain words stay.", "<b>报告</b>内容ＡＢＣ，很好。句子。句子。", "x" * 60, "本报告仅供参考。收入增长。", "扫码关注。收入增长。收入增长。", "联系 010-12345678 谢谢", "数据😀增长", "重复重复重复重复 好 好 好 好", "a, b,  c\t d\n e", "&amp;lt;x&amp;gt; <i>y</i>", "𝐱" * 100,
]


def plain(text):
    if not text:
        return "", [], 0.0
    steps = []

    def step(name, after):
        nonlocal t
        if len(after) < len(t):
            steps.append(name)
        t = after

    t = text
    stripped = re.sub("<[^>]+>", "", t)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        stripped = stripped.replace(entity, char)
    step("html_removed", re.sub("&[a-zA-Z0-9#]+;", "", re.sub("<[^>]+>", "", stripped)))
    step("encoding_fixed", "".join(c for c in t if ord(c) < 65536))
    steps += cleaning.ALWAYS
    t = unicodedata.normalize("NFKC", t)
    t = re.sub("[​-‏ -  -⁯﻿]", "", re.sub("[\x00-\x1f\x7f-\x9f]", "", t))
    t = re.sub(" +", " ", t).strip(" ").replace(",", " ")
    for name, pattern in (("disclaimers_removed", "(?i)免责声明|风险提示|投资建议|市场有风险|投资需谨慎|本报告|仅供参考"), ("advertisements_removed", "(?i)广告|推广|扫码|微信|QQ|电话|邮箱|网址|链接")):
        step(name, "。".join(s for s in t.split("。") if not re.search(pattern, s)))
    step("contact_info_removed", re.sub(r"(\d{3,4}[-\s]?\d{7,8})|(\w+@\w+\.\w+)|(www\.\w+\.\w+)", "", t, flags=re.ASCII))
    once = re.sub(r"(\S+)(\s+\1){2,}", r"\1", re.sub(r"(.)\1{3,}", r"\1\1\1", t))
    step("duplicates_removed", "。".join(dict.fromkeys(s.strip() for s in once.split("。") if s.strip())))
    quality = 1.0
    quality -= 0.3 if len(t) < 50 else 0.1 if len(t) > 50000 else 0
    quality -= 0.3 if sum("一" <= c <= "鿿" for c in t) < 0.7 * max(len(t), 1) else 0
    words = t.split()
    quality -= 0.2 if len(words) > 10 and max(map(words.count, words)) > 0.3 * len(words) else 0
    t = t.strip()
    t += "" if not t or t[-1] in "。！？…" else "。"
    kept = len(t) / len(text)
    if t:
        quality += 0.1 if 0.7 <= kept <= 0.95 else -0.2 if kept < 0.5 else 0
    return t, steps, max(0.0, min(1.0, quality))


def test_steps_and_statistics_in_one_reading(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "id long, content string").write.parquet(str(tmp_path / "in"))
    rows, seen = cleaning.observed(cleaning.stepwise(spark.read.parquet(str(tmp_path / "in")), "id"))
    assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    rows.write.parquet(str(tmp_path / "out"))
    got = {r["id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    for i, text in enumerate(TEXTS):
        cleaned, steps, quality = plain(text)
        assert (got[i]["cleaned"], got[i]["steps"]) == (cleaned, list(steps)), text
        if cleaned:
            assert got[i]["quality"] == pytest.approx(quality), text
    told = cleaning.statistics(seen)
    want = [plain(t) for t in TEXTS if t]
    assert (told["total_processed"], told["total_cleaned"]) == (len(want), len(want))
    for name, step in (("html_removal_rate", "html_removed"), ("encoding_fix_rate", "encoding_fixed"), ("duplicate_removal_rate", "duplicates_removed")):
        assert told[name] == pytest.approx(sum(step in w[1] for w in want) / len(want))


def test_an_empty_table_has_statistics(spark):
    rows, seen = cleaning.observed(cleaning.stepwise(spark.createDataFrame([], "id long, content string"), "id"), "none")
    assert rows.collect() == []
    assert cleaning.statistics(seen)["total_processed"] == 0


def test_texts_read_in_the_wrong_encoding(spark):
    rows = [("中文 é".encode().decode("latin-1"), "中文 é"), ("café", "café"), ("Ã¼ber", "über"), ("中文Ã¼", "中文Ã¼"), ("Â", "Â"), ("é\x80", "é\x80"), (None, None)]
    df = spark.createDataFrame(rows, "t string, want string").withColumn("got", X.redecoded(F.col("t")))
    assert all(r["got"] == r["want"] for r in df.collect())


def stream_of(spark, tmp_path, n=60, files=3):
    rows = [("m", f"2024-01-01 00:{i:02d}:00", float(i), i) for i in range(n)]
    for k in range(files):
        df = spark.createDataFrame(rows[k * n // files : (k + 1) * n // files], "metric string, ts string, value double, id long")
        df.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema("metric string, ts timestamp, value double, id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_every_sink_is_told_once(spark, tmp_path):
    out, ledger, sent = str(tmp_path / "all"), f"file://{tmp_path}/ledger", str(tmp_path / "sent")
    failures = []

    def flaky(batch, number):
        if number == 1 and not failures:
            failures.append(number)
            raise RuntimeError("not now")
        batch.select("id").write.mode("append").parquet(sent)  # doubles whatever it is given twice

    def send(number, rows):
        with open(f"{tmp_path}/calls", "a") as f:
            f.write(f"{number} {len(rows)}\n")

    each = callbacks.fan_out({"all": callbacks.files_sink(out), "flaky": flaky, "call": callbacks.call_sink(send, 8), "high": callbacks.files_sink(str(tmp_path / "high"), F.col("value") >= 50)}, ledger)

    def twice(batch, number):
        each(batch, number)
        each(batch, number)

    query = stream_of(spark, tmp_path).writeStream.foreachBatch(twice).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(60))
    assert sorted(r["id"] for r in spark.read.parquet(sent).collect()) == list(range(60))
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "high")).collect()) == list(range(50, 60))
    assert sum(int(x.split()[1]) for x in (tmp_path / "calls").read_text().splitlines()) == 60
    told = {(r["sink"], r["batch"], r["state"]): r["error"] for r in callbacks.deliveries(spark, ledger).collect()}
    assert {k for k in told if k[2] == "done"} == {(s, b, "done") for s in ("all", "flaky", "call", "high") for b in range(3)}
    assert [k for k in told if k[2] == "failed"] == [("flaky", 1, "failed")] and "not now" in told[("flaky", 1, "failed")]


def test_the_numbers_of_a_run(spark, tmp_path):
    told = callbacks.observed(stream_of(spark, tmp_path), "seen", F.count(F.lit(1)).alias("n"), F.max("value").alias("most"))
    log = callbacks.listened(spark, lambda: monitoring.run_once(told, "run"))
    rows = log.rows(spark)
    per = {(r["metric"], r["id"]): r["value"] for r in rows.collect()}
    assert [per[("input_rows", b)] for b in range(3)] == [20.0, 20.0, 20.0]
    assert [per[("seen_n", b)] for b in range(3)] == [20.0, 20.0, 20.0] and per[("seen_most", 2)] == 59.0
    report = {r["metric"]: r for r in summaries.resource_report(rows.drop("query")).collect()}
    assert report["seen_most"]["current"] == 59.0 and report["input_rows"]["mean"] == 20.0
