"""Readers and writers of reports in the forms that users bring: JSON, CSV, Excel, text, report folders, state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions import converter
from auditloom.functions.unicode import decode_bytes


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Lists give a row an entry, objects one row."""
    return spark.read.option("multiLine", True).json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """A sheet is small: pandas reads it on the driver (needs a spreadsheet library of the user's)."""
    return spark.createDataFrame(pd.read_excel(path))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Reports parted by blank lines: (report_id, content); ids count blank ones too."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n\n")).alias("i", "content"))
    return whole.where(F.trim("content") != "").select(F.concat(F.lit("txt_report_"), F.col("i") + 1).alias("report_id"), F.trim("content").alias("content"))


def read_any_encoding(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): whole files in UTF-8, GBK or Latin-1."""
    return spark.read.format("binaryFile").load(path).select("path", decode_bytes(F.col("content")).alias("content"))


def read_reports(spark: SparkSession, path: str | list | pd.DataFrame, form: str = "auto") -> DataFrame:
    """The reader of a form; ``auto`` goes by the suffix. A list of records or a pandas frame is taken as it is."""
    if not isinstance(path, str):
        return spark.createDataFrame(path)
    readers = {"json": read_json, "csv": read_csv, "xlsx": read_excel, "xls": read_excel, "excel": read_excel, "txt": read_text, "parquet": lambda s, p: s.read.parquet(p)}
    kind = path.rsplit(".", 1)[-1].lower() if form == "auto" else form
    if kind not in readers:
        raise ValueError(f"no reader for {kind}")
    return readers[kind](spark, path)


def read_parsed_reports(spark: SparkSession, path: str, as_of: Column | None = None) -> DataFrame:
    """A folder of parsed reports: (file, data as variant, loaded at); files that aren't JSON are left out."""
    loaded = F.current_timestamp() if as_of is None else as_of
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.try_parse_json("value").alias("data"), loaded.alias("loaded"))
    return whole.where(F.col("data").isNotNull())


def list_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """(path, name, suffix, size, modified) without reading contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.regexp_extract(name, r"(\.[^.]+)$", 1)
    return files.select("path", name.alias("name"), suffix.alias("suffix"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def process_files(spark: SparkSession, path: str, work: Callable[[bytes], str], pattern: str = "*") -> DataFrame:
    """(path, ok, result) of a function over whole files; one that fails says why and does not stop the others."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, data in zip(frame["path"], frame["content"]):
                try:
                    rows.append((name, True, work(bytes(data))))
                except Exception as error:  # noqa: BLE001 (whatever the given function raises is its result)
                    rows.append((name, False, str(error)))
            yield pd.DataFrame(rows, columns=["path", "ok", "result"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.mapInPandas(each, "path string, ok boolean, result string")


def convert_folder(spark: SparkSession, path: str, default_date: Column, pattern: str = "*.txt") -> tuple[DataFrame, DataFrame]:
    """The structured reports of a folder of plain texts, and a report on the conversion: (status, n), a text without
    content having failed."""
    texts = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), decode_bytes(F.col("content")).alias("content"))
    good = F.trim("content") != ""
    return converter.convert(texts.where(good), default_date), texts.groupBy(F.when(good, "converted").otherwise("failed").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))


def write_results(results: DataFrame, path: str, form: str = "json") -> None:
    """All results as JSON lines, or a CSV of the plain columns; XML and Markdown as text."""
    plain = [f.name for f in results.schema if f.dataType.typeName() not in ("array", "map", "struct", "variant")]
    if form == "json":
        results.write.json(path)
    elif form == "csv":
        results.select(*plain).write.option("header", True).csv(path)
    elif form == "xml":
        results.select(F.to_xml(F.struct(*plain)).alias("value")).write.text(path)
    elif form == "markdown":
        results.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in plain]), F.lit(" |")).alias("value")).write.text(path)
    elif form == "text":
        results.select(F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in plain]).alias("value")).write.option("lineSep", "\n\n").text(path)
    else:
        raise ValueError(f"no writer for {form}")


def write_text_safely(lines: DataFrame, path: str, backup: str) -> None:
    """Lines (``value``) in place of what stands at ``path``, which goes to ``backup`` first if there is anything."""
    if exists(lines.sparkSession, path):
        lines.sparkSession.read.text(path).write.text(backup)
    lines.select("value").write.mode("overwrite").text(path)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def save_state(table: DataFrame, path: str) -> None:
    """A baseline or history as Parquet, in place of what was there."""
    table.write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A saved baseline or history; an empty one where none has been saved."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def reset_state(spark: SparkSession, path: str, schema: str) -> None:
    save_state(spark.createDataFrame([], schema), path)


def export_results(results: DataFrame, path: str, columns: list[str], form: str = "csv") -> None:
    """All results as JSON, or a CSV of the chosen columns of those that succeeded."""
    if form == "json":
        results.write.json(path)
    else:
        results.where("status = 'success'").select(*columns).write.option("header", True).csv(path)


def save_collected(rows: DataFrame, path: str, source: str, as_of: Column) -> None:
    """Rows as JSON lines in an envelope that names their source and the time of collection."""
    rows.select(F.struct(*rows.columns).alias("data"), F.struct(F.lit(source).alias("source"), F.date_format(as_of, "yyyy-MM-dd HH:mm:ss").alias("collected")).alias("metadata")).write.json(path)


def save_batch(results: DataFrame, path: str, name: str, large: int = 1000) -> None:
    """A batch's results under its name; those of a large batch in a folder of their own beside its summary."""
    n = results.count()
    summary = results.groupBy().agg(F.lit(name).alias("batch"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "success").alias("successful"))
    summary.write.mode("overwrite").json(f"{path}/{name}/summary")
    results.write.mode("overwrite").json(f"{path}/{name}/{'results' if n >= large else 'rows'}")


def flatten(df: DataFrame) -> DataFrame:
    """Structs come apart into columns, names joined by an underscore."""
    while any(f.dataType.typeName() == "struct" for f in df.schema):
        columns = []
        for f in df.schema:
            name = f"`{f.name}`"
            columns += [F.col(f"{name}.`{g.name}`").alias(f"{f.name}_{g.name}") for g in f.dataType] if f.dataType.typeName() == "struct" else [F.col(name)]
        df = df.select(*columns)
    return df
