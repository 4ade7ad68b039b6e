"""Legacy archives to WARC: ARC records are parsed by their version's header line and declared length, and
equivalent WARC records are synthesised (identifier, timestamp, type, digests).

ARC version 1 heads a record with five fields, version 2 with ten; both end in the length of what follows.
``convert`` turns ARC files into records, ``write_warc`` sets revisits in place of repeated payloads and writes
gzipped WARC files with Spark's text writer, and ``read_warc`` streams such files back through Spark's text
reader and puts records together by their declared lengths, so that a task holds one record at a time, not a
file.  Payloads are bytes all the way, in any encoding or none.

Defined cases: null payloads are empty, empty ones are equal to each other; of equal payloads the one of
least key is the response (ties of a key are all responses); repeated rows are records of their own, with
identifiers of their own; null and empty addresses become ``urn:none``; addresses of any scheme, in any letters, keep
their answer's head and so are responses, and a record without such a head is a resource; a row with a null key is always a response,
which none revisits; what an archive has lost (a record cut short,
a length that is no number, a header of another number of fields) comes out as a row that says so in
``error`` and how many bytes were passed over in ``lost_bytes``; very long payloads need the memory of one
record; an empty table writes nothing and reads back nothing.  ``from_pages`` reads three columns by name;
others may have any name.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterable, Iterator
from itertools import groupby, islice
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm.stash import new_path
from auditloom.llm.text_blocks import blocks

#: Fixed field names of the two ARC versions.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
_EOL = "\r\n"


class ArcRecord(NamedTuple):
    fields: dict[str, str]
    body: bytes


class ArcLoss(NamedTuple):
    """What could not be read of an archive, and how many bytes of it."""

    error: str
    lost_bytes: int


def arc_version_block(version: int, name: str, date: str) -> bytes:
    said = f"{version} 0 auditloom\n{' '.join(ARC_FIELDS[version])}\n\n"
    tail = f"text/plain {len(said)}" if version == 1 else f"text/plain 200 - - 0 {name} {len(said)}"
    return f"filedesc://{name} 0.0.0.0 {date} {tail}\n{said}\n".encode()


def arc_record(version: int, url: str, date: str, body: bytes, name: str = "-", offset: int = 0) -> bytes:
    """An ARC record of an HTTP answer; spaces of the address are escaped."""
    url = (url or "urn:none").replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D")
    if version == 1:
        head = f"{url} 0.0.0.0 {date} text/html {len(body)}\n"
    else:
        head = f"{url} 0.0.0.0 {date} text/html 200 {hashlib.md5(body).hexdigest()} - {offset} {name} {len(body)}\n"
    return head.encode() + body + b"\n"


def parse_arc(stream: BinaryIO) -> Iterator[ArcRecord | ArcLoss]:
    """The records after the version block; the version is told by that block's own text. After a header of
    another number of fields reading goes on behind its length; after a bad length nothing can be told apart."""
    names: tuple[str, ...] = ()
    while line := stream.readline():
        line = line.strip()
        if not line:
            continue
        tail = line.decode("utf-8", "replace").split(" ")
        if not (tail[-1].isascii() and tail[-1].isdigit()):
            yield ArcLoss("a header without a length", len(line) + sum(map(len, iter(lambda: stream.read(1 << 20), b""))))
            return
        size = int(tail[-1])
        body = stream.read(size)
        if len(body) < size:
            yield ArcLoss("a record cut short", len(line) + len(body))
            return
        if not names:
            version = body.split(b" ", 1)[0]
            names = ARC_FIELDS.get(int(version) if version.isdigit() else 1, ARC_FIELDS[1])
            continue
        # Addresses may hold spaces: they are what is left over at the front.
        fields = tail if len(tail) <= len(names) else [" ".join(tail[: 1 - len(names)]), *tail[1 - len(names) :]]
        if len(fields) != len(names):
            yield ArcLoss("a header of another number of fields", len(line) + size)
        else:
            yield ArcRecord(dict(zip(names, fields)), body)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_date(arc_date: str) -> str:
    """Fourteen digits, or fewer of an older archive, as a WARC timestamp."""
    d = arc_date + "00000101000000"[len(arc_date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_type(head: bytes) -> str:
    """What is kept with the head of an HTTP answer is a response, whatever its address; else it is a resource, whose
    block is the payload alone."""
    return "response" if head else "resource"


_RECORD = "ordinal long, target_uri string, warc_date string, type string, http binary, payload binary, payload_sha1 string, payload_digest string, error string, lost_bytes long"
_NAMES = [f.split()[0] for f in _RECORD.split(", ")]
_TYPES = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.split()[1]] for f in _RECORD.split(", ")]


def _converted(stream: BinaryIO) -> Iterator[tuple]:
    for i, record in enumerate(parse_arc(stream)):
        if isinstance(record, ArcLoss):
            yield i, *[None] * 7, record.error, record.lost_bytes
            continue
        url = record.fields["URL"]
        head, gap, payload = record.body.partition(b"\r\n\r\n") if record.body.startswith(b"HTTP/") else (b"", b"", record.body)
        sha1 = hashlib.sha1(payload)
        yield i, url, warc_date(record.fields["Archive-date"]), warc_type(head), head + gap, payload, sha1.hexdigest(), base64.b32encode(sha1.digest()).decode(), None, 0


def _arrays(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)]


def _bounded(rows: Iterable[tuple], limit: int = 1 << 24) -> Iterator[list[tuple]]:
    """Rows in lists whose payloads stay near ``limit`` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[5] or b"")
        if size >= limit or len(held) >= 4096:
            yield held
            held, size = [], 0
    if held:
        yield held


def convert(arcs: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """The records of whole ARC files (as ``binaryFile`` reads them, so of at most 2 GB each; gzipped or not),
    with the file's path; what was lost of a file is a row with an ``error``."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = data.as_buffer() if data.is_valid else pa.py_buffer(b"")
                zipped = raw.size > 1 and raw.slice(0, 2).to_pybytes() == b"\x1f\x8b"
                for rows in _bounded(_converted(gzip.GzipFile(fileobj=pa.BufferReader(raw)) if zipped else io.BufferedReader(pa.BufferReader(raw)))):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *_arrays(rows)], names=["path", *_NAMES])

    return arcs.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInArrow(mapped, f"path string, {_RECORD}")


def from_pages(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """``key`` and the converted record of every page, each block of pages having gone through an ARC archive;
    archives alternate between the versions."""
    source = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), capture_date(F.col(key)).alias("date"), F.col(payload).cast("binary").alias("payload"))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version = 1
        for batch in batches:
            urls, dates = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for block in blocks(batch.column(3)):
                parts, offset = [arc_version_block(version, "pages.arc", "20200101000000")], 0
                for i in range(block.lo, block.hi):
                    text = block.text(i - block.lo)
                    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(text)}\r\n\r\n".encode() + text
                    offset += len(parts[-1])
                    parts.append(arc_record(version, urls[i], dates[i], body, "pages.arc", offset))
                rows = list(_converted(io.BytesIO(b"".join(parts))))
                if len(rows) != block.hi - block.lo or any(r[8] for r in rows):
                    raise ValueError("an archive must hold all its pages")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, len(rows)), *_arrays(rows)], names=["key", *_NAMES])
                version = 3 - version

    return source.mapInArrow(mapped, f"key long, {_RECORD}").withColumnRenamed("key", key)


def capture_date(key: Column) -> Column:
    """The tables name no capture time: it is made of the key, from the start of 2020 on."""
    return F.date_format(F.timestamp_seconds(F.lit(1577836800) + F.coalesce(F.pmod(key, F.lit(100_000_000)), F.lit(0))), "yyyyMMddHHmmss")


def _warc_id(*parts: Column) -> Column:
    """An identifier: the MD5 of what tells a record apart, in the form of a UUID."""
    return F.regexp_replace(F.md5(F.concat_ws(" ", *parts)), "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "<urn:uuid:$1-$2-3$3-8$4-$5>")


def deduplicated(records: DataFrame, firsts: DataFrame) -> DataFrame:
    """``records`` with ``first_key``, that of the response with the same payload, where that is another."""
    return records.join(firsts.select(F.col("payload_sha1"), "first_key", "first_uri", "first_date"), "payload_sha1", "left")


def warc_text(records: DataFrame, key: str) -> DataFrame:
    """A WARC record a row (its bytes as a string column), but for the two line ends after it. Identifiers are made
    of content and of the row's place in the job, so that equal rows differ."""
    revisit = F.coalesce(F.col("first_key") != F.col(key), F.lit(False))
    block = F.when(revisit, F.col("http")).otherwise(F.concat("http", "payload"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_EOL))
    head = F.concat(
        F.lit(f"WARC/1.1{_EOL}"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.col("type"))),
        line("WARC-Record-ID", _warc_id(F.col("target_uri"), F.col("warc_date"), F.col("payload_digest"), F.monotonically_increasing_id())),
        line("WARC-Date", F.col("warc_date")),
        line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        line("X-Payload-Length", F.octet_length("payload").cast("string")),
        F.coalesce(line("X-Key", F.col(key).cast("string")), F.lit("")),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To-Target-URI", F.col("first_uri")), line("WARC-Refers-To-Date", F.col("first_date")), line("X-Refers-To-Key", F.col("first_key").cast("string")),
        )).otherwise(F.lit("")),
        line("Content-Type", F.when(F.col("type") == "response", F.lit("application/http;msgtype=response")).otherwise(F.lit("text/html"))),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(_EOL),
    )
    return records.where("error is null").select(F.concat(head.cast("binary"), block).cast("string").alias("value"))


def write_warc(records: DataFrame, path: str, key: str = "page_id", records_per_file: int = 100_000) -> None:
    """Gzipped WARC files under ``path``."""
    writer = warc_text(records, key).write.option("lineSep", _EOL + _EOL).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
    writer.option("maxRecordsPerFile", records_per_file).text(path)


def parse_warc(parts: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and blocks of the records of a file, which comes in the stretches between
    its empty lines; no more is held than the record being read. A block cut short by the end of the file, or not
    followed by an empty line, comes with a field ``error``."""
    gap = (_EOL + _EOL).encode()
    held, fields, size = bytearray(), None, 0
    for part in parts:
        held += part
        held += gap
        while True:
            if fields is None:
                while held.startswith(b"\r\n"):
                    del held[:2]
                end = held.find(gap)
                if end < 0:
                    break
                lines = held[:end].decode("utf-8", "replace").split(_EOL)
                del held[: end + 4]
                if not lines[0].startswith("WARC/"):
                    continue
                fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
                said = fields.get("content-length", "")
                size = int(said) if said.isascii() and said.isdigit() else 0
                if said != "0" and not size:
                    fields["error"] = "a length that is no number"
            if len(held) < size + 4:
                break
            if held[size : size + 4] != gap:
                fields.setdefault("error", "a block of another length than declared")
            yield fields, bytes(held[:size])
            del held[:size]
            fields = None
    if fields is not None:
        yield fields | {"error": "a record cut short"}, bytes(held[:-4])


def sound(records: DataFrame) -> DataFrame:
    """``read_warc`` rows; one with an error stops the job."""
    said = F.raise_error(F.concat(F.lit("a damaged record: "), "error"))
    return records.withColumn("payload_digest", F.when(F.col("error").isNotNull(), said).otherwise(F.col("payload_digest"))).drop("error")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row a record of the gzipped files under ``path``: record_type, target_uri, key, refers_to (keys as our
    writer sets them), record_id, payload_bytes and payload_digest, both taken from the payload where the record
    holds it; a record that is damaged, or whose payload does not match its digest, says so in ``error``."""
    stretches = spark.read.option("lineSep", _EOL + _EOL).option("pathGlobFilter", "*.gz").text(path)
    source = stretches.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))

    def rows_of(parts: Iterable[bytes]) -> Iterator[tuple]:
        for fields, block in parse_warc(parts):
            kind, digest, error = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha1:"), fields.get("error")
            size = int(fields.get("x-payload-length", 0))
            if kind != "revisit":
                payload = block.partition(b"\r\n\r\n")[2] if "application/http" in fields.get("content-type", "") else block
                size, found = len(payload), base32_sha1(payload)
                if digest and found != digest:
                    error = error or "a payload that does not match its digest"
                digest = found
            yield size, kind, fields.get("warc-target-uri"), fields.get("x-key"), fields.get("x-refers-to-key"), fields.get("warc-record-id"), digest, error

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Gzipped files are not split, so a task sees each of its files whole and in order.
        stream = ((f, v.as_py()) for batch in batches for f, v in zip(batch.column(0).to_pylist(), batch.column(1)))
        for _, file in groupby(stream, lambda x: x[0]):
            rows = rows_of(v for _, v in file)
            while part := list(islice(rows, 4096)):
                columns = list(zip(*part))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *[pa.array(c, pa.string()) for c in columns[1:]]], names=_READ)

    return source.mapInArrow(mapped, ", ".join(f"{c} {'long' if c == 'payload_bytes' else 'string'}" for c in _READ))


_READ = ["payload_bytes", "record_type", "target_uri", "key", "refers_to", "record_id", "payload_digest", "error"]


def first_payloads(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """The least key of every payload that occurs twice or more, with its address and time."""
    least = F.min(F.struct(F.col(key).alias("first_key"), F.coalesce(F.regexp_replace(F.when(F.col(url) != "", F.col(url)), " ", "%20"), F.lit("urn:none")).alias("first_uri"), F.date_format(F.to_timestamp(capture_date(F.col(key)), "yyyyMMddHHmmss"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("first_date"))).alias("f")
    grouped = pages.where(F.col(key).isNotNull()).groupBy(F.sha1(F.coalesce(F.col(payload).cast("binary"), F.lit(b""))).alias("payload_sha1")).agg(least, F.count(F.lit(1)).alias("n"))
    return grouped.where("n > 1").select("payload_sha1", "f.*")


def op4_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = new_path(spark, "warc")
    write_warc(deduplicated(from_pages(pages), first_payloads(pages)), path)
    return sound(read_warc(spark, path)).select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))
