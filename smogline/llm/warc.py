"""WARC archives as a Python data source.

``spark.read.format("warc")`` plans partitions over the archives' byte ranges (from the record offsets that the
writer leaves beside each archive; archives without them are one partition each), takes filters on record type
and headers (``warc_type``, ``target_uri``, ``record_id``, ``refers_to``, ``payload_digest``, ``content_length``)
down to the reader, parses a record's headers first, and seeks past the block of a record that no filter lets
through or whose payload nobody asked for (option ``payload`` = false).

``df.write.format("warc")`` writes records from (record_id, target_uri, warc_type, refers_to, payload_digest,
payload_bytes, payload): responses with an HTTP head and the payload, revisits with the head only. Files carry
names unique to the task attempt and count only once they are in the manifest that ``commit`` writes, so lost or
repeated tasks leave no records behind.

Paths go through pyarrow's file systems (local, HDFS, S3).

Defined results: a null payload is empty; archives without records read as no rows; a record that is cut off ends
its archive with an error; digests are bare upper-case base32 SHA-1 of the full payload.
"""

from __future__ import annotations

import base64
import hashlib
import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan,
                                    GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
                                    StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage)

from .common import checked_broadcast, scratch_path, table

SCHEMA = ("warc_type string, record_id string, target_uri string, refers_to string, payload_digest string, "
          "payload_bytes long, content_length long, payload binary")
VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"       # a fixed date keeps archives reproducible
RANGE_BYTES = 32 << 20
STEP_BYTES = 1 << 20                # one offset is kept about every so many bytes
EMPTY_DIGEST = base64.b32encode(hashlib.sha1(b"").digest()).decode()
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# the planning process of a data source has no files of the package, so its classes travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/")
                                              and not path.startswith("file://") else path)
    return pyarrow.fs.LocalFileSystem(), path


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def one_line(value: object) -> str:
    """A header value without line ends (percent-encoded)."""
    return str(value).replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if value is not None else ""


def value_of(text: str | None) -> str | None:
    return None if text is None else text.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(record_id, uri, kind, refers_to, payload_digest, payload_bytes, payload: bytes) -> bytes:
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n").encode()
    block = head if kind == "revisit" else head + payload
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:record:{one_line(record_id)}>", f"WARC-Date: {DATE}",
             f"WARC-Payload-Digest: sha1:{payload_digest}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(block)}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {one_line(uri)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:record:{one_line(refers_to)}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    offsets: list[int]
    size: int


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict, schema) -> None:
        self.path = options["path"]
        self.at = {f.name: i for i, f in enumerate(schema.fields)}

    def write(self, rows: Iterator) -> Written:
        fs, path = filesystem(self.path)
        name, out, size, offsets, last = None, None, 0, [], -STEP_BYTES
        for row in rows:
            if out is None:
                name = f"part-{uuid.uuid4().hex}.warc"
                fs.create_dir(path, recursive=True)
                out = fs.open_output_stream(f"{path}/{name}")
            get = lambda c: row[self.at[c]] if c in self.at else None
            payload = bytes(get("payload") or b"")
            n = get("payload_bytes")
            raw = record(get("record_id"), get("target_uri"), get("warc_type") or "response", get("refers_to"),
                         get("payload_digest") or digest(payload), len(payload) if n is None else n, payload)
            if size - last >= STEP_BYTES:
                offsets.append(size)
                last = size
            out.write(raw)
            size += len(raw)
        if out is not None:
            out.close()
        return Written(name, offsets, size)

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = filesystem(self.path)
        fs.create_dir(path, recursive=True)
        files = [{"file": m.file, "offsets": m.offsets, "size": m.size} for m in messages if m and m.file]
        with fs.open_output_stream(f"{path}/_manifest.json") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Files without a manifest are never read."""


@dataclass
class Range(InputPartition):
    file: str
    begin: int
    end: int


TESTS = {
    EqualTo: lambda v, x: v == x, In: lambda v, x: v in x, GreaterThan: lambda v, x: v > x,
    GreaterThanOrEqual: lambda v, x: v >= x, LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x,
    StringStartsWith: lambda v, x: v.startswith(x), StringEndsWith: lambda v, x: v.endswith(x),
    StringContains: lambda v, x: x in v,
}
HEADERS = ("warc_type", "record_id", "target_uri", "refers_to", "payload_digest", "content_length")


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in HEADERS and isinstance(f, IsNotNull):
                self.tests.append((name, IsNotNull, None))
            elif name in HEADERS and type(f) in TESTS and f.value is not None:
                self.tests.append((name, type(f), f.value))
            else:
                yield f     # Spark applies what is not taken

    def partitions(self) -> list[Range]:
        fs, path = filesystem(self.path)
        found = fs.get_file_info(f"{path}/_manifest.json")
        if found.type == pyarrow.fs.FileType.File:
            with fs.open_input_stream(found.path) as f:
                files = json.loads(f.read())
        elif fs.get_file_info(path).type == pyarrow.fs.FileType.File:
            return [Range(path, 0, fs.get_file_info(path).size)]
        else:
            infos = fs.get_file_info(pyarrow.fs.FileSelector(path))
            files = [{"file": i.base_name, "offsets": [0], "size": i.size} for i in infos
                     if i.base_name.endswith(".warc")]
        out = []
        for f in sorted(files, key=lambda x: x["file"]):
            begin = 0
            for offset in [*f["offsets"][1:], f["size"]]:
                if offset - begin >= self.range_bytes or offset == f["size"]:
                    out.append(Range(f"{path}/{f['file']}", begin, offset))
                    begin = offset
        return out or [Range("", 0, 0)]

    def wanted(self, head: dict[str, object]) -> bool:
        for name, kind, value in self.tests:
            v = head[name]
            if v is None or (kind is not IsNotNull and not TESTS[kind](v, value)):
                return False
        return True

    def read(self, part: Range) -> Iterator[tuple]:
        if not part.file:
            return
        fs, _ = filesystem(self.path)
        with fs.open_input_file(part.file) as raw:
            yield from read_records(raw, part.begin, part.end, self.wanted, self.payload)


class Buffered:
    """Reads of a byte range in large pieces; skips within and beyond the piece at hand."""

    def __init__(self, raw, begin: int, end: int, size: int = 1 << 20) -> None:
        self.raw, self.at, self.end, self.size = raw, begin, end, size
        self.base, self.held = begin, b""

    def _hold(self, n: int) -> None:
        k = self.at - self.base
        if len(self.held) - k < n:
            self.raw.seek(self.at)
            self.base, self.held = self.at, self.raw.read(max(n, min(self.size, self.end - self.at + 8)))

    def take(self, n: int) -> bytes:
        self._hold(n)
        k = self.at - self.base
        out = self.held[k:k + n]
        if len(out) < n:
            raise EOFError("a WARC record is cut off")
        self.at += n
        return out

    def until(self, mark: bytes) -> bytes:
        n = 4096
        while True:
            self._hold(min(n, max(self.end - self.at, 0)))
            k = self.at - self.base
            hit = self.held.find(mark, k)
            if hit >= 0:
                self.at = self.base + hit + len(mark)
                return self.held[k:hit]
            if n >= self.end - self.at:
                raise EOFError("a WARC record is cut off")
            n *= 4

    def skip(self, n: int) -> None:
        self.at += n


def read_records(raw, begin: int, end: int, wanted, payload: bool) -> Iterator[tuple]:
    src = Buffered(raw, begin, end)
    while src.at < end:
        head = src.until(b"\r\n\r\n").decode("utf-8", "surrogatepass").lstrip("\r\n").split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {src.at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head[1:])}
        size = int(fields["content-length"])
        start = src.at
        names = lambda v: value_of(v.removeprefix("<").removesuffix(">").removeprefix("urn:record:")) if v else None
        row = {"warc_type": fields.get("warc-type"), "record_id": names(fields.get("warc-record-id")),
               "target_uri": value_of(fields.get("warc-target-uri")), "refers_to": names(fields.get("warc-refers-to")),
               "payload_digest": fields.get("warc-payload-digest", "").rpartition(":")[2] or None, "content_length": size}
        if wanted(row):
            body, n = None, None
            if "http" in fields.get("content-type", "") and size:
                http = src.until(b"\r\n\r\n").decode("latin-1").lower().split("\r\n")
                n = next((int(x.partition(":")[2]) for x in http if x.startswith("content-length:")), None)
            if payload and row["warc_type"] != "revisit":
                body = src.take(start + size - src.at)
                if row["payload_digest"] and digest(body) != row["payload_digest"]:
                    raise ValueError(f"record {row['record_id']} does not match its digest")
                n = len(body)
            yield (*(row[h] for h in ("warc_type", "record_id", "target_uri", "refers_to", "payload_digest")), n, size, body)
        src.skip(start + size + 4 - src.at)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def as_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Records of (page_id, url, html): of equal payloads of at least ``min_bytes`` the one with the least page_id
    is a response, the others revisit it."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    # only payloads that occur again are joined; their keys are pre-aggregated, and while they are few (counted)
    # no payload is shuffled
    again = (rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha")
             .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first"))
    out = rows.join(checked_broadcast(again), "sha", "left").withColumn(
        "revisit", F.col("first").isNotNull() & F.col("page_id").isNotNull() & (F.col("page_id") != F.col("first")))
    return out.select(F.col("page_id").cast("string").alias("record_id"), F.col("url").alias("target_uri"),
                      F.when(F.col("revisit"), "revisit").otherwise("response").alias("warc_type"),
                      F.when(F.col("revisit"), F.col("first").cast("string")).alias("refers_to"),
                      base32(F.col("sha")).alias("payload_digest"),
                      F.octet_length("payload").cast("long").alias("payload_bytes"),
                      F.when(~F.col("revisit"), F.col("payload")).alias("payload"))


def base32(sha: F.Column) -> F.Column:
    """Base32 of 40 hex digits: every five hex digits are four letters."""
    out = []
    for i in range(8):
        five = F.conv(F.substring(sha, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            out.append(F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
                                   F.shiftright(five, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from the archives."""
    register(spark)
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    path = scratch_path(spark, "warc")
    as_records(pages).write.format("warc").mode("append").save(path)
    kind = dict(pages.dtypes)["page_id"]
    back = spark.read.format("warc").load(path)
    return back.select(F.nullif(F.col("record_id"), F.lit("")).cast(kind).alias("page_id"), "payload_bytes", "payload_digest",
                       F.col("warc_type").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"))


#: DuckDB's form of the query (base32 from five hex digits at a time).
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT sha, min(page_id) AS first FROM p GROUP BY sha)
SELECT page_id, CAST(octet_length(CAST(encode(html) AS BLOB)) AS BIGINT) AS payload_bytes,
  (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST((CAST('0x' || substr(p.sha, 5 * CAST(floor(k / 4) AS INT) + 1, 5) AS BIGINT) >> (15 - 5 * CAST(k % 4 AS INT))) & 31 AS INT) + 1, 1),
      '' ORDER BY k) FROM range(32) t(k)) AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (sha)
"""


__all__ = ["EMPTY_DIGEST", "WarcSource", "as_records", "base32", "query", "read_records", "register"]
