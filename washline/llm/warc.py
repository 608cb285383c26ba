"""WARC archives as a Spark data source written in Python, with revisit records.

``spark.read.format("warc")`` plans file partitions (files packed up to ``partition_mb``), takes
filters on the record headers from Spark, parses a record's headers first and inflates its payload
only if the headers pass and the payload is wanted (option ``payload``, default true).
``df.write.format("warc")`` writes one gzip member per record, with the WARC annex-D skip lengths
in the member's extra field, so that a reader can step over a record without inflating it.

Files are opened with ``pyarrow.fs``, which reaches the shared file systems a cluster has
(HDFS, S3, GCS, a mounted folder). A task writes below ``_temporary``; the driver moves files into
place when all tasks have ended well, so files of lost executors are never read.
"""

from __future__ import annotations

import datetime
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from washline.llm.common import scratch_path

#: Columns that come from the headers; filters on them are pushed down.
HEADER_FIELDS = [
    StructField("record_id", StringType()),
    StructField("record_type", StringType()),
    StructField("target_uri", StringType()),
    StructField("date", StringType()),
    StructField("payload_digest", StringType()),
    StructField("payload_bytes", LongType()),
    StructField("refers_to", StringType()),
]
SCHEMA = StructType([*HEADER_FIELDS, StructField("payload", BinaryType())])
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_TESTS = {
    EqualTo: lambda v, x: v is not None and v == x,
    EqualNullSafe: lambda v, x: v == x,
    GreaterThan: lambda v, x: v is not None and v > x,
    GreaterThanOrEqual: lambda v, x: v is not None and v >= x,
    LessThan: lambda v, x: v is not None and v < x,
    LessThanOrEqual: lambda v, x: v is not None and v <= x,
    In: lambda v, x: v is not None and v in x,
    StringStartsWith: lambda v, x: v is not None and v.startswith(x),
    StringEndsWith: lambda v, x: v is not None and v.endswith(x),
    StringContains: lambda v, x: v is not None and x in v,
    IsNull: lambda v, _: v is None,
    IsNotNull: lambda v, _: v is not None,
}


def _clean(value: str) -> str:
    """Header values stay on one line: control characters and '%' are percent-encoded."""
    return "".join(c if c >= " " and c not in "%\x7f\x85  " else
                   "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def _unclean(value: str) -> str:
    if "%" not in value:
        return value
    from urllib.parse import unquote

    return unquote(value)


def encode_record(rec: dict) -> bytes:
    """One WARC record of the columns of ``SCHEMA`` as a gzip member with skip lengths."""
    payload = rec.get("payload") or b""
    revisit = rec["record_type"] == "revisit"
    total = rec.get("payload_bytes")
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
            + str(len(payload) if total is None else total).encode() + b"\r\n\r\n")
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {rec['record_type']}", f"WARC-Record-ID: <{_clean(rec['record_id'])}>"]
    if rec.get("target_uri") is not None:
        head.append(f"WARC-Target-URI: {_clean(rec['target_uri'])}")
    if rec.get("date") is not None:
        head.append(f"WARC-Date: {_clean(rec['date'])}")
    if rec.get("payload_digest") is not None:
        head.append(f"WARC-Payload-Digest: sha256:{rec['payload_digest']}")
    if revisit:
        head.append(f"WARC-Profile: {REVISIT_PROFILE}")
    if rec.get("refers_to") is not None:
        head.append(f"WARC-Refers-To: <{_clean(rec['refers_to'])}>")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(raw) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    skip = (size, len(raw)) if max(size, len(raw)) < 1 << 32 else (0, 0)
    return (b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, *skip)
            + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF))


def parse_headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def header_row(warc: dict[str, str], http: dict[str, str]) -> dict:
    strip = lambda v: None if v is None else _unclean(v.removeprefix("<").removesuffix(">"))
    digest = warc.get("warc-payload-digest")
    length = http.get("content-length")
    uri = warc.get("warc-target-uri")
    return {
        "record_id": strip(warc.get("warc-record-id")),
        "record_type": warc.get("warc-type"),
        "target_uri": None if uri is None else _unclean(uri),
        "date": warc.get("warc-date"),
        "payload_digest": None if digest is None else digest.partition(":")[2] or digest,
        "payload_bytes": int(length) if length and length.isdigit() else None,
        "refers_to": strip(warc.get("warc-refers-to")),
    }


class _Source:
    """Bytes of a record from the current position: raw, or of one gzip member."""

    STEP = 1 << 16

    def __init__(self, file, gz: bool, rest: bytes):
        self.file, self.gz, self.buffer, self.rest = file, gz, b"", rest
        self.inflate = zlib.decompressobj(31) if gz else None

    def more(self) -> bool:
        """Add to the buffer; False at the end of the member or file."""
        if self.gz and self.inflate.eof:
            return False
        data = self.rest or self.file.read(self.STEP)
        self.rest = b""
        if not data:
            return False
        if self.gz:
            self.buffer += self.inflate.decompress(data)
            self.rest = self.inflate.unused_data
        else:
            self.buffer += data
        return True

    def upto(self, mark: bytes) -> bytes | None:
        at = self.buffer.find(mark)
        while at < 0:
            if not self.more():
                return None
            at = self.buffer.find(mark)
        out, self.buffer = self.buffer[:at], self.buffer[at + len(mark):]
        return out

    def take(self, n: int) -> bytes:
        parts, have = [self.buffer], len(self.buffer)
        self.buffer = b""
        while have < n and self.more():
            parts.append(self.buffer)
            have += len(self.buffer)
            self.buffer = b""
        data = b"".join(parts)
        if len(data) < n:
            raise ValueError(f"record cut short: {len(data)} of {n} bytes")
        self.buffer = data[n:]
        return data[:n]


def read_records(file, gz: bool, wanted, payload: bool, counter: dict | None = None) -> Iterator[dict]:
    """Records of an open file whose header row passes ``wanted``; payloads inflated only for those.

    ``counter`` (for tests) counts records seen, skipped unread and payloads decoded.
    """
    counter = counter if counter is not None else {}
    position, rest = 0, b""
    while True:
        skip = 0
        if gz:
            head = file.read(_Source.STEP) if not rest else rest
            if len(head) < 24:
                head += file.read(_Source.STEP)
            if not head:
                return
            if head[:2] != b"\x1f\x8b":
                raise ValueError(f"no gzip member at byte {position}")
            if head[3] & 4 and head[12:16] == b"sl\x08\0":
                skip = struct.unpack_from("<I", head, 16)[0]
            src = _Source(file, True, head)
        else:
            src = _Source(file, False, rest)
        warc = src.upto(b"\r\n\r\n")
        if warc is None:
            if src.buffer.strip():
                raise ValueError(f"no record at byte {position}")
            return
        counter["seen"] = counter.get("seen", 0) + 1
        warc_head = parse_headers(warc.lstrip(b"\r\n"))
        left = int(warc_head.get("content-length", 0))
        http_head: dict[str, str] = {}
        if left and warc_head.get("content-type", "").startswith("application/http"):
            while b"\r\n\r\n" not in src.buffer[:left] and len(src.buffer) < left and src.more():
                pass
            end = src.buffer[:left].find(b"\r\n\r\n")
            if end >= 0:
                http_head = parse_headers(src.buffer[:end])
                src.buffer = src.buffer[end + 4:]
                left -= end + 4
        row = header_row(warc_head, http_head)
        if row["payload_bytes"] is None:
            row["payload_bytes"] = left
        keep = wanted(row)
        if keep and payload:
            counter["decoded"] = counter.get("decoded", 0) + 1
            row["payload"] = None if row["record_type"] == "revisit" else src.take(left)
            left = 0 if row["record_type"] != "revisit" else left
        if keep:
            yield row
        if gz and skip:
            position += skip
            file.seek(position)
            rest = b""
        elif gz:
            while src.more():
                src.buffer = b""
            position = -1  # unknown from here on; only skip lengths need it
            rest = src.rest
            if not rest:
                rest = file.read(_Source.STEP)
                if not rest:
                    return
            position = file.tell() - len(rest)
        else:
            behind = left + 4
            if len(src.buffer) >= behind:
                rest = src.buffer[behind:]
            else:
                file.seek(behind - len(src.buffer), 1)
                rest = b""
            counter["skipped"] = counter.get("skipped", 0) + (not keep)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


@dataclass
class FilePartition(InputPartition):
    files: list[tuple[str, int]]

    def __init__(self, files):
        super().__init__(files)
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.partition_bytes = int(float(options.get("partition_mb", "32")) * 1e6)
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        names = {f.name for f in HEADER_FIELDS}
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in names:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = _open(self.path)
        found = sorted((x.path, x.size) for x in fs.get_file_info(pafs.FileSelector(root, recursive=True))
                       if x.is_file and "/_" not in x.path[len(root):]
                       and x.path.endswith((".warc", ".warc.gz")))
        parts, room = [], 0
        for path, size in found:
            if not parts or size > room:
                parts.append([])
                room = self.partition_bytes
            parts[-1].append((path, size))
            room -= size
        return [FilePartition(p) for p in parts] or [FilePartition([])]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(self.path)
        tests = [(f.attribute[0], _TESTS[type(f)], getattr(f, "value", None)) for f in self.filters]
        wanted = lambda row: all(t(row[c], x) for c, t, x in tests)
        names = self.schema.fieldNames()
        types = {f.name: {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[
            f.dataType.simpleString()] for f in self.schema.fields}
        payload = self.payload and "payload" in names
        rows, held = [], 0

        def batch():
            return pa.RecordBatch.from_pydict({c: pa.array([r.get(c) for r in rows], types[c])
                                               for c in names})

        for path, _size in partition.files:
            with fs.open_input_file(path) as file:
                for row in read_records(file, path.endswith(".gz"), wanted, payload):
                    rows.append(row)
                    held += len(row.get("payload") or b"") + 400
                    if held >= 8 << 20:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.file_bytes = int(float(options.get("file_mb", "32")) * 1e6)
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _open(self.path)
        folder = f"{root}/_temporary/{self.job}"
        fs.create_dir(folder, recursive=True)
        files, out, size = [], None, 0
        try:
            for batch in iterator:
                columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
                for i in range(batch.num_rows):
                    if out is None or size >= self.file_bytes:
                        if out is not None:
                            out.close()
                        files.append(f"{uuid.uuid4().hex}.warc.gz")
                        out, size = fs.open_output_stream(f"{folder}/{files[-1]}", compression=None), 0
                    data = encode_record({n: c[i].as_py() for n, c in columns.items()})
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        for m in messages:
            for name in m.files if m else ():
                fs.move(f"{root}/_temporary/{self.job}/{name}", f"{root}/{name}")
        self._clean(fs, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*_open(self.path))

    def _clean(self, fs, root) -> None:
        if fs.get_file_info(f"{root}/_temporary/{self.job}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/_temporary/{self.job}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> StructType:
        if self.options.get("payload", "true").lower() == "false":
            return StructType(HEADER_FIELDS)
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only added to: use mode('append') and a new folder")
        return WarcWriter(self.options)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records below ``path``; filters on header columns reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return (spark.read.format("warc").option("payload", str(payload).lower()).load(path))


def write_warc(records: DataFrame, path: str) -> None:
    """Write rows with the columns of ``SCHEMA`` (others are ignored) as archives below ``path``."""
    records.sparkSession.dataSource.register(WarcDataSource)
    records.select(*[f.name for f in SCHEMA.fields]).write.format("warc").mode("append").save(path)


def page_records(pages: DataFrame, min_revisit_bytes: int = 100,
                 date: str | None = None) -> DataFrame:
    """A record per row of ``pages`` (page_id, url, html): responses, and revisits of equal payloads.

    Of rows whose payloads are equal and have at least ``min_revisit_bytes``, those with the
    smallest page_id are responses and the others revisit it. Null html is an empty payload; rows
    with a null page_id are always responses; rows that repeat the smallest id are responses too.
    First page ids per digest are a partial aggregate, so a payload shared by a third of all pages
    is one small row per task; only ids and digests are joined on, never payloads.
    """
    date = date or datetime.datetime.fromtimestamp(0, datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").alias("target_uri"), payload.alias("payload")).select(
        "*", F.sha2("payload", 256).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"))
    keys = rows.where(F.col("payload_bytes") >= min_revisit_bytes).select("page_id", "payload_digest")
    firsts = keys.groupBy("payload_digest").agg(
        F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")
    ).where(F.col("_n") > 1).drop("_n")
    again = (keys.join(firsts, "payload_digest").where(F.col("page_id") > F.col("_first"))
             .select("page_id", "payload_digest", "_first").distinct())
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    return rows.join(again, ["page_id", "payload_digest"], "left").select(
        urn(F.col("page_id")).alias("record_id"),
        F.when(F.col("_first").isNull(), "response").otherwise("revisit").alias("record_type"),
        "target_uri", F.lit(date).alias("date"), "payload_digest", "payload_bytes",
        F.when(F.col("_first").isNotNull(), urn(F.col("_first"))).alias("refers_to"),
        F.when(F.col("_first").isNull(), F.col("payload")).alias("payload"))


def op5_query(spark, sf_dir: str) -> DataFrame:
    """Write every page as a record, read the archives back, report what they hold.

    Bytes and digests of responses are those of the payloads read back; revisits have no payload,
    so theirs are the headers'.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = scratch_path(spark, "warc")
    write_warc(page_records(pages), path)
    page = lambda c: F.regexp_replace(c, "^urn:page:", "").try_cast("long")
    response = F.col("record_type") == "response"
    return read_warc(spark, path).select(
        page(F.col("record_id")).alias("page_id"),
        F.when(response, F.octet_length("payload")).otherwise(F.col("payload_bytes"))
        .cast("long").alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.col("payload_digest"))
        .alias("payload_digest"),
        "record_type", page(F.col("refers_to")).alias("refers_to"))


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100
  GROUP BY payload_digest
)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 100
"""
