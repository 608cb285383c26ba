"""WARC: exact round trip, pushed predicates, payloads left undecoded, plain files."""

import io

import duckdb
from pyspark.sql import functions as F

from tests.conftest import SMALL
from washline.llm import warc
from washline.llm.common import scratch_path


def test_op5_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SMALL}/pages.parquet')")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = sorted(tuple(r) for r in warc.op5_query(spark, SMALL).select(cols).collect())
    expect = sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({warc.ORACLE_SQL})").fetchall())
    assert got == expect


def test_round_trip_of_odd_pages(spark):
    long = "x" * 200
    pages = spark.createDataFrame(
        [(1, "http://a/ü%0a\r\nWARC-Type: x", long), (2, None, long), (2, None, long), (3, "u", None),
         (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (None, "n", long), (7, "u", "\r\n\r\nWARC/1.1\0é" * 40),
         (8, "big", "é" * 400_000)], "page_id long, url string, html string")
    path = scratch_path(spark, "t")
    warc.write_warc(warc.page_records(pages.withColumn("payload", F.lit(1))), path)
    back = warc.read_warc(spark, path)
    rows = {(r.record_id, r.record_type): r for r in back.collect()}
    assert back.count() == 10
    assert rows["urn:page:1", "response"].target_uri == "http://a/ü%0a\r\nWARC-Type: x"
    assert rows["urn:page:2", "revisit"].refers_to == "urn:page:1"
    assert rows["urn:page:2", "revisit"].payload is None
    assert rows["urn:page:2", "revisit"].payload_bytes == 200
    assert rows["urn:page:5", "response"].payload == rows["urn:page:6", "response"].payload == b"short"
    assert rows["urn:page:", "response"].payload == long.encode()
    assert rows["urn:page:3", "response"].payload == b""
    assert rows["urn:page:7", "response"].payload == ("\r\n\r\nWARC/1.1\0é" * 40).encode()
    assert len(rows["urn:page:8", "response"].payload) == 800_000
    # predicates on headers reach the reader
    some = warc.read_warc(spark, path).where((F.col("record_type") == "response") & (F.col("payload_bytes") > 300))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan  # nothing is left for Spark to test
    assert some.count() == 2
    assert "payload" not in warc.read_warc(spark, path, payload=False).columns
    assert warc.read_warc(spark, path, payload=False).where("record_type = 'revisit'").count() == 2


def _record(i, kind="response", body=b"body"):
    return {"record_id": f"urn:page:{i}", "record_type": kind, "payload": body, "payload_bytes": len(body)}


def test_unwanted_payloads_are_not_decoded():
    data = b"".join(warc.encode_record(_record(i, body=bytes([65 + i % 26]) * 300_000)) for i in range(5))
    seen = {}
    got = list(warc.read_records(io.BytesIO(data), True, lambda r: r["record_id"].endswith("3"), True, seen))
    assert [r["payload"] for r in got] == [b"D" * 300_000]
    assert seen == {"seen": 5, "decoded": 1}


def test_foreign_members_and_plain_files():
    import gzip
    import zlib

    plain = b"".join(zlib.decompress(warc.encode_record(_record(i, body=b"x" * (70_000 * i))), 31) for i in range(4))
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    got = list(warc.read_records(io.BytesIO(info + plain), False, lambda r: True, True))
    assert [r["record_type"] for r in got] == ["warcinfo"] + ["response"] * 4
    assert [len(r["payload"]) for r in got] == [3, 0, 70_000, 140_000, 210_000]
    members = gzip.compress(info) + b"".join(
        gzip.compress(zlib.decompress(warc.encode_record(_record(i, body=b"y" * 70_000 * i)), 31)) for i in range(4))
    got = list(warc.read_records(io.BytesIO(members), True, lambda r: r["record_type"] == "response", True))
    assert [len(r["payload"]) for r in got] == [0, 70_000, 140_000, 210_000]


def test_empty_pages(spark):
    path = scratch_path(spark, "t")
    warc.write_warc(warc.page_records(spark.createDataFrame([], "page_id long, url string, html string")), path)
    assert warc.read_warc(spark, path).count() == 0
