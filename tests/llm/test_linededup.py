"""Line dedup: parity with SQL, bitmaps, hot lines, odd rows."""

import hashlib

import duckdb
from pyspark.sql import functions as F

from tests.conftest import SMALL
from washline.llm import linededup

LINE = "A line of more than twenty characters"


def brute(rows):
    """{row number: kept text} by the written rules; a document is an (id, text) pair."""
    def key(line):
        bare = line.strip(linededup.BLANKS)
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in bare)

    holders = {}
    for i, t in set(rows):
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add((i, t))
    out = []
    for i, t in rows:
        kept = []
        for line in (t or "").split("\n"):
            held = holders.get(key(line), ())
            top = max((h[0] for h in held if h[0] is not None), default=None)
            if len(held) < 3 or i == top:
                kept.append(line)
        out.append("\n".join(kept))
    return out


def results(spark, docs, rows, **limits):
    table = docs([(i, t) for i, t in rows])
    got = linededup.without_repeats(table, **limits).collect()
    return sorted([(r.doc_id, r.text or "") for r in got], key=str)


def test_op11_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SMALL}/documents.parquet')")
    cols = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    got = sorted(tuple(r) for r in linededup.op11_query(spark, SMALL).select(cols).collect())
    expect = sorted(con.execute(linededup.ORACLE_SQL).df()[cols].itertuples(index=False, name=None))
    assert got == expect and any(r[2] for r in got)


def test_keys_bitmaps_and_hot_line(spark, docs):
    rows = [(i, f"{LINE}\nown line of the document {i:06d}\n \t{LINE.upper()}\r\nshort") for i in range(400)]
    rows += [(900, "\n".join([f"unique {k:020d}" for k in range(70)] + [LINE, "x", LINE]))]
    rows += [(1, "É" + "é" * 20 + "A"), (2, "É" + "é" * 20 + "a"), (3, "é" + "é" * 20 + "a")]  # only A-Z are folded
    assert results(spark, docs, rows, partitions=13) == sorted(
        zip([r[0] for r in rows], brute(rows), strict=True), key=str)
    maps = {r.doc_id: r for r in linededup.keep_bitmaps(docs(rows)).collect()}
    assert set(maps) == set(range(400))  # the largest id keeps both its lines
    assert [(k.word, k.bits & 15) for k in maps[5].keep] == [(0, 0b1010)] and maps[5].n_dropped == 2


def test_bitmaps_of_many_words_keep_one_bit_per_line(spark, docs):
    long = "\n".join(LINE if k % 100 == 7 else f"unique {k:020d}" for k in range(1000))
    rows = [(1, long), (2, LINE), (3, LINE), (4, LINE)]
    assert results(spark, docs, rows) == sorted(zip([1, 2, 3, 4], brute(rows), strict=True), key=str)
    keep = {r.doc_id: r.keep for r in linededup.keep_bitmaps(docs(rows)).collect()}[1]
    assert [k.word for k in keep] == sorted({k // 64 for k in range(1000) if k % 100 == 7})


def test_nulls_ties_repeats_and_line_ends(spark, docs):
    rows = [(None, LINE), (None, LINE + "\nx"), (None, None), (1, ""), (2, "\n\n"), (3, None),
            (5, LINE), (5, LINE), (5, LINE + "\ny"), (4, f"\x0b{LINE}\x0c"), (6, " " + LINE), (7, LINE + "\u0085")]
    assert results(spark, docs, rows) == sorted(
        [(i, k) for (i, _), k in zip(rows, brute(rows), strict=True)], key=str)
    two = [(1, LINE), (2, LINE), (2, LINE)]  # equal rows are one document: two documents only
    assert results(spark, docs, two) == [(1, LINE), (2, LINE), (2, LINE)]


def test_empty_table_and_clashing_columns(spark, docs):
    assert linededup.without_repeats(docs([])).count() == 0
    assert linededup.keep_bitmaps(docs([])).count() == 0
    table = docs([(i, LINE) for i in range(4)]).withColumns(
        {c: F.lit(1) for c in ("key", "pos", "_t", "_u", "_line", "keep", "n_dropped", "first", "cell", "_b_doc_id")})
    out = linededup.without_repeats(table)
    assert out.columns == table.columns
    assert {r.doc_id: r.text for r in out.collect()} == {0: "", 1: "", 2: "", 3: LINE}


def test_query_of_null_text(spark, tmp_path):
    spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    empty = hashlib.sha256(b"").hexdigest()
    assert {tuple(r) for r in linededup.op11_query(spark, str(tmp_path)).collect()} == {
        (1, 1, 0, empty), (None, 1, 0, empty)}
