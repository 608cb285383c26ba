"""Periodic runs: brute force on random, nested and planted texts; the query against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tests.conftest import SMALL
from washline.llm import periodic


def brute(w):
    """Every run by definition: each lag's stretches, kept where no smaller period holds."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(6, 4 * q) and all(
                    any(w[i + k] != w[i + k + r] for k in range(n - r)) for r in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def words_of(kind, rng):
    if kind == 0:
        return [rng.randrange(2) for _ in range(rng.randrange(200))]
    if kind == 1:  # blocks of few or many words, repeated with a broken last copy
        w = [rng.randrange(50) for _ in range(rng.randrange(60))]
        for _ in range(3):
            q = rng.randrange(1, 70)
            block = [rng.randrange(rng.choice([1, 2, 3, 100])) for _ in range(q)]
            w += (block * 8)[:int(q * rng.uniform(3.5, 7))] + [rng.randrange(50) for _ in range(rng.randrange(5))]
        return w
    if kind == 2:  # a block that holds runs itself
        block = [0] * rng.randrange(5, 60) + [1] * rng.randrange(30) + [2]
        return [9] * rng.randrange(20) + block * rng.randrange(3, 6) + block[:rng.randrange(len(block))]
    if kind == 3:  # words of Fibonacci
        a, b = [0], [0, 1]
        for _ in range(rng.randrange(5, 9)):
            a, b = b, b + a
        return b * rng.randrange(1, 5)
    q = rng.randrange(15, 130)  # exactly four periods, some almost constant
    block = [rng.randrange(2) for _ in range(q)] if rng.random() < 0.5 else [0] * (q - 1) + [1]
    w = block * 4 + block[:rng.randrange(q)]
    if rng.random() < 0.3:
        w[rng.randrange(len(w))] = 7
    return w


def test_runs_equal_brute_force():
    rng = random.Random(5)
    long = 0
    for trial in range(400):
        w = words_of(trial % 5, rng)
        expect = brute(w)
        assert periodic.runs(np.array(w, np.int64)) == expect, w
        long += sum(q >= periodic.DIRECT for _, _, q in expect)
    assert long > 150


def test_long_periods_and_very_long_texts():
    rng = np.random.default_rng(3)
    block = rng.integers(0, 50, 3001)
    w = np.concatenate([rng.integers(0, 1000, 5000), np.tile(block, 5)[:14_000], rng.integers(0, 1000, 4000)])
    assert (5000, 14_000, 3001) in [(s + 0, n, q) for s, n, q in periodic.runs(w)] or any(
        s <= 5000 and s + n >= 19_000 and q == 3001 for s, n, q in periodic.runs(w))
    assert periodic.runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]  # one word, no pair blow-up
    assert periodic.runs(rng.integers(0, 10**9, 300_000)) == []


def test_groups_do_not_join_documents():
    texts = [[b"a", b"b"] * 3, [b"a", b"b"] * 3, [], [b"a"] * 6, [b"a"] * 5]
    assert periodic._search(texts) == [[], [], [], [(0, 6, 1)], []]
    assert periodic._search([[b"a", b"b"] * 4]) == [[(0, 8, 2)]]


def test_odd_rows_and_clashing_columns(spark, docs):
    rows = [(None, "x x x x x x y"), (1, None), (2, ""), (3, " \t\r\n"), (4, "a b a b a b a b\x0bend"),
            (4, "a b a b a b a b\x0bend"), (5, "a b " * 8)]
    table = docs(rows).withColumns({c: F.lit("clash") for c in ("runs", "collapsed", "_text", "c0")})
    out = periodic.collapse_runs(table).collect()
    got = sorted([(r.doc_id, r.collapsed, [tuple(x) for x in r.runs]) for r in out], key=str)
    assert got == sorted([(None, "x y", [(0, 6, 1)]), (1, "", []), (2, "", []), (3, "", []),
                          (4, "a b end", [(0, 8, 2)]), (4, "a b end", [(0, 8, 2)]),
                          (5, "a b", [(0, 8, 1)])], key=str)
    kept = periodic.without_runs(table)
    assert kept.columns == table.columns
    assert {(r.doc_id, r.text) for r in kept.collect()} == {
        (None, "x y"), (1, None), (2, ""), (3, " \t\r\n"), (4, "a b end"), (5, "a b")}
    assert periodic.collapse_runs(docs([])).count() == 0


def plain(doc_id, text):
    """The row of the query, from the written rules."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(len(w))]
    found = brute(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_op12_equals_plain_python(spark, tmp_path):
    """The texts of at most 1,500 words of the smallest table (brute force is quadratic), and made ones."""
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()]
    rows = [r for r in rows if len((r[1] or "").split()) <= 1500]
    rng = random.Random(9)
    rows += [(10_000 + i, " ".join(map(str, words_of(i % 5, rng)))) for i in range(60)]
    rows += [(None, "a " * 9), (77_777, None), (77_778, " ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted([tuple(r) for r in periodic.op12_query(spark, str(tmp_path)).collect()], key=str)
    assert got == sorted([plain(*r) for r in rows], key=str)
    assert sum(r[1] > 0 for r in got) > 40
