"""Clustering: brute-force k-means in whole numbers, bounds, odd vectors."""

import hashlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from tests.conftest import SMALL
from washline.llm import simplex


def brute(ids, x, k=40, rounds=5):
    order = sorted(range(len(ids)), key=lambda i: (
        hashlib.sha256(f"2:{'' if ids[i] is None else ids[i]}".encode()).hexdigest(), x[i].tolist()))
    c = x[order[:k]].astype(object)

    def nearest():
        out = []
        for v in x.astype(object):
            d = [int(((v - m) ** 2).sum()) for m in c]
            out.append((d.index(min(d)), min(d)))
        return out
    for _ in range(rounds):
        at = [a for a, _ in nearest()]
        for j in range(len(c)):
            mine = x[[i for i, a in enumerate(at) if a == j]].astype(object)
            if len(mine):
                c[j] = [int(s) // len(mine) for s in mine.sum(axis=0)]
    return nearest(), c


def whole(embeddings):
    return np.floor(np.array(embeddings, np.float64) * 256).astype(np.int64)


def test_op13_equals_brute_force(spark):
    table = pq.read_table(f"{SMALL}/embeddings.parquet").to_pydict()
    expect, c = brute(table["vec_id"], whole(table["embedding"]))
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c.tolist()]
    inertia = sum(d for _, d in expect)
    per = {j: sum(d for a, d in expect if a == j) for j in range(len(c))}
    got = {r.vec_id: tuple(r)[1:] for r in simplex.op13_query(spark, SMALL).collect()}
    assert got == {i: (a, d, per[a], inertia, sha[a]) for i, (a, d) in zip(table["vec_id"], expect, strict=True)}


@pytest.mark.parametrize("pivots", [1, 2, 5, 12, 30])
def test_bounds_hold_and_decide_nothing_wrong(pivots):
    rng = np.random.default_rng(pivots)
    for scale, offset in ((3, 0), (200, 50_000), (1 << 20, 0), (2, 1 << 27)):
        v = rng.integers(-scale, scale + 1, (300, 12)) + offset
        v[:50] = v[50:100]  # repeated vectors
        c = np.concatenate([v[::30], rng.integers(-scale, scale + 1, (7, 12))])
        s = simplex.Simplex.over(v[:20], pivots)
        a, b = s.apexes(v), s.apexes(c)
        exact = ((v[:, None] - c[None]) ** 2).sum(axis=2)
        low, high = s.bounds(a, b)
        assert (low <= exact).all() and (exact <= high).all()
        number, distance, _ = simplex.nearest(v, a, c, s, b)
        assert (number == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()


def test_bounds_filter_clustered_vectors():
    rng = np.random.default_rng(1)
    middle = rng.integers(-5000, 5000, (40, 64))
    v = middle[rng.integers(0, 40, 4000)] + rng.integers(-100, 100, (4000, 64))
    s = simplex.Simplex.over(v[:80], 16)
    _, _, compared = simplex.nearest(v, s.apexes(v), middle, s, s.apexes(middle))
    assert compared < 10 * len(v)  # of 40 each


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string, cluster string, _h string")


def test_odd_vectors_ties_and_clashing_columns(spark):
    def row(i, e):
        return (i, e, "clash", "clash", "clash")
    one, two = [0.5] * 64, [-0.25] * 64
    rows = [row(1, one), row(1, one), row(None, two), row(2, None), row(3, []), row(4, [1.0] * 63),
            row(5, [None] + [1.0] * 63), row(6, [float("nan")] + [1.0] * 63), row(7, [float("inf")] + [1.0] * 63),
            row(8, [3e38] * 64), row(9, two), row(10, [-3e38] * 64)]
    got, c = simplex.cluster(vectors(spark, rows))
    kept = [r for r in rows if r[0] in (1, None, 8, 9, 10)]
    x = np.clip(np.array([[int(np.floor(float(v) * 256)) if abs(v) < 1e9 else int(np.sign(v)) << 27 for v in r[1]]
                          for r in kept]), -(1 << 27), 1 << 27)
    expect, _ = brute([r[0] for r in kept], x)
    assert sorted([(r.vec_id, r.cluster, r.distance) for r in got.collect()], key=str) == sorted(
        [(r[0], a, d) for r, (a, d) in zip(kept, expect, strict=True)], key=str)
    assert len(c) == len(kept)


def test_empty_and_identical_tables(spark):
    got, c = simplex.cluster(vectors(spark, []))
    assert got.count() == 0 and len(c) == 0
    assert simplex.with_inertia(spark, got, c).count() == 0
    got, c = simplex.cluster(vectors(spark, [(i, [1.0] * 64, "", "", "") for i in range(100)]))
    assert {(r.cluster, r.distance) for r in got.collect()} == {(0, 0)}
