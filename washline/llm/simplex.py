"""Centroid clustering with exact integer distances, filtered by n-simplex projection.

Vectors of ``DIM`` finite components become integers floor(256 * x). ``k`` of them, those with the
smallest SHA-256 of ``2:<vec_id>``, are the first centroids; each round assigns every vector to the
nearest centroid (squared distance; ties: smaller number) and moves every non-empty centroid to the
exact floor of its vectors' mean. A last assignment gives the result.

Distances to some pivots decide most comparisons. The pivots (of the vectors with the smallest hashes,
each the one farthest from the span of those before) form a simplex, and the distances of an object
to them are the edges of a simplex over that base: its apex has one coordinate per pivot, of which the
last is the height over the base. For two apexes, the distance is a lower bound of the true distance,
and the distance with one height turned down is an upper bound. The apexes of all vectors are computed
once and written beside the integers; per round only the apexes of the centroids are new. The centroid
with the least middle of its bounds is compared exactly; a centroid whose lower bound is above that
distance, or above the least upper bound, cannot be the nearest, and the others are compared in
integers. Bounds are widened by the rounding error of their doubles, so that the filter never decides
a tie. The given vectors have no directions of their own (64 about equal axes), so that few pivots
tell little: of 40 centroids, 39.2 are compared with 16 pivots, 13 to 16 with 48 and 4 to 5 with 56.

Per task and round one sum and count per centroid leave the executors; the driver holds k centroids
only. Each round reads the written table, so that a lost executor repeats its share of one round.

Vectors with another number of components, or with a null, NaN or infinite one, are left out; null
vectors too. Integers beyond +-2^27 (components beyond +-2^19) stop there, so that every distance is a
long. Repeated rows are vectors of their own; of rows with one id the smaller vector comes first as
a first centroid. A null id has the hash of ``2:``. With fewer than k vectors each starts a centroid;
an empty table gives no rows. Sums of distances beyond a long are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from washline.llm.common import drop_scratch, scratch_table

DIM = 64
LIMIT = 1 << 27
CHUNK = 4096


def integer_vectors(table: DataFrame, dim: int = DIM) -> DataFrame:
    """vec_id and v (array of long), the rows of ``table`` (vec_id, embedding) that are kept."""
    x = F.col("embedding")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    scaled = F.transform(x, lambda c: F.greatest(F.lit(-LIMIT), F.least(
        F.lit(LIMIT), F.floor(c.cast("double") * 256))).cast("bigint"))
    return table.where((F.size(x) == dim) & F.coalesce(whole, F.lit(False))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), scaled.alias("v"))


def first_vectors(vectors: DataFrame, k: int, salt: str = "2:") -> np.ndarray:
    """The k vectors with the smallest hash of their id, in that order (k rows come to the driver)."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select("v", digest.alias("_h")).orderBy("_h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


@dataclass
class Simplex:
    """Pivots and what turns distances to them into apex coordinates."""

    pivots: np.ndarray
    inverse: np.ndarray
    norms: np.ndarray
    depth: float  # the least height of a pivot over those before it

    @staticmethod
    def over(points: np.ndarray, most: int) -> Simplex:
        """The simplex over at most ``most`` of ``points``, flat ones left out."""
        rest = points.astype(np.float64) - points[0]
        chosen, scale = [0], float((rest ** 2).sum(axis=1).max(initial=0.0))
        depth = np.sqrt(scale)
        for _ in range(most - 1):
            height = (rest ** 2).sum(axis=1)
            far = int(height.argmax())
            if height[far] <= 1e-4 * scale or scale == 0.0:
                break
            chosen.append(far)
            depth = float(np.sqrt(height[far]))
            axis = rest[far] / np.sqrt(height[far])
            rest = rest - np.outer(rest @ axis, axis)
        pivots = points[chosen].astype(np.float64)
        edges = ((pivots[:, None] - pivots[None]) ** 2).sum(axis=2)
        # places of the pivots from their distances: row i has i coordinates, the first pivot none
        base = np.linalg.cholesky((edges[1:, :1] + edges[:1, 1:] - edges[1:, 1:]) / 2) if len(chosen) > 1 \
            else np.zeros((0, 0))
        return Simplex(points[chosen], np.linalg.inv(base) if len(base) else base, edges[0, 1:],
                       depth or 1.0)

    def apexes(self, v: np.ndarray) -> np.ndarray:
        """Apex coordinates of integer vectors, from their distances to the pivots."""
        d = np.stack([((v - p) ** 2).sum(axis=1) for p in self.pivots], axis=1).astype(np.float64)
        flat = ((d[:, :1] + self.norms - d[:, 1:]) / 2) @ self.inverse.T
        height = np.sqrt(np.maximum(d[:, 0] - (flat ** 2).sum(axis=1), 0.0))
        return np.column_stack([flat, height])


    def bounds(self, a: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances between two sets of apexes, widened by
        what rounding may have changed (more where pivots are near each other and objects far)."""
        size = (a ** 2).sum(axis=1)[:, None] + (c ** 2).sum(axis=1)[None]
        low = size - 2 * (a @ c.T)
        high = low + 4 * np.outer(a[:, -1], c[:, -1])
        slack = size * (1e-9 + 1e-12 * np.sqrt(size) / self.depth) + 1.0
        return low - slack, high + slack


def nearest(v: np.ndarray, a: np.ndarray, centroids: np.ndarray, simplex: Simplex,
            apexes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of and squared distance to the nearest centroid, and how many were compared exactly."""
    low, high = simplex.bounds(a, apexes)
    guess = ((v - centroids[(low + high).argmin(axis=1)]) ** 2).sum(axis=1)
    row, col = np.nonzero(low <= np.minimum(high.min(axis=1), guess)[:, None])
    exact = np.empty(len(row), np.int64)
    for i in range(0, len(row), CHUNK * 8):
        part = slice(i, i + CHUNK * 8)
        exact[part] = ((v[row[part]] - centroids[col[part]]) ** 2).sum(axis=1)
    # per vector the least distance, then the smallest number
    first = np.lexsort((col, exact, row))
    _, at = np.unique(row[first], return_index=True)
    best = first[at]
    return col[best].astype(np.int32), exact[best], len(row)


def _blocks(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for at in range(0, batch.num_rows, CHUNK):
        part = batch.slice(at, CHUNK)
        v = np.frombuffer(b"".join(part.column(1).to_pylist()), "<i4").reshape(part.num_rows, -1)
        a = np.frombuffer(b"".join(part.column(2).to_pylist()), "<f8").reshape(part.num_rows, width)
        yield part, v.astype(np.int64), a


def cached_apexes(vectors: DataFrame, simplex: Simplex) -> DataFrame:
    """vec_id, the integers and the apex of every vector, both as packed little-endian numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                a = simplex.apexes(v)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([r.tobytes() for r in v.astype("<i4")], pa.binary()),
                     pa.array([r.tobytes() for r in a.astype("<f8")], pa.binary())], names=["vec_id", "v", "a"])
    return vectors.mapInArrow(run, "vec_id bigint, v binary, a binary")


def _sums(table: DataFrame, centroids: np.ndarray, simplex: Simplex) -> list:
    """Per centroid its number of vectors and the sums of their components."""
    apexes = simplex.apexes(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # whole numbers below 2^27 in tasks of under 2^36 vectors stay within 64 bits
        total = np.zeros(centroids.shape, np.int64)
        count = np.zeros(len(centroids), np.int64)
        for batch in batches:
            for _, v, a in _blocks(batch, apexes.shape[1]):
                number, _, _ = nearest(v, a, centroids, simplex, apexes)
                order = np.argsort(number, kind="stable")
                some, start = np.unique(number[order], return_index=True)
                total[some] += np.add.reduceat(v[order], start, axis=0)
                count += np.bincount(number, minlength=len(count))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))],
            names=["cluster", "n", "s"])

    parts = table.mapInArrow(run, "cluster int, n bigint, s array<bigint>")
    by_place = parts.select("cluster", "n", F.posexplode("s").alias("place", "x"))
    return by_place.groupBy("cluster", "place").agg(
        F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).collect()


def _assigned(table: DataFrame, centroids: np.ndarray, simplex: Simplex) -> DataFrame:
    apexes = simplex.apexes(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, v, a in _blocks(batch, apexes.shape[1]):
                number, distance, _ = nearest(v, a, centroids, simplex, apexes)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(number), pa.array(distance)],
                                                 names=["vec_id", "cluster", "distance"])
    return table.mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def cluster(table: DataFrame, k: int = 40, rounds: int = 5, pivots: int = 56, dim: int = DIM
            ) -> tuple[DataFrame, np.ndarray]:
    """The assignment of every kept vector of ``table`` (vec_id, embedding, any others), as vec_id,
    cluster and distance, and the final centroids (at most k rows of integers)."""
    spark = table.sparkSession
    vectors = integer_vectors(table, dim)
    first = first_vectors(vectors, max(k, 2 * pivots))
    centroids = first[:k]
    if not len(centroids):
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), centroids
    simplex = Simplex.over(first, pivots)
    cached, path = scratch_table(cached_apexes(vectors, simplex), "simplex-apexes")
    for _ in range(rounds):
        moved = centroids.copy()
        for r in _sums(cached, centroids, simplex):
            moved[r["cluster"], r["place"]] = int(r["s"]) // r["n"]
        centroids = moved
    out, _ = scratch_table(_assigned(cached, centroids, simplex), "simplex-assigned")
    drop_scratch(spark, path)
    return out, centroids


def with_inertia(spark: SparkSession, assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with each cluster's and the whole table's sum of distances, and a digest of the
    centroid. The table that is broadcast has a row per centroid."""
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
               for i, c in enumerate(centroids.tolist())]
    names = spark.createDataFrame(digests, "_c int, centroid_sha256 string")
    sums = assigned.groupBy(F.col("cluster").alias("_c")).agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("_s"))
    total = sums.agg(F.sum("_s").alias("_all"))
    side = sums.join(F.broadcast(names), "_c").join(F.broadcast(total))
    return assigned.join(F.broadcast(side), assigned["cluster"] == side["_c"]).select(
        "vec_id", "cluster", "distance", F.col("_s").try_cast("bigint").alias("cluster_inertia"),
        F.col("_all").try_cast("bigint").alias("inertia"), "centroid_sha256")


def op13_query(spark, sf_dir: str) -> DataFrame:
    assigned, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return with_inertia(spark, assigned, centroids)
