"""Near-duplicate documents: DartMinHash signatures, banded joining, exact verification.

1. Every whole text gets a DartMinHash signature of its weighted five-word shingles. Equal texts
   are one node (their digest), so copies are never expanded.
2. Banded joining. Nodes that share a band are candidates. A bucket is not expanded into pairs:
   each node is paired with the first node of one bucket only, and the exact weighted Jaccard similarity
   decides (links from signatures that agree in too few coordinates to reach the threshold are
   not verified). That joins most copies to their group.
3. The exact way for the rest. Where a bucket still holds several components, the nodes outside
   its largest component are compared with all nodes of the bucket, in blocks of bounded size:
   first signature against signature, then, for the nodes of pairs that agree enough, by exact
   similarity. A block returns links that join components, never all its pairs. So no pair that
   shares a band is left undecided.
4. Connected components of the links are the classes.

With 24 bands of 4 coordinates a pair at similarity 0.8 shares a band with probability
1 - (1 - 0.8^4)^24 > 0.999996.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from washline.llm import dartminhash as dart
from washline.llm.common import drop_scratch, free_name, scratch_table
from washline.llm.components import components

BANDS, ROWS = 24, 4
THRESHOLD = 0.8
SHINGLE = 5
#: Coordinates that must agree before a pair is verified: five standard deviations below the mean
#: at the threshold, so that less than one true link in a million is left out.
AGREE = int(BANDS * ROWS * THRESHOLD - 5 * (BANDS * ROWS * THRESHOLD * (1 - THRESHOLD)) ** 0.5)
#: Nodes of one bucket that one block of the exact comparison holds.
BLOCK = 500
#: Bytes of text that a task hashes at a time.
STEP_BYTES = 1 << 19


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key (digest of the whole text; null is an empty text) and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.unhex(F.md5(text)).alias("key"), text.alias("text"))


def _steps(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of a batch's texts of about STEP_BYTES; a longer text is a run of its own."""
    column, at = batch.column(batch.schema.names.index("text")), 0
    while at < batch.num_rows:
        texts, size, i = [], 0, at
        while i < batch.num_rows and (not texts or size < STEP_BYTES):
            texts.append(column[i].as_py().encode("utf-8", "surrogatepass"))
            size += len(texts[-1])
            i += 1
        yield at, texts
        at = i


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in _steps(batch):
            sig, total = dart.signatures(texts, BANDS * ROWS, SHINGLE)
            bands = dart.band_hashes(sig, BANDS, ROWS).view(np.int64)
            size = np.where(total > 0, BANDS, 0)  # no words: no band, no candidates
            flat = bands[total > 0].ravel()
            yield pa.RecordBatch.from_arrays([
                batch.column(0)[at:at + len(texts)], batch.column(1)[at:at + len(texts)],
                pa.ListArray.from_arrays(np.append([0], np.cumsum(size)).astype(np.int32),
                                         pa.array(flat)),
                pa.array([s.tobytes() for s in sig], pa.binary())],
                names=["doc_id", "key", "bands", "sig"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in _steps(batch):
            x, doc = dart.multiset(*dart.shingles(texts, SHINGLE))
            order = np.lexsort((x, doc))
            size = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), int)
            yield pa.RecordBatch.from_arrays([
                batch.column(1)[at:at + len(texts)],
                pa.ListArray.from_arrays(np.append([0], np.cumsum(size)).astype(np.int32),
                                         pa.array(x[order].view(np.int64)))],
                names=["key", "elements"])


def agreement(a: pd.Series, b: pd.Series) -> np.ndarray:
    x = np.frombuffer(b"".join(a), np.uint32).reshape(len(a), -1)
    y = np.frombuffer(b"".join(b), np.uint32).reshape(len(b), -1)
    return (x == y).sum(1)


@F.pandas_udf(IntegerType())
def _agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(agreement(a, b) if len(a) else [], dtype="int32")


def _verify(pairs: DataFrame, elements: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of keys whose exact weighted Jaccard similarity reaches the threshold."""
    left = elements.select(F.col("key").alias("a"), F.col("elements").alias("_x"))
    right = elements.select(F.col("key").alias("b"), F.col("elements").alias("_y"))
    both = F.size(F.array_intersect("_x", "_y"))
    return (pairs.join(left, "a").join(right, "b")
            .where(both >= threshold * (F.size("_x") + F.size("_y") - both) - 1e-9)
            .select("a", "b"))


def _grid(visit):
    """Iterate the (bucket, block) groups of sorted rows; rows of side 0 are compared with side 1."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(group: pd.DataFrame) -> pd.DataFrame | None:
            rest, members = group[group["side"] == 0], group[group["side"] == 1]
            return visit(rest, members) if len(rest) and len(members) else None

        held = None
        for batch in batches:
            if held is not None:
                batch = pd.concat([held, batch])
            cell = batch[["band", "i", "j"]].ne(batch[["band", "i", "j"]].shift()).any(axis=1).cumsum()
            groups = [g for _, g in batch.groupby(cell.to_numpy(), sort=False)]
            held = groups.pop() if groups else None
            found = [f for f in map(one, groups) if f is not None]
            if found:
                yield pd.concat(found)
        if held is not None and (f := one(held)) is not None:
            yield f
    return run


def _candidates(rest: pd.DataFrame, members: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of the rest: members of another component that agree enough, best first.

    A pair that shares several bands is left to the first of them.
    """
    x = np.frombuffer(b"".join(rest["sig"]), np.uint32).reshape(len(rest), -1)
    y = np.frombuffer(b"".join(members["sig"]), np.uint32).reshape(len(members), -1)
    root, own, pos = members["root"].to_numpy(), rest["root"].to_numpy(), rest["pos"].iat[0]
    for r in range(len(x)):
        same = y == x[r]
        agree = same.sum(1)
        hit = np.flatnonzero((agree >= AGREE) & (root != own[r]))
        if len(hit):
            hit = hit[same[hit].reshape(len(hit), BANDS, ROWS).all(2).argmax(1) == pos]
        if len(hit):
            yield r, hit[np.argsort(-agree[hit], kind="stable")]


def _mark(rest: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame | None:
    """The rows of a group that take part in any candidate pair."""
    left, right = [], np.zeros(len(members), bool)
    for r, hit in _candidates(rest, members):
        left.append(r)
        right[hit] = True
    if not left:
        return None
    keys = np.concatenate([rest["key"].to_numpy()[left], members["key"].to_numpy()[right]])
    return pd.DataFrame({"band": rest["band"].iat[0], "key": keys})


def _link(threshold: float):
    def visit(rest: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame | None:
        """Links between components of a group; pairs that its links already join are passed over."""
        up: dict[bytes, bytes] = {}

        def top(v: bytes) -> bytes:
            while v in up:
                v = up[v]
            return v

        out = []
        xs, ys = rest["elements"].to_numpy(), members["elements"].to_numpy()
        for r, hit in _candidates(rest, members):
            for m in hit.tolist():
                a, b = top(rest["root"].iat[r]), top(members["root"].iat[m])
                if a == b:
                    continue
                both = len(np.intersect1d(xs[r], ys[m], assume_unique=True))
                if both >= threshold * (len(xs[r]) + len(ys[m]) - both) - 1e-9:
                    up[max(a, b)] = min(a, b)
                    out.append((rest["key"].iat[r], members["key"].iat[m]))
        return pd.DataFrame(out, columns=["a", "b"]) if out else None
    return visit


def _open(members: DataFrame) -> DataFrame:
    """The rows of ``members`` (band, pos, key, root) whose bucket holds several components, with its
    largest component (main) and the numbers of blocks for all rows (nj) and for the others' (ni)."""
    sizes = members.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("band").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("all"),
        F.max("n").alias("most"), F.count(F.lit(1)).alias("roots")).where(F.col("roots") > 1)
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    return members.join(sizes.select("band", "main", blocks(F.col("all")).alias("nj"),
                                     blocks(F.col("all") - F.col("most")).alias("ni")), "band")


def _cells(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Open buckets as groups of bounded blocks: in each, the rows outside the largest component
    (side 0, blocks i) meet all rows (side 1, blocks j)."""
    own = lambda n: F.pmod(F.xxhash64("key"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    columns = ["band", "i", "j", "side", "pos", "key", "root", *columns]
    rest = (rows.where(F.col("root") != F.col("main")).withColumn("side", F.lit(0))
            .withColumn("i", own(F.col("ni"))).withColumn("j", every(F.col("nj"))))
    against = (rows.withColumn("side", F.lit(1))
               .withColumn("j", own(F.col("nj"))).withColumn("i", every(F.col("ni"))))
    return (rest.select(columns).unionByName(against.select(columns))
            .repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "side"))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, any others): doc_id, key, class_id and root.

    root names the class, the smallest digest of its texts; class_id is its smallest doc_id, which
    several classes share if rows of unlike texts share that id. A class is the documents with equal
    texts, or joined by a chain of links, each a pair of texts with weighted Jaccard similarity of
    their five-word shingles at or above ``threshold``. Texts of fewer than five words have one
    shingle, all their words. Null texts count as empty; texts without words only match equal texts.
    Rows with a null doc_id belong to their class like others, and class_id is null only if all its
    ids are. Repeated rows share a class. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = keyed(docs)
    signed, signed_path = scratch_table(
        texts.mapInArrow(_sign, "doc_id bigint, key binary, bands array<bigint>, sig binary"), "signed")
    nodes, nodes_path = scratch_table(
        signed.where(F.size("bands") > 0).dropDuplicates(["key"]), "nodes")

    bands = nodes.select("key", F.posexplode("bands").alias("pos", "band"))
    buckets = bands.groupBy("band").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n"))
    shared, shared_path = scratch_table(
        bands.join(buckets.where(F.col("n") > 1).drop("n"), "band"), "shared")
    sig = nodes.select(F.col("key").alias("_k"), "sig")

    # each node with that first node of its buckets whose signature agrees best
    stars = shared.where(F.col("key") != F.col("first")).select("key", "first").distinct()
    stars = stars.join(sig, stars["key"] == sig["_k"]).select("key", "first", F.col("sig").alias("_x"))
    stars = stars.join(sig, stars["first"] == sig["_k"]).select("key", "first", "_x", "sig")
    near = (stars.select("key", "first", _agreement("_x", "sig").alias("n"))
            .where(F.col("n") >= AGREE).groupBy(F.col("key").alias("b"))
            .agg(F.max_by("first", F.struct("n", "first")).alias("a")))

    own = nodes.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"))
    wanted = own.join(shared.select(F.col("key").alias("_k")).distinct(), "_k", "left_semi")
    wanted_texts = (texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["_d"])
                               & (texts["key"] == wanted["_k"]), "left_semi"))
    elements, elements_path = scratch_table(
        wanted_texts.mapInArrow(_elements, "key binary, elements array<bigint>")
        .dropDuplicates(["key"]), "elements")
    links, links_path = scratch_table(_verify(near, elements, threshold), "stars")
    roots, root_paths = components(links)

    # the exact way for the rest: buckets that still hold several components
    top = roots.select(F.col("node").alias("_n"), "root")
    members = shared.join(top, shared["key"] == top["_n"], "left").select(
        "band", "pos", "key", F.coalesce("root", "key").alias("root"))
    signs = _open(members)
    signs = signs.join(sig, signs["key"] == sig["_k"]).drop("_k")
    marked, marked_path = scratch_table(
        _cells(signs, ["sig"]).mapInPandas(_grid(_mark), "band bigint, key binary").distinct(), "marked")
    # signature and elements meet once per node, not once per band
    whole = nodes.select("key", "sig").join(marked.select("key").distinct(), "key", "left_semi").join(
        elements, "key")
    open_rows = _open(members.join(marked, ["band", "key"])).join(whole, "key")
    late, late_path = scratch_table(
        _cells(open_rows, ["sig", "elements"]).mapInPandas(
            _grid(_link(threshold)), "a binary, b binary"), "late")
    roots, more_paths = components(links.unionByName(late))
    drop_scratch(spark, shared_path, elements_path, links_path, late_path, nodes_path, marked_path,
                 *root_paths)

    top = roots.select(F.col("node").alias("_n"), "root")
    rows = signed.select("doc_id", "key")
    rows = rows.join(top, rows["key"] == top["_n"], "left").select(
        "doc_id", "key", F.coalesce("root", "key").alias("root"))
    least = rows.groupBy(F.col("root").alias("_r")).agg(F.min("doc_id").alias("class_id"))
    return rows.join(least, rows["root"] == least["_r"]).select("doc_id", "key", "class_id", "root")


def keep_first(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pipeline stage: one document of each class stays, the one with the smallest doc_id.

    Of several texts with that id, and in classes without any id, the one with the smallest digest
    stays. Only ids and digests are joined on.
    """
    least = classes(docs, threshold).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    keep, _ = scratch_table(least.groupBy("root", F.col("class_id").alias("_d")).agg(
        F.min("key").alias("_k")).select("_d", "_k"), "kept")
    name = free_name(docs, "_key")
    rows = docs.withColumn(name, F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))))
    rows = rows.join(keep, rows["doc_id"].eqNullSafe(keep["_d"]) & (rows[name] == keep["_k"]),
                     "left_semi")
    return rows.dropDuplicates(["doc_id", name]).drop(name)


def op6_query(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "class_id", F.lower(F.hex("root")).alias("class_key"))
