"""Mixing sources to target weights by systematic sampling (DataFrame operations only).

Each source gets a target share of the corpus size, by weight, but at most ``max_repeat`` times
its own size; what a capped source cannot take is shared again among the others by weight. That
fixed point is ``target = min(max_repeat * size, level * weight)`` with one common ``level``
(water filling), found from sorted prefix sums over the table of sources.

All documents of a source have the same expected number of copies, ``target / size``. Systematic
sampling lays them on a line, each as long as its expected copies (a prefix sum within the
source), shifts the line by one random offset per source and emits a document once for each
integer boundary it crosses. Documents lie on the line by size, so that every stretch of
neighbours has much the same size and the words taken come close to the target.

A source may hold a third of all rows. Its line is therefore cut into cells of about
``cell_rows`` documents by a hash of id and text: per-cell counts are summed (a partial aggregate), the
small cell table is prefix-summed within the source, and rows are numbered within cells only. Equal rows
(id, text and source) are counted before they are placed, so that neither they nor rows without an id
fill a cell; they take one stretch of the line and are told apart again afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from washline.functions.running import checkpointed
from washline.llm.common import free_name, word_count

_UNIT = 1 << 20


def _hash20(value: Column) -> Column:
    """20 bits of the MD5 of a text; plain functions, so that reruns and other engines agree."""
    return F.conv(F.substring(F.md5(value), 1, 5), 16, 10).cast("long")


def targets(stats: DataFrame, weights: tuple[int, ...] = (1, 2, 3),
            max_repeat: float = 3.0, share: float = 1.0) -> DataFrame:
    """Targets per source from ``stats`` (source, n_docs, source_size).

    Sources in code-point order, null last, weigh ``weights``, repeating. Adds weight, target and
    offset. The table of sources is a dimension of the corpus: its windows run over one row per
    source, not over documents.
    """
    by_source = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = stats.withColumn("_k", F.row_number().over(by_source) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("_k") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("weight", weight).withColumn(
        "_cap", F.lit(float(max_repeat)) * F.col("source_size"))
    # In the order of cap/weight the sources that stop at their cap come first. Behind each
    # prefix of capped sources the common level is (rest of the total) / (rest of the weights).
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("_cap") / F.col("weight"), "_k")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    levelled = (
        capped
        .withColumn("_total", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("_rest", F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_left", F.sum("weight").over(everything)
                    - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("_level", F.col("_rest") / F.col("_left"))
    )
    ratio = F.col("_cap") / F.col("weight")
    # the level in force is that of the first source, in this order, whose cap is not reached
    level = F.min(F.when(ratio >= F.col("_level"), F.struct(
        ratio.alias("ratio"), "_k", "_level"))).over(everything)["_level"]
    return levelled.withColumn("_common", level).select(
        "source", "n_docs", "source_size", "weight",
        F.least(F.col("_cap"), F.coalesce(F.col("_common") * F.col("weight"), F.col("_cap")))
        .alias("target"),
        (_hash20(F.concat(F.lit("offset:"), F.coalesce("source", F.lit("\u0000")))) / _UNIT)
        .alias("offset"))


def _sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and a digest of the text, from one pass over the texts."""
    return docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"),
        F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


def _mixed(sized: DataFrame, weights: tuple[int, ...], max_repeat: float, share: float, cell_rows: int) -> DataFrame:
    """One row per distinct (doc_id, source, digest): n (equal rows), size, source_size, target, expected,
    offset and end, the stretch of the line up to which its rows reach."""
    rows = sized.groupBy("source", "doc_id", "digest", "size").agg(F.count(F.lit(1)).alias("n"))
    stats = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"),
                                        F.sum("size").alias("source_size"))
    goal = targets(stats, weights, max_repeat, share).select(
        F.col("source").alias("_s"), "n_docs", "source_size", "target", "offset",
        F.greatest(F.lit(1), F.ceil(F.col("n_docs") / cell_rows)).cast("long").alias("_cells"))
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("digest"))
    placed = rows.join(goal, rows["source"].eqNullSafe(goal["_s"]), "left").withColumn(
        "_cell", _hash20(key) % F.col("_cells"))
    cells = placed.groupBy("_s", "_cell").agg(F.sum("n").alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(
            Window.partitionBy("_s").orderBy("_cell")
            .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cells = cells.select(F.col("_s").alias("_cs"), F.col("_cell").alias("_cc"), "_before")
    in_cell = Window.partitionBy("_s", "_cell").orderBy("size", "doc_id", "digest").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    line = placed.withColumn("_i", F.sum("n").over(in_cell)).join(
        cells, placed["_s"].eqNullSafe(cells["_cs"]) & (placed["_cell"] == cells["_cc"]), "left")
    expected = F.when(F.col("source_size") > 0,
                      F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return line.withColumn("expected", expected).withColumn("end", F.col("_before") + F.col("_i")).select(
        "doc_id", "source", "digest", "n", "size", "source_size", "target", "expected", "offset", "end")


def _boundaries(end: Column) -> Column:
    """Integer boundaries crossed up to a place on the line."""
    return F.floor(end * F.col("expected") + F.col("offset"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: float = 3.0,
        share: float = 1.0, cell_rows: int = 20_000) -> DataFrame:
    """The mix of ``docs`` (doc_id, text, source and any others) as a copy count per document.

    Returns doc_id, size (words), source, source_size, target, expected
    (copies) and copies. Every input row gives one row; repeated rows are separate documents that
    may get different counts. Null text has size 0; null sources form one source, the last in
    order; null ids are ordinary (smallest) ids. A source without words has target 0 and no
    copies; so has an empty table no rows.
    """
    sized = checkpointed(_sized(docs))  # texts are read once; narrow columns are kept
    line = _mixed(sized, weights, max_repeat, share, cell_rows)
    each = line.withColumn("_place", F.explode(F.sequence(F.col("end") - F.col("n") + 1, F.col("end"))))
    copies = _boundaries(F.col("_place")) - _boundaries(F.col("_place") - 1)
    return each.select(
        "doc_id", "size", "source", "source_size", "target", "expected",
        F.least(copies.cast("long"), F.lit(int(max_repeat))).alias("copies"))


def emit(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: float = 3.0,
         cell_rows: int = 20_000) -> DataFrame:
    """The mixed corpus: each document of ``docs`` as often as the mix takes it, all columns kept.

    The counts are made from ids and digests and joined back by them, so whole rows are moved once. Rows of
    equal id, text and source are one document several times over: its copies carry the columns of one of them.
    """
    sized = checkpointed(_sized(docs))
    taken = (_boundaries(F.col("end")) - _boundaries(F.col("end") - F.col("n"))).cast("long")
    counts = _mixed(sized, weights, max_repeat, 1.0, cell_rows).select("doc_id", "source", "digest", "n", taken.alias("copies"))
    counts = checkpointed(counts)
    wanted = counts.where(F.col("copies") > 0)
    names = {c: free_name(docs, f"_{c}") for c in ("doc_id", "source", "digest", "copies", "n")}
    wanted = wanted.withColumnsRenamed(names)
    same = (docs["doc_id"].eqNullSafe(F.col(names["doc_id"])) & docs["source"].eqNullSafe(F.col(names["source"]))
            & (F.md5(F.coalesce(docs["text"], F.lit(""))) == F.col(names["digest"])))
    hit = docs.join(wanted.hint("merge"), same)
    once = hit.where(F.col(names["n"]) == 1)
    # equal rows: the first of each task, then of all, stands for them
    several = hit.where(F.col(names["n"]) > 1)
    row = F.struct(*[F.col(c) for c in docs.columns])
    several = several.groupBy(names["doc_id"], names["source"], names["digest"]).agg(
        F.first(row).alias("_row"), F.first(names["copies"]).alias("_times")).select("_row.*", F.col("_times").alias(names["copies"]))
    out = once.select(*docs.columns, names["copies"]).unionByName(several)
    times = F.sequence(F.lit(1), F.col(names["copies"]).cast("int"))
    return out.withColumn(names["n"], F.explode(times)).select(*docs.columns)


def op2_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target",
                            (F.col("copies") * F.col("size")).alias("taken"))


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(text, '')) AS digest
  FROM documents
), stats AS (
  SELECT source, count(*) AS n_docs, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS k FROM stats
), capped AS (
  SELECT *, (k % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size::DOUBLE AS cap FROM ranked
), levelled AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, k
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(weight) OVER ()
             - coalesce(sum(weight) OVER (ORDER BY cap / weight, k
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM capped
), common AS (
  SELECT level FROM levelled WHERE cap / weight >= level ORDER BY cap / weight, k LIMIT 1
), goal AS (
  SELECT source, n_docs, source_size,
         least(cap, coalesce((SELECT level FROM common) * weight, cap)) AS target,
         ('0x' || substr(md5('offset:' || coalesce(source, chr(0))), 1, 5))::BIGINT / 1048576.0::DOUBLE
           AS shift,
         greatest(1, ceil(n_docs / 20000.0))::BIGINT AS cells
  FROM levelled
), placed AS (
  SELECT s.doc_id, s.size, s.digest, g.source, g.source_size, g.target, g.shift,
         CASE WHEN g.source_size > 0 THEN g.target / g.source_size::DOUBLE ELSE 0.0::DOUBLE END
           AS expected,
         ('0x' || substr(md5(coalesce(s.doc_id::VARCHAR, '') || ':' || s.digest), 1, 5))::BIGINT % g.cells AS cell
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
), line AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY cell, size, doc_id NULLS FIRST, digest) AS pos
  FROM placed
)
SELECT doc_id, size, source_size, target,
       (floor(pos * expected + shift) - floor((pos - 1) * expected + shift))::BIGINT * size AS taken
FROM line
"""
