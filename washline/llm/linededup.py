"""Lines that many documents repeat, kept in one document only (DataFrame functions only).

A line's key is the line without blanks (space, tab, LF, VT, FF, CR) at its ends and with A-Z in
lower case. Keys of at least ``min_chars`` code points found in at least ``min_docs`` documents stay
in the largest doc_id that holds them, with all their lines there; all their other lines go.

Only hashes travel: a row per eligible line with the 128-bit hash of its key, the document and the
position. The rows are range-partitioned by (hash, cell), a cell being a share of the documents, and
sorted by document (largest first) and position inside, so that one pass marks the first occurrence
in each document and a partition needs no other order. The bounds of the ranges come from the data: a
line that a third of all rows share is spread over as many partitions as its rows fill. Marks are
counted per hash (map-side sums first) and the hashes over the limit written; they meet the lines
again in a sort-merge join that AQE splits where one hash is hot. Joins are never broadcasts here,
so the plan is the same at every size.

The result per document is a compressed bitmap of the lines to keep: 64-bit words by number, of which
only those with a dropped line are stored; every word that is missing is all ones.

Rows of equal id and equal text are one document, and get one bitmap; rows of equal id but other
texts are separate documents (so a line of three of them counts three, and where theirs is the
largest id, each keeps it). Null ids are the smallest id. Null and empty texts are one empty line and
lose nothing. A table without rows gives no rows. Any other columns pass through unseen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from washline.llm.common import drop_scratch, free_name, scratch_table

BLANKS = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A document: its id, a hash of its text, and a second one that only rows without an id need.
DOC = ["doc_id", "_t", "_u"]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case and nothing else changed."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


def _documents(docs: DataFrame) -> DataFrame:
    """doc_id, text and the two hashes that tell rows of one id apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"),
        F.xxhash64(text).alias("_t"),
        F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit("\u0000"), text)).otherwise(F.lit(0)).alias("_u"))


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3,
                 partitions: int | None = None) -> DataFrame:
    """The documents of ``docs`` (doc_id, text and any others) that lose lines.

    Returns doc_id, _t and _u (the document), n_dropped and keep, an array of (word, bits): bit i of
    word w is 1 where line 64 * w + i stays. Words without a dropped line are left out.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = _documents(docs).select(*DOC, F.posexplode(_lines(F.col("text"))).alias("pos", "_line"))
    keyed = lines.withColumn("_key", line_key(F.col("_line"))).where(
        F.char_length("_key") >= min_chars).select(
        F.unhex(F.md5("_key")).alias("key"), *DOC, "pos")
    # the texts are read once: the sampling of the ranges rereads hashes only
    hashes, first_path = scratch_table(keyed, "line-hashes")
    cell = F.pmod(F.xxhash64(*DOC), F.lit(n)).cast("int")
    order = [F.desc_nulls_last("doc_id"), "_t", "_u", "pos"]
    ranged = hashes.withColumn("cell", cell).repartitionByRange(n, "key", "cell")
    previous = F.lag(F.struct(*DOC)).over(Window.partitionBy("key", "cell").orderBy(*order))
    streamed = ranged.withColumn("first", previous.isNull() | ~previous.eqNullSafe(F.struct(*DOC)))
    marked, second_path = scratch_table(streamed.drop("cell"), "line-marks")
    drop_scratch(spark, first_path)
    common = (marked.where("first").groupBy("key")
              .agg(F.count(F.lit(1)).alias("_n"), F.max("doc_id").alias("_top"))
              .where(F.col("_n") >= min_docs).select("key", "_top"))
    # read back from a table, the join has a shuffle of its own on both sides, which AQE can split
    common, third_path = scratch_table(common, "line-keys")
    gone = marked.join(common.hint("merge"), "key").where(~F.col("doc_id").eqNullSafe(F.col("_top")))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("pos") % 64).cast("int"))
    words = gone.groupBy(*DOC, F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(
        F.bit_or(bit).alias("_gone"))
    bitmaps = words.groupBy(*DOC).agg(
        F.sum(F.bit_count("_gone")).cast("bigint").alias("n_dropped"),
        F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("_gone").alias("bits")))).alias("keep"))
    out, _ = scratch_table(bitmaps, "line-bitmaps")
    drop_scratch(spark, second_path, third_path)
    return out


def _kept_text(text: Column, keep: Column) -> Column:
    """The lines of ``text`` whose bit is 1, joined by LF again."""
    lines = _lines(text)
    stored = F.map_from_entries(keep)
    last = F.floor((F.size(lines) - 1) / 64).cast("int")
    dense = F.transform(F.sequence(F.lit(0), last),
                        lambda w: F.coalesce(F.try_element_at(stored, w), F.lit(-1).cast("bigint")))
    # lines of one word form a group, so the words are looked up by number and not searched
    groups = F.transform(dense, lambda bits, w: F.filter(
        F.slice(lines, (w * 64 + 1).cast("int"), F.lit(64)),
        lambda _, i: F.call_function("getbit", bits, i) == 1))
    return F.array_join(F.flatten(groups), "\n")


def _with_bitmaps(docs: DataFrame, **limits) -> DataFrame:
    """One row per row of ``docs``: doc_id, text, n_dropped and keep (0 and NULL where nothing goes)."""
    bitmaps = keep_bitmaps(docs, **limits).withColumnsRenamed({c: f"_b{c}" for c in DOC})
    rows = _documents(docs)
    same = [rows[c].eqNullSafe(bitmaps[f"_b{c}"]) if c == "doc_id" else rows[c] == bitmaps[f"_b{c}"] for c in DOC]
    return rows.join(bitmaps.hint("merge"), same, "left")


def without_repeats(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` with its columns, the text without the lines that go. Null texts stay null."""
    names = {c: free_name(docs, f"_b_{c}") for c in DOC + ["n_dropped", "keep"]}
    bitmaps = keep_bitmaps(docs, **limits).withColumnsRenamed(names)
    text = F.coalesce(F.col("text"), F.lit(""))
    id_ = F.col("doc_id").cast("bigint")
    same = (id_.eqNullSafe(F.col(names["doc_id"])) & (F.xxhash64(text) == F.col(names["_t"]))
            & (F.when(id_.isNull(), F.xxhash64(F.lit("\u0000"), text)).otherwise(F.lit(0)) == F.col(names["_u"])))
    keep = F.col(names["keep"])
    new = F.when(keep.isNull(), F.col("text")).otherwise(_kept_text(F.col("text"), keep))
    return docs.join(bitmaps.hint("merge"), same, "left").withColumn("text", new).drop(*names.values())


def op11_query(spark, sf_dir: str) -> DataFrame:
    rows = _with_bitmaps(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = F.when(F.col("keep").isNull(), text).otherwise(_kept_text(F.col("text"), F.col("keep")))
    return rows.select(
        "doc_id", F.size(_lines(F.col("text"))).cast("bigint").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0).cast("bigint")).alias("n_dropped"),
        F.sha2(kept, 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), line AS (
  SELECT doc_id, unnest(range(len(lines))) AS pos, unnest(lines) AS line FROM split
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM line
), common AS (
  SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT doc_id, pos, line, coalesce(doc_id <> top, false) AS gone
  FROM keyed LEFT JOIN common ON keyed.key = common.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
