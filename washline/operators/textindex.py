"""Substring search by trigram postings.

The index of a table has one row per (field, gram, id): every three neighbouring characters of the lower-cased
text. It is written sorted by (field, gram, id) over range partitions, so that the rows of one gram lie
together, Parquet's statistics skip the rest, and a gram that every row holds is spread over as many files as
it fills. Beside it lies the number of rows of each gram, a table as small as the alphabet is.

A pattern (``%`` any characters, ``_`` one, a backslash before either takes it as it is; case does not matter) gives
the grams of its literal stretches. The rarest few of them are intersected, and what is left is verified by the pattern
itself on the table's rows, so the result is that of the scan. A pattern without a stretch of three
letters, or one whose rarest gram most rows hold, is answered by the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 3
#: Postings that are intersected, of those a pattern names; and the share of all rows from which the scan is cheaper.
RAREST = 3
MOST = 0.5


def literal_grams(pattern: str) -> set[str]:
    """The grams that every text matching the pattern must hold, in lower case."""
    stretches, now, escaped = [], "", False
    for ch in pattern.lower():
        if escaped and ch.isascii():
            now, escaped = now + ch, False
        elif ch == "\\":
            escaped = True
        elif ch in "%_" or not ch.isascii():  # other letters may be folded otherwise where the text is
            stretches.append(now)
            now = ""
        else:
            now += ch
    stretches.append(now)
    return {s[i:i + GRAM] for s in stretches for i in range(len(s) - GRAM + 1)}


def postings(table: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, gram, id) of ``table``: each gram once per row and field; texts under three characters have none."""
    parts = []
    for f in fields:
        text = F.lower(F.col(f))
        grams = F.when(F.char_length(text) >= GRAM, F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.char_length(text) - GRAM + 1), lambda i: F.substring(text, i, F.lit(GRAM)))))
        parts.append(table.select(F.lit(f).alias("field"), F.explode(grams).alias("gram"), F.col(key).alias("id")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@dataclass
class TrigramIndex:
    """A written index of ``key`` and ``fields`` of a table with ``n_rows`` rows."""

    spark: SparkSession
    path: str
    key: str
    fields: list[str]
    n_rows: int

    @staticmethod
    def write(table: DataFrame, key: str, fields: list[str], path: str, partitions: int | None = None) -> TrigramIndex:
        spark = table.sparkSession
        n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        (postings(table, key, fields).repartitionByRange(n, "field", "gram", "id")
         .sortWithinPartitions("field", "gram", "id").write.parquet(f"{path}/postings"))
        (spark.read.parquet(f"{path}/postings").groupBy("field", "gram").agg(F.count(F.lit(1)).alias("n"))
         .write.parquet(f"{path}/grams"))
        return TrigramIndex(spark, path, key, fields, table.count())

    def _rarest(self, field: str, grams: set[str]) -> list[tuple[str, int]]:
        """The grams with the fewest rows; one that no row holds comes first, with 0."""
        found = self.spark.read.parquet(f"{self.path}/grams").where(
            (F.col("field") == field) & F.col("gram").isin(*grams)).select("gram", "n").collect()  # a pattern's grams
        n = dict.fromkeys(grams, 0) | {r["gram"]: r["n"] for r in found}
        return sorted(n.items(), key=lambda g: (g[1], g[0]))[:RAREST]

    def candidates(self, pattern: str) -> DataFrame | None:
        """The ids whose rows may match the pattern in one of the fields, or None if the index cannot say."""
        grams = literal_grams(pattern)
        if not grams:
            return None
        parts = []
        for field in self.fields:
            rare = self._rarest(field, grams)
            if rare[0][1] == 0:
                continue
            use = [g for g, n in rare if n <= MOST * self.n_rows]
            if not use:
                return None
            held = self.spark.read.parquet(f"{self.path}/postings").where(
                (F.col("field") == field) & F.col("gram").isin(*use))
            # a gram is there once per row, so rows with all of them have as many postings
            parts.append(held.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(use)).select("id"))
        if not parts:
            return self.spark.read.parquet(f"{self.path}/postings").select("id").limit(0)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.distinct() if len(parts) > 1 else out

    def matches(self, pattern: str) -> Column:
        """The pattern on any of the fields, as the scan has it."""
        out = F.lit(False)
        for f in self.fields:
            out = out | F.coalesce(F.col(f).ilike(pattern), F.lit(False))
        return out

    def search(self, table: DataFrame, pattern: str) -> DataFrame:
        """The rows of ``table`` that match; NULL fields match nothing."""
        ids = self.candidates(pattern)
        if ids is not None:
            ids = ids.withColumnRenamed("id", "_hit")
            table = table.join(ids, F.col(self.key) == F.col("_hit"), "left_semi")
        return table.where(self.matches(pattern))
