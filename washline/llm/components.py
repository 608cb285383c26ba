"""Connected components of a table of links, as DataFrame rounds.

Each round every node takes its smallest neighbour below itself as parent; parents are followed to
their roots by pointer jumping; links are then moved to the roots and those within one component
go. Nodes and links stay distributed; only counts reach the driver. Rounds are written to the
shared scratch folder, so a lost executor never costs more than a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washline.llm.common import drop_scratch, scratch_table


def _roots(parents: DataFrame, path: str) -> tuple[DataFrame, str]:
    """Follow (node, root) to the top; a node that is no key of the table is a root."""
    spark = parents.sparkSession
    while True:
        up = parents.select(F.col("node").alias("_n"), F.col("root").alias("_up"))
        jumped, new = scratch_table(
            parents.join(up, parents["root"] == up["_n"], "left").select(
                "node", F.coalesce("_up", "root").alias("root"),
                F.col("_up").isNotNull().alias("_moved")), "jump")
        drop_scratch(spark, path)
        path, moved = new, jumped.where("_moved").limit(1).count()
        parents = jumped.drop("_moved")
        if not moved:
            return parents, path


def components(links: DataFrame) -> tuple[DataFrame, list[str]]:
    """(node, root) for every node of ``links`` (a, b) that is not the smallest of its component.

    The root is the smallest node. Also returns the scratch folders the result reads. Loops and
    repeated links are allowed; an empty table gives an empty result.
    """
    spark = links.sparkSession
    links, path = scratch_table(
        links.where(F.col("a") != F.col("b")).select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    result = links.select(F.col("b").alias("node"), F.col("a").alias("root")).limit(0)
    kept: list[str] = []
    while links.limit(1).count():
        parents, top = scratch_table(
            links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "parents")
        roots, top = _roots(parents, top)
        up = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        moved = (links.join(up, links["a"] == up["_n"], "left")
                 .select(F.coalesce("_r", "a").alias("a"), "b"))
        moved = (moved.join(up, moved["b"] == up["_n"], "left")
                 .select("a", F.coalesce("_r", "b").alias("b"))
                 .where(F.col("a") != F.col("b"))
                 .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        links, new = scratch_table(moved, "links")
        old = result.select("node", F.col("root").alias("_r0"))
        result, res = scratch_table(
            old.join(up, old["_r0"] == up["_n"], "left")
            .select("node", F.coalesce("_r", "_r0").alias("root")).unionByName(roots), "roots")
        drop_scratch(spark, path, top, *kept)
        path, kept = new, [res]
    return result, [path, *kept]
