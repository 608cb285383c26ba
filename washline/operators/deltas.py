"""Order totals kept by signed changes of their lines.

The totals table (transaction_id, n_lines, total_amount) is published in parts of ``SPAN`` consecutive
order ids, so the parts a change touches follow from its key. A batch of line changes (transaction_id, sign
+1 or -1, subtotal) is summed per order before anything is read; then only the touched parts are opened,
joined and replaced (``sources.published``). An edit is its old subtotal taken away and its new one added. Amounts are
decimals, so that totals after any number of batches equal a full recompute.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from washline.sources.published import PublishedTable

SPAN = 4096
AMOUNT = "decimal(28,2)"
COLUMNS = ["part", "transaction_id", "n_lines", "total_amount"]


def part_of(order: str = "transaction_id", span: int = SPAN) -> Column:
    """The part of an order id; orders without an id share one."""
    return F.floor(F.col(order) / span).cast("bigint")


def full_totals(orders: DataFrame, lines: DataFrame, span: int = SPAN) -> DataFrame:
    """The totals table from scratch: every order, 0 without lines."""
    sums = lines.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("subtotal").alias("_sum"))
    return orders.select("transaction_id").join(sums, "transaction_id", "left").select(
        part_of(span=span).alias("part"), "transaction_id", F.coalesce("n_lines", F.lit(0).cast("bigint")).alias("n_lines"),
        F.coalesce("_sum", F.lit(0)).cast(AMOUNT).alias("total_amount"))


def line_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """The signed changes that turn one set of lines into another: lines that are equal in both drop out."""
    rows = (before.select("batch_id", "transaction_id", "subtotal", F.lit(-1).alias("sign"))
            .unionByName(after.select("batch_id", "transaction_id", "subtotal", F.lit(1).alias("sign"))))
    net = rows.groupBy("batch_id", "transaction_id", "subtotal").agg(F.sum("sign").alias("sign"))
    return net.where(F.col("sign") != 0).select("transaction_id", "sign", "subtotal")


def apply_changes(table: PublishedTable, batch: str, changes: DataFrame, span: int = SPAN) -> bool:
    """Publish ``changes`` (transaction_id, sign, subtotal) as one batch. False if it was published before.

    Orders that are not in the table yet begin at 0; changes without an order count for none."""
    if batch in table.manifest()["batches"]:
        return False
    deltas = changes.where(F.col("transaction_id").isNotNull()).groupBy("transaction_id").agg(
        F.sum(F.col("sign")).cast("bigint").alias("_lines"),
        F.sum(F.col("sign") * F.col("subtotal")).cast(AMOUNT).alias("_amount"))
    # one row per touched part comes to the driver: they name the folders to open
    touched = [r[0] for r in deltas.select(part_of(span=span)).distinct().collect()]
    old = table.read(touched).select("transaction_id", "n_lines", "total_amount")
    new = old.join(deltas, "transaction_id", "full").select(
        part_of(span=span).alias("part"), "transaction_id",
        (F.coalesce("n_lines", F.lit(0)) + F.coalesce("_lines", F.lit(0))).cast("bigint").alias("n_lines"),
        (F.coalesce("total_amount", F.lit(0)) + F.coalesce("_amount", F.lit(0))).cast(AMOUNT).alias("total_amount"))
    return table.publish(batch, new)
