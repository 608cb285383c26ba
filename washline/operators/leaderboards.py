"""Service and add-on leaderboards and the top-1 "most used" cards.

Plan shape: filter order headers first (window + active), aggregate lines per item
*after* a semi-join to the kept orders, then join the item catalog to the
aggregated rows (one row per item) and rank with a distributed global row number
(range partitions + per-partition offsets), never a single-task window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washline.functions import timewin
from washline.functions.ranking import global_row_number


def _kept_orders(tx: DataFrame, window: str, as_of) -> DataFrame:
    return (tx.where((F.col("void_status") == "Active") & timewin.in_window("created_at", window, as_of))
            .select("transaction_id"))


def _rank(df: DataFrame, id_col: str) -> DataFrame:
    """Distinct ranks 1..n: income desc, usage desc, lowest id first (distributed)."""
    order = [F.col("total_income").desc(), F.col("usage_count").desc(), F.col(id_col).asc()]
    return global_row_number(df, order, "rank")


def service_leaderboard(tx: DataFrame, batches: DataFrame, services: DataFrame,
                        window: str, as_of) -> DataFrame:
    """Usage count and income per service over active orders in the window, ranked
    by income, then usage, then lowest id. Grouped by id: names repeat."""
    lines = batches.join(_kept_orders(tx, window, as_of), "transaction_id", "left_semi")
    per_item = lines.groupBy("service_id").agg(
        F.count("batch_id").alias("usage_count"),
        F.sum("subtotal").alias("_income"))
    board = (per_item.join(services.select("service_id", "service_name"), "service_id")
             .select("service_id", "service_name", "usage_count",
                     F.col("_income").cast("double").alias("total_income")))
    return _rank(board, "service_id")


def addon_leaderboard(tx: DataFrame, batches: DataFrame, batch_addons: DataFrame, addons: DataFrame,
                      window: str, as_of) -> DataFrame:
    """Same for add-ons: add-on lines of the lines of kept orders."""
    kept_lines = (batches.select("batch_id", "transaction_id")
                  .join(_kept_orders(tx, window, as_of), "transaction_id", "left_semi")
                  .select("batch_id"))
    lines = batch_addons.join(kept_lines, "batch_id", "left_semi")
    per_item = lines.groupBy("addon_id").agg(
        F.count("batch_addon_id").alias("usage_count"),
        F.sum("subtotal").alias("_income"))
    board = (per_item.join(addons.select("addon_id", "addon_name"), "addon_id")
             .select("addon_id", "addon_name", "usage_count",
                     F.col("_income").cast("double").alias("total_income")))
    return _rank(board, "addon_id")


def _top1(counts: DataFrame, id_col: str, name_col: str) -> DataFrame:
    top = counts.orderBy(F.col("usage_count").desc(), F.col(id_col).asc()).limit(1)
    return top.select(
        id_col, name_col, "usage_count",
        F.when(F.col("usage_count") > 0,
               F.format_string("%s (%d)", F.col(name_col), F.col("usage_count")))
         .otherwise(F.lit("None")).alias("label"))


def top_service(services: DataFrame, batches: DataFrame, tx: DataFrame | None = None,
                window: str | None = None, as_of=None) -> DataFrame:
    """Most used service.

    Literal form (``tx`` None): every line counts. The source's date test sits in
    the ON clause of the last LEFT JOIN, where it cannot remove a line, so the
    literal result is the same with or without it. Windowed form: only lines of
    active orders created in the window count (the evident intent).
    Unused services count 0 (the count is of line ids over an outer join).
    """
    lines = batches.select("batch_id", "service_id", "transaction_id")
    if tx is not None:
        lines = lines.join(_kept_orders(tx, window, as_of), "transaction_id", "left_semi")
    per_item = lines.groupBy("service_id").agg(F.count("batch_id").alias("usage_count"))
    counts = (services.select("service_id", "service_name")
              .join(per_item, "service_id", "left")
              .withColumn("usage_count", F.coalesce("usage_count", F.lit(0)).cast("long")))
    return _top1(counts, "service_id", "service_name")


def top_addon(addons: DataFrame, batch_addons: DataFrame, batches: DataFrame | None = None,
              tx: DataFrame | None = None, window: str | None = None, as_of=None) -> DataFrame:
    lines = batch_addons.select("batch_addon_id", "addon_id", "batch_id")
    if tx is not None:
        kept = (batches.select("batch_id", "transaction_id")
                .join(_kept_orders(tx, window, as_of), "transaction_id", "left_semi"))
        lines = lines.join(kept.select("batch_id"), "batch_id", "left_semi")
    per_item = lines.groupBy("addon_id").agg(F.count("batch_addon_id").alias("usage_count"))
    counts = (addons.select("addon_id", "addon_name")
              .join(per_item, "addon_id", "left")
              .withColumn("usage_count", F.coalesce("usage_count", F.lit(0)).cast("long")))
    return _top1(counts, "addon_id", "addon_name")
