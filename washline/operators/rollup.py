"""The daily rollup: a small table of cells that answers every report window.

A cell is (created_day, void_day, status, payment_status, void_status) with the number of orders and
the exact sum of their amounts. Report windows start and end at midnight, so a window over cells is
the window over their orders: cards, trend, mix and window totals need the cells only, some thousands of
rows a year however many orders there are (days times the 12 states, and the days on which orders of a
day were voided). Cells merge by addition: late orders, and corrections as the cells of the old rows
taken away and those of the new ones added (``sign=-1``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from washline.functions import timewin
from washline.functions.formatting import day_label
from washline.operators.kpi import share_label

CELL = ["created_day", "void_day", "status", "payment_status", "void_status"]


def daily_cells(tx: DataFrame, sign: int = 1) -> DataFrame:
    """The cells of ``tx``; ``sign=-1`` for rows to take away. NULL days and states are cells too."""
    return tx.select(
        F.date_trunc("day", F.col("created_at")).cast("timestamp_ntz").alias("created_day"),
        F.date_trunc("day", F.col("void_at")).cast("timestamp_ntz").alias("void_day"), "status", "payment_status", "void_status",
        "total_amount").groupBy(*CELL).agg(
        (F.lit(sign) * F.count(F.lit(1))).alias("n_orders"),
        (F.lit(sign) * F.coalesce(F.sum("total_amount"), F.lit(0))).cast("decimal(38,2)").alias("amount"))


def merge_cells(*parts: DataFrame) -> DataFrame:
    """One table of cells from several; cells that come to nothing go."""
    cells = reduce(DataFrame.unionByName, parts).groupBy(*CELL).agg(
        F.sum("n_orders").alias("n_orders"), F.sum("amount").cast("decimal(38,2)").alias("amount"))
    return cells.where((F.col("n_orders") != 0) | (F.col("amount") != 0))


def _n(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n_orders"))), F.lit(0)).cast("bigint")


def _amount(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("amount"))), F.lit(0)).cast("double")


def _active() -> Column:
    return F.col("void_status") == "Active"


def report_kpis(cells: DataFrame, window: str, as_of) -> DataFrame:
    """The six report cards and the average, as ``kpi.report_kpis`` gives them."""
    made = _active() & timewin.in_window("created_day", window, as_of)
    voided = (F.col("void_status") == "Voided") & timewin.in_window("void_day", window, as_of)
    cards = cells.agg(
        _n(made & (F.col("status") == "Claimed")).alias("finished_count"), _amount(made).alias("total_sales"),
        _n(made).alias("active_count"), _n(made & (F.col("status") != "Claimed")).alias("unclaimed_count"),
        _n(made & (F.col("payment_status") == "Unpaid")).alias("unpaid_count"), _n(voided).alias("voided_count"))
    return cards.withColumn("avg_value", F.when(
        F.col("active_count") > 0, F.col("total_sales") / F.col("active_count").cast("double")).otherwise(F.lit(0.0)))


def dashboard_cards(cells: DataFrame, as_of) -> DataFrame:
    return cells.agg(
        _n(_active() & (F.col("status") == "In-queue")).alias("pending_count"),
        _n(_active() & (F.col("status") == "Ready to Claim")).alias("ready_count"),
        _amount(_active() & timewin.in_window("created_day", "Today", as_of)).alias("sales_today"))


def sales_trend(cells: DataFrame, window: str, as_of) -> DataFrame:
    kept = cells.where(_active() & timewin.in_window("created_day", window, as_of))
    return kept.groupBy(F.col("created_day").alias("t_date")).agg(
        F.sum("amount").cast("double").alias("daily_total")).withColumn("day_label", day_label("t_date")).orderBy("t_date")


def payment_mix(cells: DataFrame, window: str, as_of) -> DataFrame:
    """Amount and share per payment status, with the share as the chart writes it (one decimal)."""
    kept = cells.where(_active() & timewin.in_window("created_day", window, as_of))
    grouped = kept.groupBy("payment_status").agg(F.sum("amount").alias("_amt")).where(F.col("_amt") > 0)
    total = F.sum("_amt").over(Window.partitionBy()).cast("double")
    share = F.lit(100.0) * F.col("_amt").cast("double") / total
    return grouped.select("payment_status", F.col("_amt").cast("double").alias("sum_amount"), share.alias("share_pct"),
                          share_label(share).alias("share_label"))


def time_windows(cells: DataFrame, as_of) -> DataFrame:
    aggs = []
    for w in timewin.WINDOWS:
        inside = _active() & timewin.in_window("created_day", w, as_of)
        aggs += [_n(inside).alias(f"n|{w}"), _amount(inside).alias(f"s|{w}")]
    stack = ", ".join(f"'{w}', `n|{w}`, `s|{w}`" for w in timewin.WINDOWS)
    return cells.agg(*aggs).selectExpr(
        f"stack({len(timewin.WINDOWS)}, {stack}) AS (window_name, n_orders, total_amount)")
