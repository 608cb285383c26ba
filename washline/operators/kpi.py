"""Business KPIs over order headers: report cards, dashboard cards, daily trend,
payment mix, per-window totals, user and catalog counts.

Each KPI set is one conditional aggregate (``count(when)`` / ``sum(when)``) per time column, so that
a report reads the orders of its window only; the aggregation is partial on each
executor and merges a handful of values, so no key can be hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from washline.functions import timewin
from washline.functions.formatting import day_label, money
from washline.functions.formatting import strip


def _dsum(col) -> F.Column:
    """Exact decimal sum, 0 over no rows, returned as double."""
    return F.coalesce(F.sum(col), F.lit(0)).cast("double")


def report_kpis(tx: DataFrame, window: str, as_of) -> DataFrame:
    """Six report cards plus the average.

    Five cards look at orders created in the window, one at orders voided in it. They are two
    aggregates, each with its own range on its own time column, so that both ranges reach the scan
    (one pass with "created OR voided" would read every order); the results are one row each.
    With "All Time" both windows are TRUE, so every voided row counts.
    """
    active = F.col("void_status") == "Active"
    made = tx.where(active & timewin.in_window("created_at", window, as_of)).agg(
        F.count(F.when(F.col("status") == "Claimed", 1)).alias("finished_count"),
        _dsum("total_amount").alias("total_sales"),
        F.count(F.lit(1)).alias("active_count"),
        F.count(F.when(F.col("status") != "Claimed", 1)).alias("unclaimed_count"),
        F.count(F.when(F.col("payment_status") == "Unpaid", 1)).alias("unpaid_count"))
    voided = tx.where((F.col("void_status") == "Voided") & timewin.in_window("void_at", window, as_of)).agg(
        F.count(F.lit(1)).alias("voided_count"))
    return made.crossJoin(F.broadcast(voided)).withColumn(
        "avg_value",
        F.when(F.col("active_count") > 0, F.col("total_sales") / F.col("active_count").cast("double"))
         .otherwise(F.lit(0.0)),
    )


def dashboard_cards(tx: DataFrame, as_of) -> DataFrame:
    """Pending and ready counts (all time) and today's sales, active orders only."""
    active = F.col("void_status") == "Active"
    today = timewin.in_window("created_at", "Today", as_of)
    return tx.where(active).agg(
        F.count(F.when(F.col("status") == "In-queue", 1)).alias("pending_count"),
        F.count(F.when(F.col("status") == "Ready to Claim", 1)).alias("ready_count"),
        _dsum(F.when(today, F.col("total_amount"))).alias("sales_today"),
    )


def sales_trend(tx: DataFrame, window: str, as_of) -> DataFrame:
    """Daily totals of active orders in the window; days without orders are absent.

    ``t_date`` is the day (as a midnight timestamp); ``day_label`` is the chart
    label, which repeats across years.
    """
    day = F.date_trunc("day", F.col("created_at"))
    return (tx.where((F.col("void_status") == "Active") & timewin.in_window("created_at", window, as_of))
            .groupBy(day.alias("t_date"))
            .agg(_dsum("total_amount").alias("daily_total"))
            .withColumn("day_label", day_label("t_date"))
            .orderBy("t_date"))


def payment_mix(tx: DataFrame, window: str, as_of) -> DataFrame:
    """Amount per payment status, positive slices only, share of the kept total.

    The share uses a global window over the grouped result (at most one row per
    payment status), never over the orders.
    """
    grouped = (tx.where((F.col("void_status") == "Active") & timewin.in_window("created_at", window, as_of))
               .groupBy("payment_status")
               .agg(F.sum("total_amount").alias("_amt"))
               .where(F.col("_amt") > 0))
    total = F.sum("_amt").over(Window.partitionBy())
    return grouped.select(
        "payment_status",
        F.col("_amt").cast("double").alias("sum_amount"),
        (F.lit(100.0) * F.col("_amt").cast("double") / total.cast("double")).alias("share_pct"),
    )


def share_label(share: str | F.Column = "share_pct") -> F.Column:
    """The share as the chart writes it: '62.5%'."""
    return F.format_string("%.1f%%", F.col(share) if isinstance(share, str) else share)


def time_windows(tx: DataFrame, as_of) -> DataFrame:
    """Order count and gross amount of active orders in each report window, one pass."""
    active = F.col("void_status") == "Active"
    aggs = []
    for w in timewin.WINDOWS:
        cond = active & timewin.in_window("created_at", w, as_of)
        aggs += [F.count(F.when(cond, 1)).alias(f"n|{w}"),
                 _dsum(F.when(cond, F.col("total_amount"))).alias(f"s|{w}")]
    wide = tx.agg(*aggs)
    stack = ", ".join(f"'{w}', `n|{w}`, `s|{w}`" for w in timewin.WINDOWS)
    return wide.selectExpr(f"stack({len(timewin.WINDOWS)}, {stack}) AS (window_name, n_orders, total_amount)")


def user_stats(users: DataFrame) -> DataFrame:
    role = F.lower(strip("role"))
    return users.agg(
        F.count(F.lit(1)).alias("total_users"),
        F.count(F.when(F.col("status") == "Active", 1)).alias("active_users"),
        F.count(F.when(role == "admin", 1)).alias("admin_count"),
        F.count(F.when(role == "staff", 1)).alias("staff_count"),
    )


def catalog_status_counts(services: DataFrame, addons: DataFrame) -> DataFrame:
    """Active / inactive items across services and add-ons (counted per table, then summed)."""
    per_table = (services.groupBy("status").count()
                 .unionByName(addons.groupBy("status").count()))
    return per_table.agg(
        F.coalesce(F.sum(F.when(F.col("status") == "Active", F.col("count"))), F.lit(0)).cast("long")
        .alias("active_count"),
        F.coalesce(F.sum(F.when(F.col("status") == "Inactive", F.col("count"))), F.lit(0)).cast("long")
        .alias("inactive_count"),
    )


def recent_orders(tx: DataFrame, n: int = 5) -> DataFrame:
    """The n most recent orders, voided ones included; ties broken by highest id.

    ``orderBy().limit()`` plans as TakeOrderedAndProject: each task keeps its own
    top n, so only n rows per task reach the final merge.
    """
    return (tx.orderBy(F.col("created_at").desc(), F.col("transaction_id").desc())
            .limit(n)
            .select("transaction_id", "display_id", "customer_name", "status", "payment_status",
                    money("total_amount").alias("amount_text"),
                    F.coalesce(F.date_format("created_at", "yyyy-MM-dd HH:mm"), F.lit("N/A"))
                    .alias("date_text")))
