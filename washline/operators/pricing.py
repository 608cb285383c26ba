"""Cart pricing, line re-pricing, weight consistency and order-total recompute.

Money stays DECIMAL end to end (``ceil`` of a decimal ratio, decimal products and
sums), so results do not depend on binary float rounding; outputs are cast to
double only at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washline.operators.catalog import kg_per_load
from washline.sources.views import load_count_expr


def _limit(config: DataFrame | None) -> DataFrame | None:
    return None if config is None else F.broadcast(kg_per_load(config))


def _lines_with_addons(lines: DataFrame, batch_addons: DataFrame, addons: DataFrame,
                       kg: F.Column | None, extra: list[str]) -> DataFrame:
    """One row per priced line: loads and add-on money (price x (weight if 'Per Kg'
    else 1) x quantity, summed), from a single lines-to-add-ons join whose hash
    partitioning on the line id also serves the per-line aggregate."""
    a = batch_addons.select("batch_id", "addon_id", "quantity").join(
        addons.select("addon_id", F.col("price").alias("_unit"), "pricing_type"), "addon_id")
    l = lines.select("batch_id", "transaction_id", "service_id", "weight", *extra)
    unit = F.when(F.col("pricing_type") == "Per Kg", F.col("_unit") * F.col("weight")).otherwise(F.col("_unit"))
    per_line = (l.join(a.drop("addon_id"), "batch_id", "left")
                .groupBy("batch_id", "transaction_id", "service_id", "weight", *extra)
                .agg(F.coalesce(F.sum(unit * F.col("quantity")), F.lit(0)).alias("_addon_amt")))
    loads = load_count_expr(F.col("weight"), kg) if kg is not None else load_count_expr(F.col("weight"))
    return per_line.withColumn("loads", loads).where(F.col("loads") > 0)


def price_cart(lines: DataFrame, batch_addons: DataFrame, services: DataFrame, addons: DataFrame,
               config: DataFrame | None = None) -> DataFrame:
    """Price every cart line from the current catalog.

    loads = ceil(weight / kg_per_load) (a line with no load is refused and left
    out); base = loads x price per load; plus the line's add-on money.
    """
    limit = _limit(config)
    l = lines if limit is None else lines.crossJoin(limit)
    kg = None if limit is None else F.col("kg_per_load")
    per_line = _lines_with_addons(l, batch_addons, addons, kg, [] if limit is None else ["kg_per_load"])
    priced = per_line.join(services.select("service_id", "price_per_load"), "service_id")
    base = F.col("loads") * F.col("price_per_load")
    return priced.select(
        "batch_id", "transaction_id", "service_id", "loads",
        base.cast("double").alias("base_amount"),
        F.col("_addon_amt").cast("double").alias("addon_amount"),
        (base + F.col("_addon_amt")).cast("double").alias("subtotal"))


def price_cart_totals(priced_exact: DataFrame) -> DataFrame:
    """Order totals of priced lines (sum of the exact line subtotals)."""
    return priced_exact.groupBy("transaction_id").agg(
        F.sum("_subtotal").cast("double").alias("cart_total"),
        F.count(F.lit(1)).alias("n_lines"))


def price_cart_exact(lines: DataFrame, batch_addons: DataFrame, services: DataFrame,
                     addons: DataFrame) -> DataFrame:
    """Line subtotals kept in DECIMAL for further sums."""
    per_line = _lines_with_addons(lines, batch_addons, addons, None, [])
    priced = per_line.join(services.select("service_id", "price_per_load"), "service_id")
    return priced.select("batch_id", "transaction_id",
                         (F.col("loads") * F.col("price_per_load") + F.col("_addon_amt")).alias("_subtotal"))


def reprice_line(lines: DataFrame, services: DataFrame, config: DataFrame | None = None) -> DataFrame:
    """Edit-form re-price: loads x current price per load. Add-on money is not
    included and the stored unit price is not refreshed (both as in the source)."""
    limit = _limit(config)
    l = lines.select("batch_id", "transaction_id", "service_id", "weight", "price_per_unit", "subtotal")
    if limit is not None:
        l = l.crossJoin(limit)
        kg = F.col("kg_per_load")
    else:
        kg = F.lit(7).cast("decimal(8,2)")
    loads = F.ceil(F.col("weight") / kg).cast("long")
    out = l.join(services.select("service_id", "price_per_load"), "service_id")
    return out.select(
        "batch_id", "transaction_id", loads.alias("load_count"),
        (loads * F.col("price_per_load")).cast("double").alias("subtotal"),
        F.col("price_per_unit").cast("double").alias("price_per_unit"),
        F.col("subtotal").cast("double").alias("old_subtotal"))


def weight_mismatch(lines: DataFrame) -> DataFrame:
    """Lines whose weight differs from their order's first line (lowest line id).
    The per-order first weight is a partial aggregate joined back on the order; the join
    needs no further grouping, so AQE splits the partition of a hot order. Lines without an
    order have none to compare with."""
    first = lines.groupBy("transaction_id").agg(F.min_by("weight", "batch_id").alias("_first"))
    return (lines.join(first, "transaction_id")
            .where(F.col("weight") != F.col("_first"))
            .select("transaction_id", "batch_id", F.col("weight").cast("double").alias("weight"),
                    F.col("_first").cast("double").alias("order_weight")))


def recompute_totals(tx: DataFrame, lines: DataFrame) -> DataFrame:
    """Order total = sum of its line subtotals, 0 for an order without lines."""
    sums = lines.groupBy("transaction_id").agg(F.sum("subtotal").alias("_sum"))
    return tx.select("transaction_id", "total_amount").join(sums, "transaction_id", "left").select(
        "transaction_id",
        F.coalesce(F.col("_sum"), F.lit(0)).cast("double").alias("total_amount"),
        F.col("total_amount").cast("double").alias("stored_total"))


def total_drift(tx: DataFrame, lines: DataFrame) -> DataFrame:
    """Orders whose stored total differs from the sum of their lines."""
    sums = lines.groupBy("transaction_id").agg(F.sum("subtotal").alias("_sum"))
    j = tx.select("transaction_id", "total_amount").join(sums, "transaction_id", "left")
    line_total = F.coalesce(F.col("_sum"), F.lit(0))
    return j.where(F.col("total_amount") != line_total).select(
        "transaction_id",
        F.col("total_amount").cast("double").alias("stored_total"),
        line_total.cast("double").alias("line_total"),
        (F.col("total_amount") - line_total).cast("double").alias("drift"))


def cart_addon_qty(batch_addons: DataFrame) -> DataFrame:
    """Quantity per (line, add-on): repeated picks of one add-on add up."""
    return batch_addons.groupBy("batch_id", "addon_id").agg(
        F.sum("quantity").cast("double").alias("quantity"))


def cart_addon_text(batch_addons: DataFrame, addons: DataFrame) -> DataFrame:
    """Per line: 'Name xQty, Name xQty' in add-on id order.

    Quantities are summed per (line, add-on) first, so each list holds at most one
    entry per catalog add-on."""
    per = (batch_addons.groupBy("batch_id", "addon_id").agg(F.sum("quantity").alias("q"))
           .join(addons.select("addon_id", "addon_name"), "addon_id"))
    count = F.when(F.col("q") % 1 == 0, F.col("q").cast("long").cast("string")).otherwise(
        F.col("q").cast("string"))
    item = F.struct(F.col("addon_id"), F.concat(F.col("addon_name"), F.lit(" x"), count).alias("t"))
    return per.groupBy("batch_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), ", ")
        .alias("addon_text"))


def cart_addon_summary(batch_addons: DataFrame, addons: DataFrame) -> DataFrame:
    """Per line and add-on: 'Name (xQty)', as applied add-ons are listed under a line."""
    per = batch_addons.groupBy("batch_id", "addon_id").agg(F.sum("quantity").alias("q"))
    count = F.when(F.col("q") % 1 == 0, F.col("q").cast("long").cast("string")).otherwise(
        F.col("q").cast("string"))
    return per.join(addons.select("addon_id", "addon_name"), "addon_id").select(
        "batch_id", "addon_id", F.concat("addon_name", F.lit(" (x"), count, F.lit(")")).alias("summary"))
