"""Receipts for every order at once.

The source builds one receipt per selected order with a query per line (N+1).
Here each receipt part is a row: a header row per order, a row per line, a row per
add-on and a footer row, each with the keys that put it in place
(transaction_id, section, batch_id, sub, item_id). Nothing is collected per order,
so an order with a huge number of lines is just more rows, never one big value.
Sorting by those keys (or grouping them in a consumer) prints the receipt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washline.functions.formatting import datetime_text, money, money_plain

RULE_WIDE = "=" * 40
RULE_THIN = "-" * 40
DEFAULT_TITLE = "LAUNDRY RECEIPT"


def receipt_lines(lines: DataFrame, services: DataFrame) -> DataFrame:
    """Order lines with their service name (edit list form)."""
    return lines.join(services.select("service_id", "service_name"), "service_id").select(
        "batch_id", "transaction_id", "service_name",
        F.col("weight").cast("double").alias("weight"),
        F.col("subtotal").cast("double").alias("subtotal"),
        money_plain("subtotal").alias("subtotal_text"))


def receipt_typed(lines: DataFrame, services: DataFrame, category: DataFrame) -> DataFrame:
    """Lines with service and category; a line without a known category is dropped
    (inner joins, as in the active receipt)."""
    return (lines.join(services.select("service_id", "service_name"), "service_id")
            .join(category.select("category_id", F.col("name").alias("cat_name")),
                  "category_id")
            .select("batch_id", "transaction_id", "service_name", "cat_name",
                    F.col("weight").cast("double").alias("weight"), "load_count",
                    F.col("subtotal").cast("double").alias("subtotal")))


def receipt_addons(batch_addons: DataFrame, addons: DataFrame) -> DataFrame:
    """Add-on lines with their names: one join for all lines instead of one query each."""
    return batch_addons.join(addons.select("addon_id", "addon_name"), "addon_id").select(
        "batch_id", "batch_addon_id", "addon_name",
        F.col("quantity").cast("double").alias("quantity"),
        F.col("subtotal").cast("double").alias("subtotal"))


def receipt_active(tx: DataFrame, lines: DataFrame, category: DataFrame) -> DataFrame:
    """Active-receipt header per order: TYPE is the category of the order's first
    line (lowest line id) among lines with a known category, else 'N/A'."""
    typed = lines.join(category.select("category_id", F.col("name").alias("cat_name")),
                       "category_id")
    per = typed.groupBy("transaction_id").agg(
        F.min_by("cat_name", "batch_id").alias("_type"), F.count(F.lit(1)).alias("n_lines"))
    j = tx.join(per, "transaction_id", "left")
    return j.select(
        "transaction_id", "display_id", "customer_name",
        F.coalesce(F.col("_type"), F.lit("N/A")).alias("type_name"),
        F.coalesce(F.col("n_lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.concat(F.lit("TOTAL: "), money("total_amount")).alias("total_text"),
        F.concat(F.lit("STATUS: "), F.col("status"), F.lit(" | "), F.col("payment_status"))
        .alias("status_text"))


def receipt_history(tx: DataFrame, lines: DataFrame, services: DataFrame,
                    batch_addons: DataFrame, addons: DataFrame, title: str = DEFAULT_TITLE) -> DataFrame:
    """History-receipt text as rows (section 0 header, 1 body, 2 footer)."""
    nl = F.lit("\n")
    voided = F.col("void_status") == "Voided"
    banner = F.when(voided, F.concat(nl, F.lit("*** VOIDED ON "), F.col("void_at").cast("string"),
                                     F.lit(" ***"), nl, F.lit("Reason: "),
                                     F.coalesce(F.col("void_reason"), F.lit("None")), nl)).otherwise(F.lit(""))
    header_text = F.concat(
        F.lit(RULE_WIDE), nl, F.lit(title.center(40)), nl, F.lit(RULE_WIDE), nl,
        F.lit("Order ID: "), F.col("display_id"), nl,
        F.lit("Date: "), datetime_text("created_at"), nl,
        F.lit("Customer: "), F.col("customer_name"), nl,
        F.lit("Status: "), F.col("status"), F.lit(" | "), F.col("payment_status"), nl,
        banner, F.lit(RULE_THIN))
    footer_text = F.concat(F.lit(RULE_THIN), nl, F.lit("TOTAL AMOUNT:          "), money("total_amount"), nl,
                           F.lit(RULE_WIDE))
    # header and footer rows of every order from one scan of the orders
    ends = tx.select("transaction_id", F.explode(F.array(
        F.struct(F.lit(0).alias("section"), header_text.alias("text")),
        F.struct(F.lit(2).alias("section"), footer_text.alias("text")))).alias("_e"))
    header = ends.select(
        "transaction_id", F.col("_e.section").alias("section"), F.lit(None).cast("string").alias("batch_id"),
        F.lit(0).alias("sub"), F.lit(None).cast("string").alias("item_id"), F.col("_e.text").alias("text"))
    named = lines.join(services.select("service_id", "service_name"), "service_id")
    # the line and, behind its add-ons, a blank one: both from one pass over the lines
    both = named.select("transaction_id", "batch_id", F.explode(F.array(
        F.struct(F.lit(0).alias("sub"), F.concat(
            F.col("service_name"), F.lit(" ("), F.col("weight").cast("string"), F.lit("kg)"), nl,
            F.lit("  Subtotal: "), money("subtotal")).alias("text")),
        F.struct(F.lit(2).alias("sub"), F.lit("").alias("text")))).alias("_e"))
    body = both.select("transaction_id", F.lit(1).alias("section"), "batch_id", F.col("_e.sub").alias("sub"),
                       F.lit(None).cast("string").alias("item_id"), F.col("_e.text").alias("text"))
    # add-on rows need their order id: take it from the line they belong to
    extra = (batch_addons.join(addons.select("addon_id", "addon_name"), "addon_id")
             .join(named.select("batch_id", "transaction_id"), "batch_id")
             .select("transaction_id", F.lit(1).alias("section"), "batch_id", F.lit(1).alias("sub"),
                     F.col("batch_addon_id").alias("item_id"),
                     F.concat(F.lit("  + Add-on: "), F.col("addon_name"), F.lit(" ("), money("subtotal"),
                              F.lit(")")).alias("text")))
    return header.unionByName(body).unionByName(extra)


def receipt_active_text(tx: DataFrame, lines: DataFrame, services: DataFrame, category: DataFrame,
                        batch_addons: DataFrame, addons: DataFrame,
                        title: str = DEFAULT_TITLE) -> DataFrame:
    """Active-receipt text as rows (section 0 header, 1 lines and their add-ons, 2 footer).

    Lines without a known service or category are not shown, as in the header's TYPE."""
    nl = F.lit("\n")
    ends = receipt_active(tx, lines, category).select("transaction_id", F.explode(F.array(
        F.struct(F.lit(0).alias("section"), F.concat(
            F.lit(title), nl, F.lit("ID: "), F.col("display_id"), nl, F.lit("CUSTOMER: "),
            F.coalesce("customer_name", F.lit("None")), nl, F.lit("TYPE: "), F.col("type_name"), nl,
            F.lit(RULE_THIN)).alias("text")),
        F.struct(F.lit(2).alias("section"), F.concat(
            F.lit(RULE_THIN), nl, F.col("total_text"), nl, F.col("status_text")).alias("text")))).alias("_e"))
    none = F.lit(None).cast("string")
    ends = ends.select("transaction_id", F.col("_e.section").alias("section"), none.alias("batch_id"),
                       F.lit(0).alias("sub"), none.alias("item_id"), F.col("_e.text").alias("text"))
    shown = lines.join(category.select("category_id"), "category_id").join(
        services.select("service_id", "service_name"), "service_id")
    body = shown.select(
        "transaction_id", F.lit(1).alias("section"), "batch_id", F.lit(0).alias("sub"), none.alias("item_id"),
        F.concat("service_name", F.lit(" ("), F.col("weight").cast("string"), F.lit("kg - "),
                 F.col("load_count").cast("string"), F.lit(" Load/s) : "), money("subtotal")).alias("text"))
    count = F.when(F.col("quantity") % 1 == 0, F.col("quantity").cast("long").cast("string")).otherwise(
        F.col("quantity").cast("string"))
    extra = (batch_addons.join(addons.select("addon_id", "addon_name"), "addon_id")
             .join(shown.select("batch_id", "transaction_id"), "batch_id")
             .select("transaction_id", F.lit(1).alias("section"), "batch_id", F.lit(1).alias("sub"),
                     F.col("batch_addon_id").alias("item_id"),
                     F.concat(F.lit("  + "), "addon_name", F.lit(" x"), count).alias("text")))
    return ends.unionByName(body).unionByName(extra)
