"""Catalog reads: active items, listings, name index, keyed lookups, configuration,
customer e-mail list, load counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washline.functions.formatting import money_plain
from washline.sources import schemas
from washline.sources.views import WEIGHT, load_count_expr


def active_catalog(services: DataFrame, addons: DataFrame) -> DataFrame:
    """Items offered for new orders: active services and active add-ons."""
    s = services.where(F.col("status") == "Active").select(
        F.lit("service").alias("kind"), F.col("service_id").alias("item_id"),
        F.col("service_name").alias("item_name"), F.col("price_per_load").cast("double").alias("price"),
        F.lit(None).cast("string").alias("pricing_type"))
    a = addons.where(F.col("status") == "Active").select(
        F.lit("addon").alias("kind"), F.col("addon_id").alias("item_id"),
        F.col("addon_name").alias("item_name"), F.col("price").cast("double").alias("price"),
        "pricing_type")
    return s.unionByName(a)


def catalog_listing(services: DataFrame, addons: DataFrame, category: DataFrame) -> DataFrame:
    """The three catalog tables as listed on the catalog screen, each in id order."""
    s = services.select(
        F.lit("service").alias("kind"), F.col("service_id").alias("item_id"),
        F.col("service_name").alias("item_name"), "description",
        money_plain("price_per_load").alias("price_text"),
        F.lit(None).cast("string").alias("pricing_type"), "status")
    a = addons.select(
        F.lit("addon").alias("kind"), F.col("addon_id").alias("item_id"),
        F.col("addon_name").alias("item_name"), "description",
        money_plain("price").alias("price_text"), "pricing_type", "status")
    c = category.select(
        F.lit("category").alias("kind"), F.col("category_id").alias("item_id"),
        F.col("name").alias("item_name"), "description",
        F.lit(None).cast("string").alias("price_text"),
        F.lit(None).cast("string").alias("pricing_type"), F.lit(None).cast("string").alias("status"))
    return s.unionByName(a).unionByName(c).orderBy("kind", "item_id")


def catalog_by_name(services: DataFrame) -> DataFrame:
    """Name -> service index over active services. Names are not unique; as with a
    dict filled in id order, the highest id wins (``max_by``, a partial aggregate)."""
    active = services.where(F.col("status") == "Active")
    return active.groupBy("service_name").agg(
        F.max_by(F.struct("service_id", "price_per_load"), "service_id").alias("_w")
    ).select("service_name", F.col("_w.service_id").alias("service_id"),
             F.col("_w.price_per_load").cast("double").alias("price_per_load"))


def lookup_by_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Bulk form of "SELECT * WHERE id = ?": a left-semi join with a key table.

    Duplicate keys return the row once. The planner broadcasts the key side when
    AQE sees it is small, otherwise shuffles both sides on the key.
    """
    return table.join(keys.select(key), key, "left_semi")


def config_pivot(config: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Key/value rows -> one row with a column per key (missing keys are NULL)."""
    keys = keys or schemas.CONFIG_KEYS
    return config.groupBy().pivot("config_key", keys).agg(F.first("config_value"))


def kg_per_load(config: DataFrame) -> DataFrame:
    """The kg-per-load limit (one row): the configured value, default 7."""
    return config.agg(
        F.coalesce(F.max(F.when(F.col("config_key") == "kg_per_load", F.col("config_value"))),
                   F.lit(schemas.KG_PER_LOAD_DEFAULT)).cast(WEIGHT).alias("kg_per_load"))


def config_load_counts(batches: DataFrame, config: DataFrame) -> DataFrame:
    """Load count of every line under the configured limit. The limit is a one-row
    table, so the cross join is a broadcast of a single row."""
    return (batches.crossJoin(F.broadcast(kg_per_load(config)))
            .select("batch_id", F.col("weight").cast("double").alias("weight"),
                    F.col("kg_per_load").cast("double").alias("kg_per_load"),
                    load_count_expr(F.col("weight"), F.col("kg_per_load")).alias("load_count")))


def load_counts(batches: DataFrame, kg: float = 7) -> DataFrame:
    return batches.select("batch_id", F.col("weight").cast("double").alias("weight"),
                          load_count_expr(F.col("weight"), kg).alias("load_count"))


def customer_emails(tx: DataFrame) -> DataFrame:
    """Distinct known customer e-mails, case-insensitively (one lower-case value per
    address), NULL and empty excluded."""
    return (tx.where(F.col("customer_email").isNotNull() & (F.col("customer_email") != ""))
            .select(F.lower("customer_email").alias("customer_email")).distinct())
