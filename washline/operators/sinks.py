"""Writes re-aimed as change-set jobs over whole tables.

Every function returns the rows to write (or the table after the change) as a
DataFrame; persisting is ``df.write`` by the caller. Keyed "last writer wins"
logic is a ``max_by`` aggregate per key (partial on each executor), not a
per-key window, so one hot key costs no more than any other.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from washline.functions.formatting import is_blank, ntz_epoch_seconds, strip
from washline.functions.running import checkpointed
from washline.functions.timewin import ts_lit
from washline.sources import schemas

# --- orders in cart form --------------------------------------------------------------
# The cart is kept as rows keyed by order and line, and by line and add-on: no array spans
# an order, so the meaning of a row does not depend on how long an order is.

ADDON_ITEM = ["addon_id", "quantity", "unit_price", "total_price"]
LINE_ITEM = ["batch_id", "service_id", "category_id", "weight", "load_count", "price_per_unit",
             "subtotal"]


def cart_lines(tx: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per line of a known order: the order's customer fields and the line's."""
    head = tx.select("transaction_id", "customer_name", "customer_email")
    return lines.select("transaction_id", *LINE_ITEM).join(head, "transaction_id")


def cart_addons(lines: DataFrame, batch_addons: DataFrame) -> DataFrame:
    """One row per line of ``lines`` and add-on; repeated picks of one add-on add up."""
    per_addon = batch_addons.groupBy("batch_id", "addon_id").agg(
        F.sum("quantity").alias("quantity"), F.max("price").alias("unit_price"),
        F.sum("subtotal").alias("total_price"))
    return per_addon.join(lines.select("batch_id"), "batch_id", "left_semi")


def order_explode_header(cart: DataFrame) -> DataFrame:
    return cart.groupBy("transaction_id", "customer_name", "customer_email").agg(
        F.sum("subtotal").cast("double").alias("total_amount"),
        F.count(F.lit(1)).alias("n_lines"))


def order_explode_lines(cart: DataFrame) -> DataFrame:
    return cart.select(
        "transaction_id", "batch_id", "service_id", "category_id",
        F.col("weight").cast("double").alias("weight"), "load_count",
        F.col("price_per_unit").cast("double").alias("price_per_unit"),
        F.col("subtotal").cast("double").alias("subtotal"))


def order_explode_addons(addons: DataFrame) -> DataFrame:
    return addons.select(
        "batch_id", *ADDON_ITEM[:1],
        *[F.col(c).cast("double").alias(c) for c in ADDON_ITEM[1:]])


# --- inserts ------------------------------------------------------------------------

def append_with_defaults(rows: DataFrame, table: str, types: list[tuple[str, str]], as_of) -> DataFrame:
    """Complete partial rows with the table's column defaults ("now" = as_of).
    A blank e-mail is stored as NULL; names are stored without blanks around them."""
    defaults = schemas.DEFAULTS.get(table, {})
    now = ts_lit(_midnight(as_of))
    cols: list[Column] = []
    for name, typ in types:
        if name in rows.columns:
            c = F.col(name)
            if name.endswith("email"):
                c = F.when(~is_blank(c), strip(c))
            elif name.endswith("name"):
                c = strip(c)
        elif name in defaults:
            d = defaults[name]
            c = now if d == "now" else F.lit(d)
        else:
            c = F.lit(None)
        cols.append(c.cast(typ).alias(name))
    return rows.select(*cols)


def _midnight(as_of):
    d = as_of if isinstance(as_of, dt.date) else dt.date.fromisoformat(str(as_of))
    return dt.datetime(d.year, d.month, d.day)


def insert_ignore(base: DataFrame, incoming: DataFrame, key: str, tiebreak: str) -> DataFrame:
    """Rows of ``incoming`` that an INSERT IGNORE would add: the first row per key
    (lowest ``tiebreak``) whose key is not in ``base`` yet."""
    first = incoming.groupBy(key).agg(F.min_by(F.struct(*incoming.columns), F.col(tiebreak)).alias("_r"))
    return first.join(base.select(key), key, "left_anti").select("_r.*")


def timestamp_display_ids(tx: DataFrame) -> DataFrame:
    """Order ids as the order form makes them: 'ORD-' + unix seconds of creation."""
    return tx.select("transaction_id", "created_at",
                     F.concat(F.lit("ORD-"), ntz_epoch_seconds("created_at").cast("string"))
                     .alias("display_id"))


# --- keyed updates --------------------------------------------------------------------

def apply_updates(base: DataFrame, updates: DataFrame, key: str, order: list[str],
                  overwrite: list[str], keep_if_blank: list[str]) -> DataFrame:
    """Keyed partial update, last writer wins.

    ``overwrite`` columns take the latest update's value, NULL included; ``keep_if_blank``
    columns take the latest non-blank value (a blank leaves the stored value as it is).
    ``updated_at`` is the time of the latest update, the stored one for rows without any.
    Untouched columns are kept.
    """
    ts_order = F.struct(*[F.col(c) for c in order])
    aggs = [F.max_by(F.col(c), ts_order).alias(f"_n_{c}") for c in overwrite]
    aggs += [F.max_by(F.col(c), F.when(~is_blank(c), ts_order)).alias(f"_n_{c}") for c in keep_if_blank]
    aggs += [F.max(order[0]).alias("_updated_at"), F.lit(True).alias("_hit")]
    latest = updates.groupBy(key).agg(*aggs)
    j = base.join(latest, key, "left")
    new = {c: F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)) for c in overwrite}
    new |= {c: F.coalesce(F.col(f"_n_{c}"), F.col(c)) for c in keep_if_blank}
    if "updated_at" in base.columns:
        new["updated_at"] = F.coalesce("_updated_at", "updated_at")
    cols = [new[c].alias(c) if c in new else F.col(c) for c in base.columns]
    return j.select(*cols, *([] if "updated_at" in base.columns else [F.col("_updated_at").alias("updated_at")]))


# --- deletes with referential actions ---------------------------------------------------

def delete_restrict(parent: DataFrame, children: list[tuple[DataFrame, str]], key: str,
                    requests: DataFrame) -> DataFrame:
    """RESTRICT: a delete request is refused when any child row still references it.
    Returns each request key with 'deleted' or 'refused'."""
    req = requests.select(key).distinct().join(parent.select(key), key, "left_semi")
    used = None
    for child, fk in children:
        refs = child.select(F.col(fk).alias(key)).join(req, key, "left_semi").distinct()
        used = refs if used is None else used.unionByName(refs).distinct()
    used = req.limit(0) if used is None else used
    flagged = req.join(used.withColumn("_used", F.lit(True)), key, "left")
    return flagged.select(key, F.when(F.col("_used"), "refused").otherwise("deleted").alias("outcome"))


def _split_counts(df: DataFrame, key: str, gone: DataFrame, name: str) -> DataFrame:
    flagged = df.select(key).join(gone.select(key).distinct().withColumn("_d", F.lit(True)), key, "left")
    return flagged.agg(F.lit(name).alias("table_name"),
                       F.count(F.when(F.col("_d"), 1)).alias("deleted_rows"),
                       F.count(F.when(F.col("_d").isNull(), 1)).alias("remaining_rows"))


def delete_cascade(tx: DataFrame, lines: DataFrame, batch_addons: DataFrame,
                   keys: DataFrame) -> DataFrame:
    """CASCADE down orders -> lines -> add-on lines: deleted and remaining row counts
    per table (the kept rows are the left-anti joins with the deleted keys)."""
    keys = keys.select("transaction_id").distinct()
    gone_lines = lines.select("batch_id", "transaction_id").join(keys, "transaction_id", "left_semi")
    gone_addons = batch_addons.select("batch_addon_id", "batch_id").join(
        gone_lines.select("batch_id"), "batch_id", "left_semi")
    return (_split_counts(tx, "transaction_id", keys, "transactions")
            .unionByName(_split_counts(lines, "batch_id", gone_lines, "transaction_batches"))
            .unionByName(_split_counts(batch_addons, "batch_addon_id", gone_addons, "batch_addons")))


def delete_set_null(child: DataFrame, fk: str, keys: DataFrame, key: str) -> DataFrame:
    """SET NULL: child references to deleted parent keys become NULL."""
    gone = keys.select(F.col(key).alias(fk)).distinct().withColumn("_d", F.lit(True))
    j = child.join(gone, fk, "left")
    return j.select(*[F.when(F.col("_d"), F.lit(None)).otherwise(F.col(c)).alias(c) if c == fk
                      else F.col(c) for c in child.columns])


def last_login(users: DataFrame, logins: DataFrame) -> DataFrame:
    """Each user's latest successful login time (NULL if none)."""
    latest = logins.groupBy("user_id").agg(F.max("ts").alias("last_login"))
    return users.select("user_id", "username").join(latest, "user_id", "left")


# --- INSERT IGNORE under several unique keys ---------------------------------------------

def insert_ignore_keys(base: DataFrame, incoming: DataFrame, keys: list[list[str]], order: str) -> DataFrame:
    """Rows of ``incoming`` that an INSERT IGNORE would add when it takes them in ``order`` (unique).

    A row is refused if one of its ``keys`` is in ``base`` or in a row that was added before it; a
    refused row refuses nobody. NULL in a key conflicts with nothing. Sequential as that sounds, it takes rounds
    and no loop over rows: a row that is the first open one under each of its keys is added, and all
    other rows with a key of an added row are refused; with what is left this repeats. Chains in which each
    row waits for another are short unless they are made on purpose (the rounds are the longest one).

    A key that a third of all rows share is one row of a partial aggregate; rows meet each other by their
    place in the order only, and the joins that refuse rows are ones AQE can split.
    """
    names = [f"_k{i}" for i in range(len(keys))]

    def key(cols: list[str], df: DataFrame) -> Column:
        whole = F.struct(*[df[c] for c in cols])
        for c in cols:
            whole = F.when(df[c].isNotNull(), whole)
        return whole

    open_rows = incoming.select(F.col(order).alias("_order"), *[key(k, incoming).alias(n) for k, n in zip(keys, names)])
    for cols, name in zip(keys, names):
        held = base.select(key(cols, base).alias(name)).where(F.col(name).isNotNull())
        open_rows = open_rows.join(held, name, "left_anti")
    open_rows = checkpointed(open_rows.select("_order", *names))
    added = []
    while not open_rows.isEmpty():
        # the first open row of each key value; a row wins that is the first under all keys it has
        firsts = reduce(DataFrame.unionByName, [
            open_rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.min("_order").alias("_order")).select("_order")
            for name in names])
        wins = firsts.groupBy("_order").agg(F.count(F.lit(1)).alias("_wins"))
        has = reduce(Column.__add__, [F.col(name).isNotNull().cast("int") for name in names])
        won = checkpointed(open_rows.join(wins, "_order", "left").where(F.coalesce("_wins", F.lit(0)) == has)
                           .select("_order", *names))
        added.append(won.select("_order"))
        left = open_rows.join(won.select("_order"), "_order", "left_anti")
        for name in names:
            left = left.join(won.select(name).where(F.col(name).isNotNull()), name, "left_anti")
        open_rows = checkpointed(left.select("_order", *names))
    if not added:
        return incoming.limit(0)
    taken = reduce(DataFrame.unionByName, added)
    return incoming.join(taken, F.col(order) == F.col("_order"), "left_semi")
