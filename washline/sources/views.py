"""The order schema as DataFrames derived from the driver's tables.

Mapping (kept identical in ``plans.oracle.VIEWS_SQL`` for the DuckDB check):

* transactions        <- orders (+ customer for the name)
* transaction_batches <- lineitem (+ part for category and list price)
* batch_addons        <- lineitem rows with a discount
* services            <- part;  addons, users <- supplier;  category <- distinct p_type
* change events       <- events (order id = user_id)

Views that do not need a dimension leave its join out, so a KPI over orders never
joins customer and a leaderboard over lines never joins part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from washline.sources import schemas
from washline.sources.tables import Tables

MONEY = "decimal(10,2)"
WEIGHT = "decimal(8,2)"


_VOID = "o_orderkey % 20 = 0"
_VOID_AT = f"CASE WHEN {_VOID} THEN timestampadd(DAY, 3, o_orderdate) END"
_EMAIL = "concat('user', CAST(o_custkey % 100 AS STRING), '@example.com')"

# Column expressions of the order header view, in schema order. Written as SQL
# expression strings: each column is one call to the JVM, parsed there.
TX_COLUMNS: list[tuple[str, str]] = [
    ("transaction_id", "o_orderkey"),
    ("display_id", "concat('ORD-', CAST(o_orderkey AS STRING))"),
    ("customer_name", "c_name"),
    ("customer_email", f"CASE WHEN o_custkey % 5 = 0 THEN NULL WHEN o_custkey % 7 = 0 THEN '' "
                       f"WHEN o_custkey % 3 = 0 THEN upper({_EMAIL}) ELSE {_EMAIL} END"),
    ("customer_contact", "CAST(NULL AS STRING)"),
    ("overall_note", "CAST(NULL AS STRING)"),
    ("pickup_date", "timestampadd(DAY, CASE WHEN o_orderkey % 50 = 0 THEN -1 ELSE 2 END, o_orderdate)"),
    ("status", "CASE o_orderstatus WHEN 'O' THEN 'In-queue' WHEN 'P' THEN 'Ready to Claim' "
               "WHEN 'F' THEN 'Claimed' END"),
    ("payment_status", "CASE WHEN substring(o_orderpriority, 1, 1) IN ('1', '2', '3') THEN 'Paid' "
                       "ELSE 'Unpaid' END"),
    ("total_amount", f"CAST(o_totalprice AS {MONEY})"),
    ("created_by", "o_custkey % 10"),
    ("void_status", f"CASE WHEN {_VOID} THEN 'Voided' ELSE 'Active' END"),
    ("void_reason", f"CASE WHEN {_VOID} THEN concat('void-', CAST(o_orderkey AS STRING)) END"),
    ("void_at", _VOID_AT),
    ("created_at", "o_orderdate"),
    ("updated_at", f"coalesce({_VOID_AT}, o_orderdate)"),
]


def _exprs(cols: list[tuple[str, str]], skip: set[str] = frozenset()) -> list[str]:
    return [f"{e} AS {n}" for n, e in cols if n not in skip]


def transactions(t: Tables, with_customer: bool = True) -> DataFrame:
    """Order headers; an order whose customer is missing stays, without a name.
    ``with_customer=False`` drops customer_name and its join."""
    o = t.orders
    if with_customer:
        o = o.join(t.customer.select("c_custkey", "c_name"), o.o_custkey == F.col("c_custkey"), "left")
        return o.selectExpr(*_exprs(TX_COLUMNS))
    return o.selectExpr(*_exprs(TX_COLUMNS, {"customer_name"}))


def category(t: Tables) -> DataFrame:
    """Category ids 1..n over the distinct part types, alphabetical.

    The one global window runs over the distinct names, found by a partial aggregate.
    """
    types = t.part.select(F.col("p_type").alias("name")).where(F.col("name").isNotNull()).distinct()
    return types.select(
        F.row_number().over(Window.orderBy("name")).cast("long").alias("category_id"),
        "name",
        F.concat(F.lit("Type "), F.col("name")).alias("description"),
    )


BATCH_ID = ("concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), "
            "CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(to_date(l_shipdate) AS STRING))")
_WEIGHT = f"CAST(l_quantity AS {WEIGHT})"


def batch_id_expr() -> Column:
    return F.expr(BATCH_ID)


def load_count_expr(weight: Column, kg_per_load: Column | float = 7) -> Column:
    """ceil(weight / limit) in exact decimals, 0 when weight <= 0."""
    limit = kg_per_load if isinstance(kg_per_load, Column) else F.lit(kg_per_load).cast(WEIGHT)
    return F.when(weight > 0, F.ceil(weight / limit)).otherwise(F.lit(0)).cast("long")


BATCH_COLUMNS: list[tuple[str, str]] = [
    ("batch_id", BATCH_ID),
    ("transaction_id", "l_orderkey"),
    ("service_id", "l_partkey"),
    ("category_id", "category_id"),
    ("load_count", f"CAST(CASE WHEN {_WEIGHT} > 0 THEN ceil({_WEIGHT} / CAST(7 AS {WEIGHT})) "
                   f"ELSE 0 END AS BIGINT)"),
    ("weight", _WEIGHT),
    ("price_per_unit", f"CAST(p_retailprice AS {MONEY})"),
    ("subtotal", f"CAST(l_extendedprice AS {MONEY})"),
    ("special_notes", "CAST(NULL AS STRING)"),
    ("created_at", "l_shipdate"),
]


def transaction_batches(t: Tables, with_part: bool = True) -> DataFrame:
    """Order lines; a line whose service is missing stays, without category and list price.
    ``with_part=False`` leaves out category_id and price_per_unit (and their join)."""
    li = t.lineitem
    if not with_part:
        return li.selectExpr(*_exprs(BATCH_COLUMNS, {"category_id", "price_per_unit"}))
    p = t.part.select("p_partkey", "p_type", "p_retailprice").join(
        category(t).select("category_id", F.col("name").alias("p_type")), "p_type", "left")
    return li.join(p, li.l_partkey == p.p_partkey, "left").selectExpr(*_exprs(BATCH_COLUMNS))


_ADDON_SUB = f"CAST(CAST(l_extendedprice AS {MONEY}) * CAST(l_discount AS DECIMAL(4,2)) AS {MONEY})"


def batch_addons(t: Tables) -> DataFrame:
    return t.lineitem.where("l_discount > 0").selectExpr(
        f"{BATCH_ID} AS batch_addon_id", f"{BATCH_ID} AS batch_id", "l_suppkey AS addon_id",
        f"CAST(l_linenumber AS {WEIGHT}) AS quantity", f"{_ADDON_SUB} AS price",
        f"{_ADDON_SUB} AS subtotal")


def services(t: Tables) -> DataFrame:
    return t.part.selectExpr(
        "p_partkey AS service_id", "p_name AS service_name", "p_brand AS description",
        f"CAST(p_retailprice AS {MONEY}) AS price_per_load",
        "CASE WHEN p_size > 45 THEN 'Inactive' ELSE 'Active' END AS status")


def addons(t: Tables) -> DataFrame:
    return t.supplier.selectExpr(
        "s_suppkey AS addon_id", "s_name AS addon_name", "CAST(NULL AS STRING) AS description",
        f"CAST(abs(s_acctbal) AS {MONEY}) AS price",
        "CASE WHEN s_nationkey % 2 = 0 THEN 'Fixed' ELSE 'Per Kg' END AS pricing_type",
        "CASE WHEN s_acctbal < 0 THEN 'Inactive' ELSE 'Active' END AS status")


def users(t: Tables) -> DataFrame:
    return t.supplier.selectExpr(
        "s_suppkey AS user_id", "s_name AS username",
        "concat('staff', CAST(s_suppkey AS STRING), '@example.com') AS email", "s_name AS full_name",
        "CASE WHEN s_acctbal < 0 THEN 'Inactive' ELSE 'Active' END AS status",
        "CASE WHEN s_suppkey % 3 = 0 THEN 'Admin' ELSE 'Staff' END AS role")


def system_config(spark: SparkSession, overrides: DataFrame | None = None) -> DataFrame:
    """The key/value configuration table: seed rows, then any stored overrides."""
    schema = T.StructType([T.StructField("config_key", T.StringType(), False),
                           T.StructField("config_value", T.StringType(), True)])
    seed = spark.createDataFrame(schemas.CONFIG_SEED, schema)
    if overrides is None:
        return seed
    return seed.join(overrides.select("config_key"), "config_key", "left_anti").unionByName(
        overrides.select("config_key", "config_value"))


# Event type -> order change. Fixed values of the re-aimed change log.
EVENT_ACTIONS = {"error": "VOID", "signup": "REVERT_VOID", "purchase": "PAY",
                 "view": "Ready to Claim", "click": "Claimed"}


def change_events(t: Tables) -> DataFrame:
    """The order change log: one row per requested change, in (ts, event_id) order."""
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_ACTIONS.items())
    return t.events.where(F.col("event_type").isin(*EVENT_ACTIONS)).selectExpr(
        "event_id", "ts", "user_id AS order_id", f"CASE event_type {cases} END AS action",
        "event_id % 10 AS actor_id", "(event_id % 10) % 3 = 0 AS is_admin",
        "CASE WHEN event_id % 11 = 0 THEN '  ' ELSE concat('r', CAST(event_id AS STRING)) END AS reason")


def edit_requests(t: Tables) -> DataFrame:
    """Requests to change order lines, one for every third event: three in five edit a line, one adds
    one and one deletes one. The line is the order's lowest id with a line number drawn from the event;
    the weight is that of the order's first line, or for every fourth event the line's own."""
    e = t.events.where(F.col("event_id") % 3 == 0).selectExpr(
        "1000000000 + event_id AS event_id", "ts", "user_id AS order_id",
        "CASE WHEN event_id % 5 < 3 THEN 'EDIT_LINE' WHEN event_id % 5 = 3 THEN 'ADD_LINE' ELSE 'DELETE_LINE' END "
        "AS action", "event_id % 10 AS actor_id", "(event_id % 10) % 3 = 0 AS is_admin",
        "1 + (event_id DIV 15) % 7 AS _number", "event_id % 4 = 0 AS _own", "1 + event_id % 250 AS service_id")
    lines = t.lineitem.selectExpr("l_orderkey AS _order", "l_linenumber AS _n", f"{BATCH_ID} AS batch_id",
                                  f"{_WEIGHT} AS weight")
    lines = lines.join(e.select(F.col("order_id").alias("_order")).distinct(), "_order", "left_semi")
    named = lines.groupBy("_order", "_n").agg(F.min("batch_id").alias("batch_id"),
                                              F.min_by("weight", "batch_id").alias("_weight"))
    first = lines.groupBy(F.col("_order").alias("_forder")).agg(F.min_by("weight", "batch_id").alias("_first"))
    hit = (e.join(named, (e["order_id"] == named["_order"]) & (e["_number"] == named["_n"]), "left")
           .join(first, e["order_id"] == first["_forder"], "left"))
    return hit.select(
        "event_id", "ts", "order_id", "action", "actor_id", "is_admin",
        F.when(F.col("action") != "ADD_LINE", F.col("batch_id")).alias("batch_id"), "service_id",
        F.when(F.col("_own"), F.coalesce("_weight", "_first")).otherwise(F.col("_first")).alias("weight"))


def delete_requests(t: Tables, purge_before: str) -> DataFrame:
    """Delete requests in phases: some unused-looking services first, then every order created before
    ``purge_before``, then all inactive services, add-ons and users and every category."""
    def rows(df: DataFrame, phase: int, table: str, key: str) -> DataFrame:
        return df.select((F.lit(phase * 10 ** 12) + F.col(key)).alias("seq"), F.lit(table).alias("table_name"),
                         F.col(key).cast("string").alias("row_key"))

    idle = services(t).where(F.col("status") == "Inactive")
    old = transactions(t, with_customer=False).where(F.col("created_at") < F.lit(purge_before).cast("timestamp_ntz"))
    parts = [rows(idle.where(F.col("service_id") % 2 == 0), 0, "services", "service_id"),
             rows(old, 1, "transactions", "transaction_id"), rows(idle, 2, "services", "service_id"),
             rows(addons(t).where(F.col("status") == "Inactive"), 3, "addons", "addon_id"),
             rows(users(t).where(F.col("status") == "Inactive"), 4, "users", "user_id"),
             rows(category(t), 5, "category", "category_id")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def new_users(t: Tables) -> DataFrame:
    """Users to be inserted, one per customer, many of them with an id, a name or an e-mail that is taken."""
    return t.customer.selectExpr(
        "c_custkey AS n", "c_custkey % 1100 AS user_id",
        "concat('Supplier#', lpad(CAST((c_custkey * 7) % 900 AS STRING), 9, '0')) AS username",
        "CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 AND c_custkey % 2 = 0 THEN 'shared@example.com' "
        "ELSE concat('staff', CAST((c_custkey * 3) % 800 AS STRING), '@example.com') END AS email", "c_name AS full_name")
