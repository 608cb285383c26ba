"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator key.

Every query reads the whole input tables under ``sf_dir`` (through the derived
order views); none samples, caps or filters ids to stay cheap. Parameters are the
fixed report inputs of ``context``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from washline.operators import (catalog, changes, deltas, edits, history, kpi, leaderboards, outbox, pricing, quality,
                                receipts, referential, rollup, search, sinks, validity)
from washline.functions import running
from washline.functions.formatting import money, money_plain
from washline.streaming import streams
from washline.functions import timewin
from washline.plans.context import AS_OF, PURGE_BEFORE, WINDOW, Ctx
from washline.session import checkpoint_dir
from washline.operators.textindex import TrigramIndex
from washline.sources import layout, schemas, views
from washline.sources.published import PublishedTable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Fixed parameters of the list queries.
SEARCH_SPEC = search.SearchSpec(search="customer#0000001", time="All Time", status="All",
                                payment="Paid", void="Active Only")
#: Further specs, one registered query pair each: a report window with a status, voided orders only,
#: and no filter at all.
MORE_SPECS = {
    "month_ready": search.SearchSpec(time=WINDOW, status="Ready to Claim"),
    "voided": search.SearchSpec(void="Voided Only"),
    "all": search.SearchSpec(void="All"),
}
ACTIVE_TERM = "Customer#00000012"
ACTIVE_SORT = ("amount", "DESC")


def register(name: str):
    def deco(fn: Callable[[Ctx], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Ctx(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn
    return deco


# --- reports and cards -------------------------------------------------------

@register("report_kpis")
def _report_kpis(c: Ctx) -> DataFrame:
    return kpi.report_kpis(c.tx_lean, WINDOW, AS_OF)


@register("dashboard_cards")
def _dashboard_cards(c: Ctx) -> DataFrame:
    return kpi.dashboard_cards(c.tx_lean, AS_OF)


@register("sales_trend")
def _sales_trend(c: Ctx) -> DataFrame:
    return kpi.sales_trend(c.tx_lean, "All Time", AS_OF)


@register("payment_mix")
def _payment_mix(c: Ctx) -> DataFrame:
    return kpi.payment_mix(c.tx_lean, WINDOW, AS_OF).withColumn("share_label", kpi.share_label())


@register("time_windows")
def _time_windows(c: Ctx) -> DataFrame:
    return kpi.time_windows(c.tx_lean, AS_OF)


@register("user_stats")
def _user_stats(c: Ctx) -> DataFrame:
    return kpi.user_stats(c.users)


@register("catalog_status_counts")
def _catalog_status_counts(c: Ctx) -> DataFrame:
    return kpi.catalog_status_counts(c.services, c.addons)


@register("recent_orders")
def _recent_orders(c: Ctx) -> DataFrame:
    return kpi.recent_orders(c.tx)


# --- leaderboards ------------------------------------------------------------

@register("service_leaderboard")
def _service_leaderboard(c: Ctx) -> DataFrame:
    return leaderboards.service_leaderboard(c.tx_lean, c.batches_lean, c.services, WINDOW, AS_OF)


@register("addon_leaderboard")
def _addon_leaderboard(c: Ctx) -> DataFrame:
    return leaderboards.addon_leaderboard(c.tx_lean, c.batches_lean, c.batch_addons, c.addons,
                                          WINDOW, AS_OF)


@register("top_service_literal")
def _top_service_literal(c: Ctx) -> DataFrame:
    return leaderboards.top_service(c.services, c.batches_lean)


@register("top_service_windowed")
def _top_service_windowed(c: Ctx) -> DataFrame:
    return leaderboards.top_service(c.services, c.batches_lean, c.tx_lean, WINDOW, AS_OF)


@register("top_addon_literal")
def _top_addon_literal(c: Ctx) -> DataFrame:
    return leaderboards.top_addon(c.addons, c.batch_addons)


@register("top_addon_windowed")
def _top_addon_windowed(c: Ctx) -> DataFrame:
    return leaderboards.top_addon(c.addons, c.batch_addons, c.batches_lean, c.tx_lean, WINDOW, AS_OF)


# --- lists -------------------------------------------------------------------

@register("transaction_search")
def _transaction_search(c: Ctx) -> DataFrame:
    return search.transaction_search(c.tx, SEARCH_SPEC, AS_OF)


@register("search_stats")
def _search_stats(c: Ctx) -> DataFrame:
    return search.search_stats(c.tx, SEARCH_SPEC, AS_OF)


for _name, _spec in MORE_SPECS.items():
    register(f"transaction_search_{_name}")(
        lambda c, spec=_spec: search.transaction_search(c.tx, spec, AS_OF))
    register(f"search_stats_{_name}")(
        lambda c, spec=_spec: search.search_stats(c.tx, spec, AS_OF))


@register("active_orders")
def _active_orders(c: Ctx) -> DataFrame:
    return search.active_orders(c.tx, ACTIVE_TERM, *ACTIVE_SORT)


def _order_index(c: Ctx) -> TrigramIndex:
    return TrigramIndex.write(c.tx, "transaction_id", ["customer_name", "display_id"],
                              f"{checkpoint_dir(c.spark)}/trigrams/{uuid.uuid4().hex}")


@register("indexed_transaction_search")
def _indexed_transaction_search(c: Ctx) -> DataFrame:
    return search.indexed_transaction_search(c.tx, _order_index(c), SEARCH_SPEC, AS_OF)


@register("indexed_active_orders")
def _indexed_active_orders(c: Ctx) -> DataFrame:
    index = TrigramIndex.write(c.tx, "transaction_id", ["customer_name"],
                               f"{checkpoint_dir(c.spark)}/trigrams/{uuid.uuid4().hex}")
    return search.active_orders(index.search(c.tx, search.contains_pattern(ACTIVE_TERM)), ACTIVE_TERM, *ACTIVE_SORT)


@register("active_orders_by_status")
def _active_orders_by_status(c: Ctx) -> DataFrame:
    return search.active_orders_by_status(c.tx_lean)


# --- catalog -----------------------------------------------------------------

@register("active_catalog")
def _active_catalog(c: Ctx) -> DataFrame:
    return catalog.active_catalog(c.services, c.addons)


@register("catalog_listing")
def _catalog_listing(c: Ctx) -> DataFrame:
    return catalog.catalog_listing(c.services, c.addons, c.category)


@register("catalog_by_name")
def _catalog_by_name(c: Ctx) -> DataFrame:
    return catalog.catalog_by_name(c.services)


@register("lookup_by_keys")
def _lookup_by_keys(c: Ctx) -> DataFrame:
    """Orders named by the change log (bulk keyed lookup)."""
    keys = c.changes.select(F.col("order_id").alias("transaction_id"))
    return catalog.lookup_by_keys(c.tx, keys, "transaction_id").select(
        "transaction_id", "display_id", "customer_name", "status", "payment_status", "void_status",
        F.col("total_amount").cast("double").alias("total_amount"), "created_at")


@register("lookup_keyed")
def _lookup_keyed(c: Ctx) -> DataFrame:
    """The same lookup on orders laid out by their id."""
    path = f"{checkpoint_dir(c.spark)}/keyed/{uuid.uuid4().hex}"
    layout.write_keyed(c.tx, path, "transaction_id", int(c.spark.conf.get("spark.sql.shuffle.partitions")))
    keys = c.changes.select(F.col("order_id").alias("transaction_id"))
    return layout.lookup_keyed(c.spark, path, keys, "transaction_id").select(
        "transaction_id", "display_id", "customer_name", "status", "payment_status", "void_status",
        F.col("total_amount").cast("double").alias("total_amount"), "created_at")


@register("config_kg_per_load")
def _config_kg_per_load(c: Ctx) -> DataFrame:
    return catalog.config_load_counts(c.batches_lean, c.config)


@register("load_count")
def _load_count(c: Ctx) -> DataFrame:
    return catalog.load_counts(c.batches_lean)


@register("customer_emails")
def _customer_emails(c: Ctx) -> DataFrame:
    return catalog.customer_emails(c.tx_lean)


@register("scan_transactions")
def _scan_transactions(c: Ctx) -> DataFrame:
    """Full typed scan of the order headers (money as double)."""
    return c.tx.withColumn("total_amount", F.col("total_amount").cast("double"))


# --- change folding ----------------------------------------------------------

def _annotated(c: Ctx) -> DataFrame:
    return changes.annotate(c.changes, c.tx_lean)


@register("fold_voids")
def _fold_voids(c: Ctx) -> DataFrame:
    return changes.fold_voids(changes.void_decisions(c.changes, c.tx_lean))


@register("fold_payment_toggles")
def _fold_payment_toggles(c: Ctx) -> DataFrame:
    return changes.fold_payment_toggles(_annotated(c))


@register("fold_status_changes")
def _fold_status_changes(c: Ctx) -> DataFrame:
    return changes.fold_status_changes(_annotated(c))


@register("transition_guard")
def _transition_guard(c: Ctx) -> DataFrame:
    return changes.transition_guard(_annotated(c))


@register("audit_rows")
def _audit_rows(c: Ctx) -> DataFrame:
    return changes.audit_rows(_annotated(c))


@register("state_intervals")
def _state_intervals(c: Ctx) -> DataFrame:
    return history.intervals(_annotated(c), c.tx_lean)


@register("state_at_times")
def _state_at_times(c: Ctx) -> DataFrame:
    """The state of the order of every event half an hour after it."""
    times = c.t.events.select(F.col("event_id").alias("probe_id"), F.col("user_id").alias("order_id"),
                              (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("at"))
    return history.state_at(_annotated(c), c.tx_lean, times)


def _published(c: Ctx, name: str, partition: str) -> PublishedTable:
    return PublishedTable(c.spark, f"{checkpoint_dir(c.spark)}/published/{name}-{uuid.uuid4().hex}", partition)


@register("published_orders")
def _published_orders(c: Ctx) -> DataFrame:
    """Orders published by month, then the months of the changed orders published again with their folded state,
    twice over as after a replay."""
    table = _published(c, "orders", layout.PART_COL)
    orders = layout.with_month(c.tx_lean)
    table.publish("base", orders)
    decided = running.checkpointed(_annotated(c))
    changed = decided.where("accepted").select(F.col("order_id").alias("transaction_id"))
    months = [r[0] for r in orders.join(changed, "transaction_id", "left_semi").select(
        layout.PART_COL).distinct().collect()]  # at most one row per month
    for _ in range(2):
        table.publish("changes", changes.apply_folds(table.read(months), decided).select(*orders.columns))
    return table.read().select("transaction_id", layout.PART_COL, "status", "payment_status", "void_status",
                               "void_reason", "void_at", F.col("total_amount").cast("double").alias("total_amount"))


@register("totals_by_deltas")
def _totals_by_deltas(c: Ctx) -> DataFrame:
    """The published totals table of the stored lines, brought up to date by what the accepted edits change."""
    table = _published(c, "totals", "part")
    table.publish("base", deltas.full_totals(c.tx_lean, c.batches_lean))
    deltas.apply_changes(table, "edits", deltas.line_changes(c.batches_lean, _edited(c).lines))
    return table.read().select("transaction_id", "n_lines", F.col("total_amount").cast("double").alias("total_amount"))


# --- reports from the daily rollup -------------------------------------------------

def _cells(c: Ctx) -> DataFrame:
    """The stored rollup: all orders but the late ones, and the cells of the late ones merged in."""
    late = F.col("transaction_id") % 10 == 3
    path = f"{checkpoint_dir(c.spark)}/rollup/{uuid.uuid4().hex}"
    rollup.merge_cells(rollup.daily_cells(c.tx_lean.where(~late)), rollup.daily_cells(c.tx_lean.where(late))).write.parquet(path)
    return c.spark.read.parquet(path)


@register("rollup_cells")
def _rollup_cells(c: Ctx) -> DataFrame:
    return _cells(c).withColumn("amount", F.col("amount").cast("double"))


@register("rollup_report_kpis")
def _rollup_report_kpis(c: Ctx) -> DataFrame:
    return rollup.report_kpis(_cells(c), WINDOW, AS_OF)


@register("rollup_dashboard_cards")
def _rollup_dashboard_cards(c: Ctx) -> DataFrame:
    return rollup.dashboard_cards(_cells(c), AS_OF)


@register("rollup_sales_trend")
def _rollup_sales_trend(c: Ctx) -> DataFrame:
    return rollup.sales_trend(_cells(c), "All Time", AS_OF)


@register("rollup_payment_mix")
def _rollup_payment_mix(c: Ctx) -> DataFrame:
    return rollup.payment_mix(_cells(c), WINDOW, AS_OF)


@register("rollup_time_windows")
def _rollup_time_windows(c: Ctx) -> DataFrame:
    return rollup.time_windows(_cells(c), AS_OF)


@register("pickup_outbox")
def _pickup_outbox(c: Ctx) -> DataFrame:
    return outbox.pickup_outbox(_annotated(c), c.tx, c.config)


# --- pricing -----------------------------------------------------------------

@register("price_cart")
def _price_cart(c: Ctx) -> DataFrame:
    return pricing.price_cart(c.batches_lean, c.batch_addons, c.services, c.addons, c.config)


@register("price_cart_totals")
def _price_cart_totals(c: Ctx) -> DataFrame:
    exact = pricing.price_cart_exact(c.batches_lean, c.batch_addons, c.services, c.addons)
    return pricing.price_cart_totals(exact)


@register("reprice_line")
def _reprice_line(c: Ctx) -> DataFrame:
    return pricing.reprice_line(c.batches, c.services, c.config)


@register("weight_mismatch")
def _weight_mismatch(c: Ctx) -> DataFrame:
    return pricing.weight_mismatch(c.batches_lean)


@register("recompute_totals")
def _recompute_totals(c: Ctx) -> DataFrame:
    return pricing.recompute_totals(c.tx_lean, c.batches_lean)


@register("dq_total_drift")
def _dq_total_drift(c: Ctx) -> DataFrame:
    return pricing.total_drift(c.tx_lean, c.batches_lean)


@register("cart_addon_qty")
def _cart_addon_qty(c: Ctx) -> DataFrame:
    return pricing.cart_addon_qty(c.batch_addons)


@register("cart_addon_summary")
def _cart_addon_summary(c: Ctx) -> DataFrame:
    return pricing.cart_addon_summary(c.batch_addons, c.addons)


@register("cart_addon_text")
def _cart_addon_text(c: Ctx) -> DataFrame:
    return pricing.cart_addon_text(c.batch_addons, c.addons)


# --- receipts ----------------------------------------------------------------

@register("receipt_lines")
def _receipt_lines(c: Ctx) -> DataFrame:
    return receipts.receipt_lines(c.batches_lean, c.services)


@register("receipt_typed")
def _receipt_typed(c: Ctx) -> DataFrame:
    return receipts.receipt_typed(c.batches, c.services, c.category)


@register("receipt_addons")
def _receipt_addons(c: Ctx) -> DataFrame:
    return receipts.receipt_addons(c.batch_addons, c.addons)


@register("receipt_active")
def _receipt_active(c: Ctx) -> DataFrame:
    return receipts.receipt_active(c.tx, c.batches, c.category)


@register("receipt_active_text")
def _receipt_active_text(c: Ctx) -> DataFrame:
    return receipts.receipt_active_text(c.tx, c.batches, c.services, c.category, c.batch_addons, c.addons)


@register("receipt_history")
def _receipt_history(c: Ctx) -> DataFrame:
    return receipts.receipt_history(c.tx, c.batches_lean, c.services, c.batch_addons, c.addons)


# --- loads, updates, deletes -------------------------------------------------

def _cart(c: Ctx) -> DataFrame:
    return sinks.cart_lines(c.tx, c.batches)


@register("order_explode_header")
def _order_explode_header(c: Ctx) -> DataFrame:
    return sinks.order_explode_header(_cart(c))


@register("order_explode_lines")
def _order_explode_lines(c: Ctx) -> DataFrame:
    return sinks.order_explode_lines(_cart(c))


@register("order_explode_addons")
def _order_explode_addons(c: Ctx) -> DataFrame:
    return sinks.order_explode_addons(sinks.cart_addons(_cart(c), c.batch_addons))


@register("append_with_defaults")
def _append_with_defaults(c: Ctx) -> DataFrame:
    """Every order as a submission: only the order form's columns given."""
    sub = c.tx.select(
        "transaction_id", "display_id", "customer_name", "customer_email", "pickup_date",
        "total_amount", "created_by")
    out = sinks.append_with_defaults(sub, "transactions", schemas.TYPES["transactions"], AS_OF)
    return out.withColumn("total_amount", F.col("total_amount").cast("double"))


def _with_defaults(c: Ctx, df: DataFrame, table: str, *given: str) -> DataFrame:
    """``df`` as submissions that give the form's columns ``given`` only."""
    return _money_as_double(sinks.append_with_defaults(df.select(*given), table, schemas.TYPES[table], AS_OF))


@register("append_services")
def _append_services(c: Ctx) -> DataFrame:
    return _with_defaults(c, c.services, "services", "service_id", "service_name", "description", "price_per_load")


@register("append_addons")
def _append_addons(c: Ctx) -> DataFrame:
    return _with_defaults(c, c.addons, "addons", "addon_id", "addon_name", "description", "price")


@register("append_category")
def _append_category(c: Ctx) -> DataFrame:
    return _with_defaults(c, c.category, "category", "category_id", "name", "description")


@register("append_users")
def _append_users(c: Ctx) -> DataFrame:
    """The role is given, as on the form; a status that is given as NULL stays NULL."""
    users = c.users.withColumn("status", F.when(F.col("user_id") % 2 == 0, F.col("status")))
    return _with_defaults(c, users, "users", "user_id", "username", "email", "full_name", "role", "status")


@register("append_lines")
def _append_lines(c: Ctx) -> DataFrame:
    return _with_defaults(c, c.batches, "transaction_batches", "batch_id", "transaction_id", "service_id", "category_id",
                          "load_count", "weight", "price_per_unit", "subtotal")


@register("append_line_addons")
def _append_line_addons(c: Ctx) -> DataFrame:
    return _with_defaults(c, c.batch_addons, "batch_addons", "batch_addon_id", "batch_id", "addon_id", "price", "subtotal")


@register("users_by_role")
def _users_by_role(c: Ctx) -> DataFrame:
    return search.users_by_role(c.users)


@register("insert_ignore")
def _insert_ignore(c: Ctx) -> DataFrame:
    """Orders keyed by second-resolution display ids: submissions from a week before
    the report month on, against everything stored before the month."""
    ids = sinks.timestamp_display_ids(c.tx_lean)
    lo, _ = timewin.bounds(WINDOW, AS_OF)
    base = ids.where(F.col("created_at") < timewin.ts_lit(lo))
    incoming = ids.where(F.col("created_at") >= timewin.ts_lit(lo) - F.expr("INTERVAL 7 DAYS"))
    return sinks.insert_ignore(base, incoming, "display_id", "transaction_id")


@register("insert_ignore_users")
def _insert_ignore_users(c: Ctx) -> DataFrame:
    """New users under the three unique keys of the user table, in the order of their numbers."""
    return sinks.insert_ignore_keys(c.users, views.new_users(c.t), [["user_id"], ["username"], ["email"]], "n")


def _service_updates(c: Ctx) -> DataFrame:
    e = c.t.events.where(F.col("event_type") == "purchase")
    return e.select(F.col("user_id").alias("service_id"), "ts", "event_id",
                    F.col("value").cast("decimal(10,2)").alias("price_per_load"),
                    F.when(F.col("event_id") % 4 == 0, F.lit(""))
                     .otherwise(F.concat(F.lit("desc-"), F.col("event_id").cast("string")))
                    .alias("description"))


@register("apply_updates")
def _apply_updates(c: Ctx) -> DataFrame:
    out = sinks.apply_updates(c.services, _service_updates(c), "service_id", ["ts", "event_id"],
                              overwrite=["price_per_load"], keep_if_blank=["description"])
    return out.withColumn("price_per_load", F.col("price_per_load").cast("double"))


@register("delete_restrict")
def _delete_restrict(c: Ctx) -> DataFrame:
    """Delete every inactive service; services still used by a line are refused."""
    req = c.services.where(F.col("status") == "Inactive").select("service_id")
    return sinks.delete_restrict(c.services, [(c.batches_lean, "service_id")], "service_id", req)


@register("delete_cascade")
def _delete_cascade(c: Ctx) -> DataFrame:
    """Delete every voided order with its lines and add-on lines."""
    keys = c.tx_lean.where(F.col("void_status") == "Voided").select("transaction_id")
    return sinks.delete_cascade(c.tx_lean, c.batches_lean, c.batch_addons, keys)


@register("delete_set_null")
def _delete_set_null(c: Ctx) -> DataFrame:
    """Delete inactive users; orders they created keep a NULL creator."""
    keys = c.users.where(F.col("status") == "Inactive").select("user_id")
    return sinks.delete_set_null(c.tx_lean.select("transaction_id", "created_by"), "created_by",
                                 keys, "user_id")


# --- deletes over all foreign keys ---------------------------------------------

def _deletion(c: Ctx) -> referential.Deletion:
    """The purge of ``views.delete_requests``, with login records as the audit log."""
    tables = {"users": c.users, "services": c.services, "category": c.category, "addons": c.addons,
              "transactions": c.tx_lean, "transaction_batches": c.batches, "batch_addons": c.batch_addons,
              "audit_logs": _login_records(c)}
    return referential.delete_requests(tables, views.delete_requests(c.t, PURGE_BEFORE),
                                       lean={"transaction_batches": c.batches_lean})


@register("delete_closure_outcomes")
def _delete_closure_outcomes(c: Ctx) -> DataFrame:
    return _deletion(c).outcomes


def _money_as_double(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(n).cast("double").alias(n) if t.startswith("decimal") else F.col(n)
                       for n, t in df.dtypes])


for _table in ("users", "services", "category", "addons", "transactions", "transaction_batches", "batch_addons",
               "audit_logs"):
    register(f"delete_closure_{_table}")(
        lambda c, table=_table: _money_as_double(_deletion(c).survivors(table)))


# --- line edits ------------------------------------------------------------------

def _edited(c: Ctx) -> edits.Edited:
    return edits.apply_edits(c.batches, c.tx_lean, c.services, c.changes, views.edit_requests(c.t), c.config)


@register("edit_requests")
def _edit_requests(c: Ctx) -> DataFrame:
    """Every line edit request with its decision."""
    return _edited(c).requests


@register("edited_lines")
def _edited_lines(c: Ctx) -> DataFrame:
    """All order lines after the accepted edits."""
    return _money_as_double(_edited(c).lines)


@register("edited_totals")
def _edited_totals(c: Ctx) -> DataFrame:
    """All order totals after the accepted edits."""
    return _money_as_double(_edited(c).totals)


def _login_records(c: Ctx) -> DataFrame:
    return changes.login_audit_rows(
        c.t.events.where(F.col("event_type") == "signup").select("user_id", "event_id", "ts"))


@register("login_audit")
def _login_audit(c: Ctx) -> DataFrame:
    return _login_records(c)


@register("last_login")
def _last_login(c: Ctx) -> DataFrame:
    logins = c.t.events.where(F.col("event_type") == "signup").select("user_id", "ts")
    return sinks.last_login(c.users, logins)


# --- data quality ------------------------------------------------------------

def _dq_tables(c: Ctx) -> dict[str, DataFrame]:
    return {"transactions": c.tx, "services": c.services, "addons": c.addons,
            "category": c.category, "users": c.users, "transaction_batches": c.batches,
            "batch_addons": c.batch_addons}


def _dq_lean(c: Ctx) -> dict[str, DataFrame]:
    """For checks on keys: no table is joined with another to get columns that are not checked."""
    return {**_dq_tables(c), "transactions": c.tx_lean, "transaction_batches": c.batches_lean}


def _with_audit(c: Ctx, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The stored audit log is checked, here the login records; checks derive nothing themselves."""
    return {**tables, "audit_logs": _login_records(c)}


@register("dq_nulls")
def _dq_nulls(c: Ctx) -> DataFrame:
    return quality.dq_nulls(_with_audit(c, _dq_tables(c)))


@register("dq_enum")
def _dq_enum(c: Ctx) -> DataFrame:
    return quality.dq_enum(_with_audit(c, _dq_tables(c)))


@register("dq_length")
def _dq_length(c: Ctx) -> DataFrame:
    return quality.dq_length(_with_audit(c, _dq_tables(c)))


@register("dq_unique")
def _dq_unique(c: Ctx) -> DataFrame:
    return quality.dq_unique(_with_audit(c, _dq_lean(c)))


@register("dq_fk_orphans")
def _dq_fk_orphans(c: Ctx) -> DataFrame:
    raw = c.t.lineitem.select(F.expr(views.BATCH_ID).alias("batch_id"), F.col("l_orderkey").alias("transaction_id"),
                              F.col("l_partkey").alias("service_id"))
    tables = {**_dq_lean(c), "transaction_batches": raw}
    # the audit log of all accepted changes, so the fold runs
    audit = changes.audit_rows(changes.annotate(c.changes, c.tx_lean, stored=False))
    parts = quality.dq_fk_orphans({**tables, "audit_logs": audit})
    # the category of a line comes with its service here, so only that key needs the joined lines
    typed = {"transaction_batches": c.batches.select("category_id"), "category": c.category}
    return parts.unionByName(quality.dq_fk_orphans(typed))


@register("dq_name_digits")
def _dq_name_digits(c: Ctx) -> DataFrame:
    return quality.dq_name_digits(_dq_tables(c))


@register("dq_required")
def _dq_required(c: Ctx) -> DataFrame:
    return quality.dq_required(_dq_tables(c))


@register("dq_pickup_date")
def _dq_pickup_date(c: Ctx) -> DataFrame:
    return quality.dq_pickup_date(c.tx_lean)


@register("display_id_collisions")
def _display_id_collisions(c: Ctx) -> DataFrame:
    return quality.display_id_collisions(sinks.timestamp_display_ids(c.tx_lean))


@register("text_rule_profile")
def _text_rule_profile(c: Ctx) -> DataFrame:
    return quality.text_rule_profile(c.t.documents, "text", ["lang", "source"])


@register("format_money")
def _format_money(c: Ctx) -> DataFrame:
    return c.tx_lean.select("transaction_id", money("total_amount").alias("amount_text"),
                            money_plain("total_amount").alias("amount_plain"))


@register("valid_window_join")
def _valid_window_join(c: Ctx) -> DataFrame:
    """Codes issued by 'view' events, attempts made by 'click' events."""
    e = c.t.events
    issues = e.where(F.col("event_type") == "view").select("user_id", "event_id", "ts")
    attempts = e.where(F.col("event_type") == "click").select("user_id", "event_id", "ts")
    return validity.valid_window_join(issues, attempts)


# --- streaming forms ---------------------------------------------------------

@register("stream_daily_sales")
def _stream_daily_sales(c: Ctx) -> DataFrame:
    return streams.daily_sales(c.spark, c.t.root)


@register("stream_order_state")
def _stream_order_state(c: Ctx) -> DataFrame:
    return streams.current_orders(c.spark, c.t.root)


@register("stream_outbox")
def _stream_outbox(c: Ctx) -> DataFrame:
    return streams.outbox(c.spark, c.t.root)
