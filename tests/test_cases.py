"""Hand-made cases, one per semantic trap of the reference (FIXTURES §3)."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql import types as T

from washline.functions import timewin
from washline.operators import catalog, changes, kpi, leaderboards, pricing, receipts, search, sinks
from washline.sources.views import load_count_expr

AS_OF = dt.date(1998, 10, 15)
TX_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.LongType()), T.StructField("display_id", T.StringType()),
    T.StructField("customer_name", T.StringType()), T.StructField("customer_email", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("payment_status", T.StringType()),
    T.StructField("total_amount", T.DecimalType(10, 2)), T.StructField("void_status", T.StringType()),
    T.StructField("void_reason", T.StringType()), T.StructField("void_at", T.TimestampNTZType()),
    T.StructField("created_at", T.TimestampNTZType()),
])


def tx(spark, rows):
    full = []
    for i, r in enumerate(rows):
        d = {"transaction_id": i + 1, "display_id": f"ORD-{i + 1}", "customer_name": f"C{i}",
             "customer_email": None, "status": "In-queue", "payment_status": "Unpaid",
             "total_amount": Decimal("10.00"), "void_status": "Active", "void_reason": None,
             "void_at": None, "created_at": dt.datetime(1998, 10, 15)}
        d.update(r)
        full.append(tuple(d[f.name] for f in TX_SCHEMA.fields))
    return spark.createDataFrame(full, TX_SCHEMA)


def test_last_7_days_edges(spark):
    ts = [dt.datetime(1998, 10, 6, 23, 59, 59), dt.datetime(1998, 10, 8), dt.datetime(1998, 10, 15),
          dt.datetime(1998, 10, 16)]
    df = tx(spark, [{"created_at": t} for t in ts])
    got = [r.transaction_id for r in df.where(timewin.in_window("created_at", "Last 7 Days", AS_OF))
           .orderBy("transaction_id").collect()]
    assert got == [2, 3, 4]


def test_month_and_year_edges(spark):
    ts = [dt.datetime(1998, 9, 30, 23, 59, 59), dt.datetime(1998, 10, 1), dt.datetime(1998, 11, 1)]
    df = tx(spark, [{"created_at": t} for t in ts])
    month = [r.transaction_id for r in df.where(timewin.in_window("created_at", "This Month", AS_OF)).collect()]
    assert month == [2]
    year = df.where(timewin.in_window("created_at", "This Year", AS_OF)).count()
    assert year == 3


def test_null_status_kpi_vs_search_stats(spark):
    df = tx(spark, [{"status": None}])
    k = kpi.report_kpis(df, "This Month", AS_OF).first()
    s = search.search_stats(df, search.SearchSpec(), AS_OF).first()
    assert k.unclaimed_count == 0 and k.active_count == 1
    assert s.unclaimed_count == 1


def test_empty_window_gives_zeros(spark):
    df = tx(spark, [{"created_at": dt.datetime(1990, 1, 1)}])
    k = kpi.report_kpis(df, "Today", AS_OF).first()
    assert (k.finished_count, k.total_sales, k.active_count, k.voided_count, k.avg_value) == (0, 0.0, 0, 0, 0.0)
    assert kpi.dashboard_cards(df, AS_OF).first().sales_today == 0.0


def test_search_keeps_wildcards_and_ignores_case(spark):
    df = tx(spark, [{"customer_name": "Abba"}, {"customer_name": "xBy"}, {"customer_name": "b%"},
                    {"customer_name": "zzz"}])
    got = search.transaction_search(df, search.SearchSpec(search=" _B% "), AS_OF)
    names = sorted(r.customer_name for r in got.collect())
    # '_b%' : any one character, then b/B, then anything -> Abba (A,b..), xBy (x,B..); 'b%' has no char before b
    assert names == ["Abba", "xBy"]


def _changes(spark, rows, base):
    schema = "event_id long, ts timestamp_ntz, order_id long, action string, actor_id long, " \
             "is_admin boolean, reason string"
    ev = spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), 1, a, 0 if adm else 1,
                                 adm, rs) for i, (a, adm, rs) in enumerate(rows)], schema)
    return changes.annotate(ev, base, partitions=3)


def test_void_fold_first_reason_wins(spark):
    base = tx(spark, [{}])
    rows = [("VOID", True, "r1"), ("VOID", True, "r2"), ("REVERT_VOID", True, None),
            ("VOID", True, "  "), ("VOID", True, "r3")]
    ann = _changes(spark, rows, base)
    acc = [r.accepted for r in ann.orderBy("event_id").collect()]
    assert acc == [True, False, True, False, True]
    v = changes.fold_voids(ann).first()
    assert (v.void_status, v.void_reason) == ("Voided", "r3")
    ann2 = _changes(spark, rows[:2], base)
    assert changes.fold_voids(ann2).first().void_reason == "r1"


def test_payment_toggles(spark):
    base = tx(spark, [{"payment_status": "Unpaid"}])
    for n, expect in [(1, "Paid"), (2, "Unpaid"), (3, "Paid")]:
        ann = _changes(spark, [("PAY", True, None)] * n, base)
        assert changes.fold_payment_toggles(ann).first().payment_status == expect
    staff = _changes(spark, [("PAY", False, None), ("PAY", False, None)], base)
    got = [(r.accepted, r.reject_reason) for r in staff.orderBy("event_id").collect()]
    assert got == [(True, None), (False, "staff_on_paid")]


def test_claimed_is_terminal_and_voided_refuses(spark):
    base = tx(spark, [{"payment_status": "Paid"}])
    ann = _changes(spark, [("Claimed", False, None), ("PAY", True, None), ("Ready to Claim", False, None)], base)
    assert [r.reject_reason for r in ann.orderBy("event_id").collect()] == [None, "order_claimed", "order_claimed"]
    ann = _changes(spark, [("VOID", True, "x"), ("PAY", True, None)], base)
    assert [r.reject_reason for r in ann.orderBy("event_id").collect()] == [None, "order_voided"]


def test_unpaid_move_refused(spark):
    base = tx(spark, [{"payment_status": "Unpaid"}])
    ann = _changes(spark, [("Ready to Claim", True, None), ("Claimed", True, None)], base)
    assert [r.reject_reason for r in ann.orderBy("event_id").collect()] == ["unpaid", "unpaid"]


def test_load_count_decimal(spark):
    df = spark.createDataFrame([(Decimal("0"),), (Decimal("7"),), (Decimal("7.01"),), (Decimal("14"),)],
                               "w decimal(8,2)")
    assert [r.n for r in df.select(load_count_expr(F.col("w")).alias("n")).collect()] == [0, 1, 2, 2]
    one = spark.createDataFrame([(Decimal("2.1"),)], "w decimal(8,2)")
    assert one.select(load_count_expr(F.col("w"), F.lit(Decimal("0.3")).cast("decimal(8,2)"))
                      .alias("n")).first().n == 7


def test_per_kg_addon_price(spark):
    lines = spark.createDataFrame([("b1", 1, 5, Decimal("3.5"))],
                                  "batch_id string, transaction_id long, service_id long, weight decimal(8,2)")
    ba = spark.createDataFrame([("b1", "b1", 9, Decimal("2"), Decimal("0"), Decimal("0"))],
                               "batch_addon_id string, batch_id string, addon_id long, quantity decimal(8,2), "
                               "price decimal(10,2), subtotal decimal(10,2)")
    addons = spark.createDataFrame([(9, "Softener", Decimal("10.00"), "Per Kg", "Active")],
                                   "addon_id long, addon_name string, price decimal(10,2), pricing_type string, "
                                   "status string")
    services = spark.createDataFrame([(5, Decimal("100.00"))], "service_id long, price_per_load decimal(10,2)")
    r = pricing.price_cart(lines, ba, services, addons).first()
    assert r.addon_amount == 70.0 and r.loads == 1 and r.subtotal == 170.0


def test_leaderboard_rank_ties(spark):
    t = tx(spark, [{}])
    b = spark.createDataFrame([("a", 1, 7, Decimal("5")), ("b", 1, 3, Decimal("5"))],
                              "batch_id string, transaction_id long, service_id long, subtotal decimal(10,2)")
    s = spark.createDataFrame([(3, "S"), (7, "S")], "service_id long, service_name string")
    got = [(r.rank, r.service_id) for r in
           leaderboards.service_leaderboard(t, b, s, "All Time", AS_OF).orderBy("rank").collect()]
    assert got == [(1, 3), (2, 7)]


def test_recent_orders_ties_include_voided(spark):
    rows = [{} for _ in range(7)]
    rows[6] = {"void_status": "Voided"}
    got = [r.transaction_id for r in kpi.recent_orders(tx(spark, rows)).collect()]
    assert got == [7, 6, 5, 4, 3]


def test_payment_mix_zero_slice(spark):
    df = tx(spark, [{"payment_status": "Paid"}, {"payment_status": "Unpaid", "total_amount": Decimal("0")}])
    got = kpi.payment_mix(df, "This Month", AS_OF).collect()
    assert [(r.payment_status, r.share_pct) for r in got] == [("Paid", 100.0)]


def test_receipt_without_category(spark):
    t = tx(spark, [{}])
    lines = spark.createDataFrame([("b1", 1, 5, None, 1, Decimal("3"), Decimal("9"))],
                                  "batch_id string, transaction_id long, service_id long, category_id long, "
                                  "load_count long, weight decimal(8,2), subtotal decimal(10,2)")
    svc = spark.createDataFrame([(5, "Wash")], "service_id long, service_name string")
    cat = spark.createDataFrame([(1, "Whites")], "category_id long, name string")
    assert receipts.receipt_typed(lines, svc, cat).count() == 0
    assert receipts.receipt_active(t, lines, cat).first().type_name == "N/A"
    ba = spark.createDataFrame([], "batch_addon_id string, batch_id string, addon_id long, "
                                   "quantity decimal(8,2), subtotal decimal(10,2)")
    ad = spark.createDataFrame([], "addon_id long, addon_name string")
    hist = receipts.receipt_history(t, lines, svc, ba, ad)
    assert [r.text for r in hist.where("section = 1").orderBy("sub").collect()] == [
        "Wash (3.00kg)\n  Subtotal: ₱9.00", ""]


def test_active_receipt_rows(spark):
    t = tx(spark, [{}])
    lines = spark.createDataFrame([("b1", 1, 5, 1, 2, Decimal("3"), Decimal("9")), ("b2", 1, 5, None, 1, Decimal("1"), Decimal("4"))],
                                  "batch_id string, transaction_id long, service_id long, category_id long, "
                                  "load_count long, weight decimal(8,2), subtotal decimal(10,2)")
    svc = spark.createDataFrame([(5, "Wash")], "service_id long, service_name string")
    cat = spark.createDataFrame([(1, "Whites")], "category_id long, name string")
    ba = spark.createDataFrame([("x", "b1", 3, Decimal("2.00"), Decimal("1"))], "batch_addon_id string, batch_id string, "
                               "addon_id long, quantity decimal(8,2), subtotal decimal(10,2)")
    ad = spark.createDataFrame([(3, "Softener")], "addon_id long, addon_name string")
    rows = receipts.receipt_active_text(t, lines, svc, cat, ba, ad).orderBy("section", "batch_id", "sub").collect()
    assert [r.section for r in rows] == [0, 1, 1, 2]
    assert "TYPE: Whites" in rows[0].text
    assert [r.text for r in rows[1:3]] == ["Wash (3.00kg - 2 Load/s) : ₱9.00", "  + Softener x2"]
    assert "STATUS: " in rows[3].text


def test_delete_used_service_refused(spark):
    svc = spark.createDataFrame([(1,), (2,)], "service_id long")
    lines = spark.createDataFrame([(1,)], "service_id long")
    got = dict((r.service_id, r.outcome) for r in
               sinks.delete_restrict(svc, [(lines, "service_id")], "service_id", svc).collect())
    assert got == {1: "refused", 2: "deleted"}


def test_enum_sort_is_declaration_order(spark):
    df = tx(spark, [{"status": "Claimed"}, {"status": "In-queue"}, {"status": "Ready to Claim"}])
    got = [r.status for r in search.active_orders_by_status(df).collect()]
    assert got == ["In-queue", "Ready to Claim", "Claimed"]


def test_config_pivot_and_default(spark):
    from washline.sources.views import system_config
    cfg = system_config(spark)
    row = catalog.config_pivot(cfg).first()
    assert row.kg_per_load == "7" and row.pickup_ready_subject == "Order Ready for Pickup"
    empty = spark.createDataFrame([], "config_key string, config_value string")
    assert float(catalog.kg_per_load(empty).first().kg_per_load) == 7.0


def test_apply_updates_blank_keeps_value(spark):
    base = spark.createDataFrame([(1, "old", Decimal("1.00"))], "id long, d string, p decimal(10,2)")
    upd = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 1), 1, "new", Decimal("2.00")),
         (1, dt.datetime(2024, 1, 2), 2, "  ", Decimal("3.00"))],
        "id long, ts timestamp_ntz, event_id long, d string, p decimal(10,2)")
    r = sinks.apply_updates(base, upd, "id", ["ts", "event_id"], ["p"], ["d"]).first()
    assert (r.d, r.p) == ("new", Decimal("3.00"))


def test_users_listed_in_role_enum_order(spark):
    users = spark.createDataFrame([(3, "c", "C", "Staff", "Active"), (1, "a", "A", "Staff", "Active"),
                                   (2, "b", "B", "Admin", "Inactive")],
                                  "user_id long, username string, full_name string, role string, status string")
    assert [r.user_id for r in search.users_by_role(users).collect()] == [2, 1, 3]
