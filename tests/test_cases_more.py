"""More hand-made cases: validity windows, outbox templates, cart rows, loads."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from washline.operators import outbox, pricing, quality, sinks, validity

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def _ev(spark, rows):
    return spark.createDataFrame([(u, i, T0 + dt.timedelta(minutes=m)) for u, i, m in rows],
                                 "user_id long, event_id long, ts timestamp_ntz")


def test_validity_window_once_and_expiry(spark):
    issues = _ev(spark, [(1, 1, 0), (1, 5, 30), (2, 9, 0)])
    attempts = _ev(spark, [(1, 2, 3), (1, 3, 4), (1, 4, 11), (1, 6, 35), (2, 10, 10), (3, 11, 1)])
    got = {r.attempt_id: (r.token_id, r.valid) for r in validity.valid_window_join(issues, attempts).collect()}
    assert got == {
        2: (1, True),     # inside the window of code 1
        3: (1, False),    # code 1 already used
        4: (1, False),    # 11 minutes after issue: expired
        6: (5, True),     # new code 5
        10: (9, False),   # exactly 10 minutes: expired (expiry > now is strict)
        11: (None, False),  # no code issued
    }


def test_outbox_templates_replace_in_order(spark):
    tmpl = spark.createDataFrame([("Hi {customer}, order {order_id}", "{order_id}!", "ORD-7")],
                                 "t string, name string, did string")
    r = tmpl.select(outbox.fill_template(F.col("t"), [("{customer}", F.col("name")),
                                                      ("{order_id}", F.col("did"))]).alias("o")).first()
    # the customer value itself contained a tag, and the later replacement fills it too
    assert r.o == "Hi ORD-7!, order ORD-7"


def test_cart_rows_round_trip(spark):
    tx = spark.createDataFrame([(1, "A", None), (2, "B", "b@x")],
                               "transaction_id long, customer_name string, customer_email string")
    lines = spark.createDataFrame(
        [(f"l{i}", 1 if i < 5 else 2, 10 + i, 1, Decimal("3.00"), 1, Decimal("9.00"), Decimal(f"{i}.50"))
         for i in range(7)],
        "batch_id string, transaction_id long, service_id long, category_id long, weight decimal(8,2), "
        "load_count long, price_per_unit decimal(10,2), subtotal decimal(10,2)")
    ba = spark.createDataFrame([("a1", "l0", 3, Decimal("1"), Decimal("2.00"), Decimal("2.00")),
                                ("a2", "l0", 3, Decimal("2"), Decimal("2.00"), Decimal("4.00"))],
                               "batch_addon_id string, batch_id string, addon_id long, quantity decimal(8,2), "
                               "price decimal(10,2), subtotal decimal(10,2)")
    cart = sinks.cart_lines(tx, lines)
    head = {r.transaction_id: (r.n_lines, r.total_amount) for r in sinks.order_explode_header(cart).collect()}
    assert head == {1: (5, 12.5), 2: (2, 12.0)}
    assert sinks.order_explode_lines(cart).count() == 7
    add = sinks.order_explode_addons(sinks.cart_addons(cart, ba)).collect()
    assert [(a.addon_id, a.quantity, a.total_price) for a in add] == [(3, 3.0, 6.0)]


def test_insert_ignore_first_wins(spark):
    base = spark.createDataFrame([("K1", 1)], "k string, id long")
    inc = spark.createDataFrame([("K1", 5), ("K2", 9), ("K2", 7)], "k string, id long")
    got = sorted((r.k, r.id) for r in sinks.insert_ignore(base, inc, "k", "id").collect())
    assert got == [("K2", 7)]


def test_delete_cascade_counts(spark):
    tx = spark.createDataFrame([(1,), (2,)], "transaction_id long")
    lines = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "batch_id string, transaction_id long")
    ba = spark.createDataFrame([("x", "a"), ("y", "c")], "batch_addon_id string, batch_id string")
    keys = spark.createDataFrame([(1,)], "transaction_id long")
    got = {r.table_name: (r.deleted_rows, r.remaining_rows)
           for r in sinks.delete_cascade(tx, lines, ba, keys).collect()}
    assert got == {"transactions": (1, 1), "transaction_batches": (2, 1), "batch_addons": (1, 1)}


def test_text_rule_profile(spark):
    df = spark.createDataFrame([("g", "Abcdef1!"), ("g", "short"), ("g", "NOLOWER1!"), ("g", None)],
                               "grp string, text string")
    r = quality.text_rule_profile(df, "text", ["grp"]).first()
    assert (r.n_rows, r.fail_length, r.fail_upper, r.fail_lower, r.fail_digit, r.fail_special, r.fail_any) == \
        (4, 2, 2, 2, 2, 2, 3)


def test_validity_paths_agree(spark):
    from washline.sources.tables import Tables
    e = Tables(spark, "/root/testdata/sf0.001").events
    iss = e.where(F.col("event_type") == "view").select("user_id", "event_id", "ts")
    att = e.where(F.col("event_type") == "click").select("user_id", "event_id", "ts")
    rows = lambda df: {tuple(r) for r in df.collect()}
    plain = rows(validity.valid_window_join(iss, att, partitions=1))
    assert plain == rows(validity.valid_window_join(iss, att, partitions=6))
    assert plain == rows(validity.valid_window_join(iss, att, partitions=50))


def test_validity_keeps_every_attempt_of_a_null_user(spark):
    t = dt.datetime(2024, 1, 1)
    mins = lambda n: t + dt.timedelta(minutes=n)
    sch = "user_id long, event_id long, ts timestamp_ntz"
    iss = spark.createDataFrame([(None, 1, mins(0)), (7, 2, mins(0))], sch)
    att = spark.createDataFrame([(None, 10 + i, mins(3 * i)) for i in range(5)] + [(7, 30, mins(1))], sch)
    for partitions in (1, 4, 9):
        got = {r.attempt_id: r.valid for r in validity.valid_window_join(iss, att, partitions=partitions).collect()}
        assert got == {10: True, 11: False, 12: False, 13: False, 14: False, 30: True}


def test_weight_mismatch_with_null_orders(spark):
    lines = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (None, "c", 5.0), (None, "d", 6.0)],
                                  "transaction_id long, batch_id string, weight double")
    assert [r.batch_id for r in pricing.weight_mismatch(lines).collect()] == ["b"]


def test_orphans_and_bad_values_are_counted_at_their_own_table(spark, tmp_path):
    """Lines of missing services, orders of missing customers: reported, not lost by a join."""
    import shutil

    import __spark_entry__ as E

    src = "/root/testdata/sf0.001"
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        shutil.copy(f"{src}/{t}.parquet", tmp_path / f"{t}.parquet")
    li = spark.read.parquet(f"{src}/lineitem.parquet")
    bad = li.limit(5).withColumn("l_partkey", F.col("l_partkey") + 10_000_000).union(
        li.limit(3).withColumn("l_orderkey", F.col("l_orderkey") + 10_000_000))
    shutil.rmtree(tmp_path / "lineitem.parquet", ignore_errors=True)
    (tmp_path / "lineitem.parquet").unlink(missing_ok=True)
    li.union(bad).write.parquet(str(tmp_path / "lineitem.parquet"))
    o = spark.read.parquet(f"{src}/orders.parquet")
    (tmp_path / "orders.parquet").unlink()
    o.union(o.limit(1).withColumn("o_orderkey", F.lit(77_000_000).cast(o.schema["o_orderkey"].dataType))
            .withColumn("o_custkey", F.lit(88_000_000).cast(o.schema["o_custkey"].dataType))
            .withColumn("o_orderstatus", F.lit("X"))).write.parquet(str(tmp_path / "orders.parquet"))

    def run(key, *cols):
        old = {tuple(r[c] for c in cols[:-1]): r[cols[-1]] for r in E.queries()[key](spark, src).collect()}
        new = {tuple(r[c] for c in cols[:-1]): r[cols[-1]]
               for r in E.queries()[key](spark, str(tmp_path)).collect()}
        return {k: new[k] - old[k] for k in new if new[k] != old[k]}

    assert run("dq_fk_orphans", "fk_name", "orphan_count") == {
        ("transaction_batches.service_id->services.service_id",): 5,
        ("transaction_batches.transaction_id->transactions.transaction_id",): 3}
    nulls = run("dq_nulls", "table_name", "column_name", "null_count")
    assert nulls == {("transactions", "customer_name"): 1, ("transaction_batches", "price_per_unit"): 5}


def test_updates_to_null_and_stored_update_times(spark):
    t = dt.datetime(2024, 1, 1)
    base = spark.createDataFrame([(1, "a@x", "d", t), (2, "b@x", "d", t), (3, "c@x", "d", t)],
                                 "id long, email string, note string, updated_at timestamp_ntz")
    ups = spark.createDataFrame([(1, t + dt.timedelta(days=1), 1, None, " "), (2, t + dt.timedelta(days=1), 2, "n@x", "e"),
                                 (2, t + dt.timedelta(days=2), 3, None, None)],
                                "id long, ts timestamp_ntz, event_id long, email string, note string")
    out = sinks.apply_updates(base, ups, "id", ["ts", "event_id"], ["email"], ["note"])
    assert out.columns == base.columns
    assert {r.id: (r.email, r.note, (r.updated_at - t).days) for r in out.collect()} == {
        1: (None, "d", 1), 2: (None, "e", 2), 3: ("c@x", "d", 0)}


def test_text_rules(spark):
    from washline.functions.formatting import is_blank, strip
    df = spark.createDataFrame([("\u00a0\u3000 x \x1c",), ("\u2003",), ("",), (None,)], "s string")
    assert [(r.t, r.b) for r in df.select(strip("s").alias("t"), is_blank("s").alias("b")).collect()] == [
        ("x", False), ("", True), ("", True), (None, True)]
    ba = spark.createDataFrame([("l", 1, Decimal("2.00")), ("l", 2, Decimal("1.50"))],
                               "batch_id string, addon_id long, quantity decimal(8,2)")
    ad = spark.createDataFrame([(1, "Softener"), (2, "Bleach")], "addon_id long, addon_name string")
    assert pricing.cart_addon_text(ba, ad).first().addon_text == "Softener x2, Bleach x1.50"
    assert {r.summary for r in pricing.cart_addon_summary(ba, ad).collect()} == {"Softener (x2)", "Bleach (x1.50)"}


def test_delete_restrict_without_children(spark):
    parent = spark.createDataFrame([(1,), (2,)], "k long")
    out = sinks.delete_restrict(parent, [], "k", parent.where("k = 1"))
    assert [tuple(r) for r in out.collect()] == [(1, "deleted")]


def test_a_cluster_without_a_checkpoint_folder_is_an_error():
    from types import SimpleNamespace

    import pytest

    from washline.session import ensure_checkpoint_dir

    def session(master):
        return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None),
                               conf=SimpleNamespace(get=lambda k, d=None: None))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            ensure_checkpoint_dir(session(master))
