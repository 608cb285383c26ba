"""The window-based change fold against a one-request-at-a-time loop (brute force),
for several bucket sizes; and the running/ranking helpers against plain windows."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from washline.functions.ranking import global_row_number
from washline.functions.running import running
from washline.operators import changes
from tests.sequential import step

ACTIONS = ["VOID", "REVERT_VOID", "PAY", "Ready to Claim", "Claimed"]


def _random_log(seed, n_orders=12, n_events=400):
    rnd = random.Random(seed)
    base = []
    for o in range(n_orders):
        base.append((o, rnd.choice(["In-queue", "Ready to Claim", "Claimed"]), rnd.choice(["Paid", "Unpaid"]),
                     rnd.choice(["Active", "Active", "Voided"])))
    events = []
    t0 = dt.datetime(2024, 1, 1)
    for e in range(n_events):
        # bursts: many requests share a timestamp, ordered by id
        ts = t0 + dt.timedelta(minutes=rnd.choice([0, 7, 60, 600, 1500, 3000]) + (e // 5) * 13)
        events.append((e, ts, rnd.randrange(n_orders), rnd.choice(ACTIONS), e % 10, rnd.random() < 0.5,
                       rnd.choice(["r", " ", "\u00a0\u3000", "", None, "x y"])))
    return base, events


def _simulate(base, events):
    state = {o: (v, p, s) for o, s, p, v in base}
    out = {}
    for e in sorted(events, key=lambda r: (r[1], r[0])):
        eid, _, o, action, _, admin, reason = e
        state[o], ok, _ = step(state[o], action, admin, reason)
        out[eid] = ok
    return out, state


@pytest.mark.parametrize("seed,orders,partitions", [
    (1, 12, 1),     # no order crosses a partition
    (2, 12, 4),
    (3, 12, 40),    # every order crosses several
    (4, 2, 9),
    (5, 1, 7),      # one order holds all requests
    (6, 150, 16),   # many orders, few requests each
])
def test_fold_equals_sequential_loop(spark, seed, orders, partitions):
    base, events = _random_log(seed, orders)
    tx = spark.createDataFrame([(o, s, p, v) for o, s, p, v in base],
                               "transaction_id long, status string, payment_status string, void_status string")
    ev = spark.createDataFrame(events, "event_id long, ts timestamp_ntz, order_id long, action string, "
                                       "actor_id long, is_admin boolean, reason string")
    ann = changes.annotate(ev, tx, partitions=partitions)
    got = {r.event_id: r.accepted for r in ann.select("event_id", "accepted").collect()}
    expect, final = _simulate(base, events)
    assert got == expect
    cur = {r.transaction_id: (r.void_status, r.payment_status, r.status)
           for r in changes.apply_folds(tx, ann).collect()}
    assert cur == final


@pytest.mark.parametrize("keys,minutes", [
    ([0, 1, 2], 5000),
    ([None, None, None, 1], 5000),   # the NULL key holds most rows
    ([7], 1),                        # one key, one timestamp
    (list(range(400)), 5000),        # many keys
])
def test_running_equals_plain_window(spark, keys, minutes):
    rnd = random.Random(7)
    rows = [(rnd.choice(keys), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rnd.randrange(minutes)), i,
             rnd.choice([None, 1, 2, 3])) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, ts timestamp_ntz, id long, v long")
    w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    expect = {r.id: (r.l, r.s) for r in df.select(
        "id", F.last("v", ignorenulls=True).over(w).alias("l"),
        F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s")).collect()}
    for partitions in (1, 6, 50):
        got = running(df, ["k"], ["ts", "id"], lasts={"l": F.col("v")},
                      sums={"s": F.coalesce(F.col("v"), F.lit(0))}, partitions=partitions)
        assert {r.id: (r.l, r.s) for r in got.collect()} == expect


@pytest.mark.parametrize("seed,orders,partitions", [(1, 12, 4), (4, 1, 9)])
def test_void_only_fold_equals_the_whole_one(spark, seed, orders, partitions):
    base, events = _random_log(seed, orders)
    tx = spark.createDataFrame(base, "transaction_id long, status string, payment_status string, void_status string")
    ev = spark.createDataFrame([*events, (9000, dt.datetime(2024, 1, 1), 777, "VOID", 1, True, "r")],
                               "event_id long, ts timestamp_ntz, order_id long, action string, "
                               "actor_id long, is_admin boolean, reason string")
    whole = changes.annotate(ev, tx, partitions).where("kind = 'void'")
    some = changes.void_decisions(ev, tx, partitions)
    rows = lambda d: {(r.event_id, r.accepted, r.new_value, r.reason) for r in d.collect()}
    assert rows(some) == rows(whole)
    assert {tuple(r) for r in changes.fold_voids(some).collect()} == {tuple(r) for r in changes.fold_voids(whole).collect()}


def test_unknown_orders_are_refused(spark):
    tx = spark.createDataFrame([(1, "In-queue", "Paid", "Active", "ORD-99")],
                               "transaction_id long, status string, payment_status string, "
                               "void_status string, display_id string")
    t = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame(
        [(1, t, 1, "VOID", 5, True, "r"), (2, t, 2, "VOID", 5, True, "r"), (3, t, None, "PAY", 5, True, None)],
        "event_id long, ts timestamp_ntz, order_id long, action string, actor_id long, is_admin boolean, "
        "reason string")
    ann = changes.annotate(ev, tx, partitions=3)
    assert {r.event_id: r.reject_reason for r in ann.collect()} == {
        1: None, 2: "unknown_order", 3: "unknown_order"}
    assert [r.description for r in changes.audit_rows(ann).collect()] == ["Voided ORD-99. Reason: r"]


def test_global_row_number(spark):
    rnd = random.Random(3)
    df = spark.createDataFrame([(i, rnd.randrange(20)) for i in range(300)], "id long, x long")
    order = [F.col("x").desc(), F.col("id").asc()]
    expect = {r.id: r.rn for r in df.select("id", F.row_number().over(Window.orderBy(*order)).alias("rn"))
              .collect()}
    got = {r.id: r.rank for r in global_row_number(df, order, "rank", partitions=5).collect()}
    assert got == expect
    small = {r.id: r.rank for r in global_row_number(df, order, "rank").collect()}
    assert small == expect
