"""Line edits: the two-level fold against one request at a time."""

import datetime as dt
import math
import random
from decimal import Decimal

import pytest

from tests.sequential import step
from washline.operators import edits

LIMIT = 7
LINE = ("batch_id string, transaction_id long, service_id long, category_id long, load_count long, "
        "weight decimal(8,2), price_per_unit decimal(10,2), subtotal decimal(10,2)")
ASK = ("event_id long, ts timestamp_ntz, order_id long, action string, actor_id long, is_admin boolean, "
       "batch_id string, service_id long, weight decimal(8,2)")
LOG = "event_id long, ts timestamp_ntz, order_id long, action string, actor_id long, is_admin boolean, reason string"


def simulate(orders, lines, prices, log, asks):
    """Decisions, lines and totals; ``orders``: {id: (void, pay, status, total)}."""
    state = {o: v[:3] for o, v in orders.items()}
    totals = {o: v[3] for o, v in orders.items()}
    rows = {r[0]: list(r) for r in lines}
    verdict = {}
    for e in sorted([(*r, None, None, None) for r in log] + [(*r[:6], None, *r[6:]) for r in asks],
                    key=lambda r: (r[1], r[0])):
        eid, _, order, action, _, admin, reason, line, service, weight = e
        if action not in edits.EDIT_ACTIONS:
            if order in state:
                state[order], _, _ = step(state[order], action, admin, reason)
            continue
        why = None
        if order not in state:
            why = "unknown_order"
        else:
            void, pay, status = state[order]
            why = ("order_claimed" if status == "Claimed" else "order_voided" if void == "Voided" else
                   "staff_on_paid" if not admin and pay == "Paid" else None)
        mine = sorted((not r[0].startswith("new-") and (0, 0, r[0]) or (1, r[-1], r[0]), r) for r in rows.values()
                      if r[1] == order)
        if why is None and action != "ADD_LINE" and (line not in rows or rows[line][1] != order
                                                     or line.startswith("new-")):
            why = "no_line"
        if why is None and action != "DELETE_LINE":
            if weight is None:
                why = "no_weight"
            elif service not in prices:
                why = "no_service"
            elif mine and mine[0][1][5] != weight:
                why = "weight_differs"
        verdict[eid] = why
        if why:
            continue
        if action == "DELETE_LINE":
            del rows[line]
        else:
            loads = math.ceil(weight / LIMIT)
            sub = loads * prices[service]
            if action == "EDIT_LINE":
                rows[line][2], rows[line][4], rows[line][5], rows[line][7] = service, int(loads), weight, sub
            else:
                # the time of the request is the last field: added lines come in the order of their requests
                rows[f"new-{eid}"] = [f"new-{eid}", order, service, edits.ADDED_CATEGORY, int(loads), weight,
                                      prices[service], sub, (e[1], eid)]
        totals[order] = sum((r[7] for r in rows.values() if r[1] == order), Decimal(0))
    return verdict, {k: tuple(v[:8]) for k, v in rows.items()}, totals


def make(seed, n_orders, n_asks, n_lines=5):
    rng = random.Random(seed)
    weights = [Decimal("3.00"), Decimal("7.00"), Decimal("7.50")]
    orders = {o: (rng.choice(["Active", "Active", "Voided"]), rng.choice(["Paid", "Unpaid"]),
                  rng.choice(["In-queue", "In-queue", "Claimed"]), Decimal("99.00")) for o in range(n_orders)}
    orders[0] = ("Active", "Unpaid", "In-queue", Decimal("99.00"))
    lines = []
    for o in range(n_orders + 1):  # one order has lines but is unknown, some have none
        for k in range(rng.randrange(n_lines + 1)):
            lines.append((f"{o}-{k}", o, rng.randrange(6), 2, 1, rng.choice(weights), Decimal("5.00"),
                          Decimal(rng.randrange(100))))
    prices = {s: Decimal(10 + s) for s in range(4)}
    t0 = dt.datetime(2024, 1, 1)

    def when(i):
        return t0 + dt.timedelta(minutes=rng.randrange(i // 3 * 10, i // 3 * 10 + 40))
    log = [(i, when(i), rng.randrange(n_orders), rng.choice(["VOID"] + ["REVERT_VOID"] * 4 + ["PAY"] * 4 +
            ["Ready to Claim"]), 1, rng.random() < 0.7, "r") for i in range(n_asks // 3)]
    asks = []
    for i in range(n_asks):
        o = rng.randrange(n_orders + 1) if rng.random() < 0.97 else None
        asks.append((1000 + i, when(i // 3), o,
                     rng.choice(["EDIT_LINE"] * 5 + ["ADD_LINE", "DELETE_LINE"]), 1, rng.random() < 0.7,
                     rng.choice([f"{o}-{rng.randrange(n_lines)}"] * 9 + [f"{rng.randrange(n_orders)}-0", None]),
                     rng.randrange(5), rng.choice([*weights, *weights, None])))
    return orders, lines, prices, log, asks


@pytest.mark.parametrize("seed,orders,asks,n_lines,partitions", [
    (1, 15, 300, 5, 1), (2, 15, 300, 5, 7), (3, 3, 400, 30, 50), (4, 1, 300, 40, 9), (5, 40, 300, 3, 16)])
def test_fold_equals_sequential_loop(spark, seed, orders, asks, n_lines, partitions):
    orders, lines, prices, log, asks = make(seed, orders, asks, n_lines)
    tx = spark.createDataFrame(
        [(o, v[2], v[1], v[0], v[3]) for o, v in orders.items()],
        "transaction_id long, status string, payment_status string, void_status string, total_amount decimal(10,2)")
    services = spark.createDataFrame([(s, p, "Active") for s, p in prices.items()] + [(4, Decimal(1), "Inactive")],
                                     "service_id long, price_per_load decimal(10,2), status string")
    got = edits.apply_edits(spark.createDataFrame(lines, LINE), tx, services, spark.createDataFrame(log, LOG),
                            spark.createDataFrame(asks, ASK), partitions=partitions)
    verdict, rows, totals = simulate(orders, lines, prices, log, asks)
    assert {r.event_id: r.reject_reason for r in got.requests.collect()} == verdict
    assert {r[0]: tuple(r) for r in got.lines.collect()} == rows
    assert {r.transaction_id: r.total_amount for r in got.totals.collect()} == totals
    assert sum(v is None for v in verdict.values()) > 3


def test_no_requests_leave_everything(spark):
    tx = spark.createDataFrame([(1, "In-queue", "Unpaid", "Active", Decimal(3))], "transaction_id long, status string, "
                               "payment_status string, void_status string, total_amount decimal(10,2)")
    lines = spark.createDataFrame([("1-0", 1, 1, 1, 1, Decimal(7), Decimal(5), Decimal(5))], LINE)
    services = spark.createDataFrame([(1, Decimal(2), "Active")],
                                     "service_id long, price_per_load decimal(10,2), status string")
    got = edits.apply_edits(lines, tx, services, spark.createDataFrame([], LOG), spark.createDataFrame([], ASK))
    assert got.requests.count() == 0
    assert [tuple(r) for r in got.lines.collect()] == [tuple(r) for r in lines.collect()]
    assert [tuple(r) for r in got.totals.collect()] == [(1, Decimal("3.00"))]
