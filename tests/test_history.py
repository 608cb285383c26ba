"""State intervals and the state at a time, against a sequential replay."""

import datetime as dt
import random

import pytest

from tests.sequential import step
from tests.test_fold import _random_log
from washline.operators import changes, history

TX = "transaction_id long, status string, payment_status string, void_status string"
LOG = ("event_id long, ts timestamp_ntz, order_id long, action string, actor_id long, is_admin boolean, "
       "reason string")


def replay(base, events):
    """Per order the states with the time each begins (None: from the start)."""
    runs = {o: [(None, (v, p, s))] for o, s, p, v in base}
    for e in sorted(events, key=lambda r: (r[1], r[0])):
        _, ts, o, action, _, admin, reason = e
        if o not in runs:
            continue
        new, ok, _ = step(runs[o][-1][1], action, admin, reason)
        if ok:
            if runs[o][-1][0] == ts:
                runs[o].pop()
            runs[o].append((ts, new))
    return runs


@pytest.mark.parametrize("seed,orders,partitions", [(1, 12, 1), (2, 12, 40), (3, 1, 9), (4, 150, 16)])
def test_intervals_and_probes_equal_a_replay(spark, seed, orders, partitions):
    base, events = _random_log(seed, orders)
    base.append((None, "In-queue", "Paid", "Active"))  # an order without an id is a row like any other
    events.append((9_000, dt.datetime(2024, 1, 1), 777, "VOID", 1, True, "r"))  # unknown order
    tx = spark.createDataFrame(base, TX)
    ann = changes.annotate(spark.createDataFrame(events, LOG), tx, partitions=partitions)
    runs = replay(base, events)
    expect = set()
    for o, states in runs.items():
        ends = [s[0] for s in states[1:]] + [None]
        expect |= {(o, *state, start, end) for (start, state), end in zip(states, ends, strict=True)}
    got = [tuple(r) for r in history.intervals(ann, tx, partitions).collect()]
    assert len(got) == len(expect) and set(got) == expect

    rng = random.Random(seed)
    times = sorted({e[1] for e in events})
    probes = [(i, rng.choice([*range(orders), None, 777]), rng.choice([
        rng.choice(times), rng.choice(times) + dt.timedelta(seconds=rng.randrange(-900, 900)), None]))
        for i in range(300)]
    at = history.state_at(ann, tx, spark.createDataFrame(probes, "probe_id long, order_id long, at timestamp_ntz"),
                          partitions)

    def state(o, t):
        if t is None or o not in runs:
            return (None, None, None)
        return [s for start, s in runs[o] if start is None or start <= t][-1]
    assert {r.probe_id: tuple(r)[1:] for r in at.collect()} == {i: (o, t, *state(o, t)) for i, o, t in probes}


def test_empty_tables(spark):
    tx = spark.createDataFrame([], TX)
    ann = changes.annotate(spark.createDataFrame([], LOG), tx)
    assert history.intervals(ann, tx).count() == 0
    probes = spark.createDataFrame([(1, 2, dt.datetime(2024, 1, 1))], "probe_id long, order_id long, at timestamp_ntz")
    assert [tuple(r)[3:] for r in history.state_at(ann, tx, probes).collect()] == [(None, None, None)]
