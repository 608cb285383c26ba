"""Streaming forms: append-mode windows close behind the watermark; late rows drop."""

import datetime as dt
import shutil
import tempfile
import time
from types import SimpleNamespace

from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.sequential import step
from washline.operators import changes, kpi
from washline.operators.outbox import pickup_outbox
from washline.sources import views
from washline.sources.tables import Tables
from washline.streaming import order_state, streams


def test_append_mode_days_equal_batch_and_late_rows_drop(spark):
    t = Tables(spark, SMALL)
    src = tempfile.mkdtemp(prefix="orders-stream-", dir="/tmp")
    base = tempfile.mkdtemp(prefix="orders-stream-run-", dir="/tmp")
    t.orders.coalesce(1).write.parquet(f"{src}/orders.parquet")   # a table folder under src
    first = {r.t_date: r.daily_total for r in streams.daily_sales_final(spark, src, base).collect()}
    tx = views.transactions(t, with_customer=False)
    batch = {r.t_date: r.daily_total for r in kpi.sales_trend(tx, "All Time", "2000-01-01").collect()}
    assert first and len(first) < len(batch)              # the newest days are still open
    assert all(batch[d] == v for d, v in first.items())   # closed days equal the batch result
    # a late order for a long-closed day arrives: it is behind the watermark and dropped
    late = (t.orders.where(F.col("o_orderkey") % 20 != 0).limit(1)
            .withColumn("o_orderdate", F.lit("1995-01-02 00:00:00").cast("timestamp_ntz")))
    late.write.mode("append").parquet(f"{src}/orders.parquet")
    again = {r.t_date: r.daily_total for r in streams.daily_sales_final(spark, src, base).collect()}
    assert again == first


def _events_in(spark, tmp_path, parts):
    """A root folder whose events come in the given order of files."""
    for t in ("orders", "customer"):
        shutil.copy(f"{SMALL}/{t}.parquet", tmp_path / f"{t}.parquet")
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
        time.sleep(1.1)  # files come in the order of their times


def _fold_of(events, tx):
    return changes.annotate(views.change_events(SimpleNamespace(events=events)), tx)


def _decided(df):
    return {(r.event_id, r.accepted, r.reject_reason, r.new_value if r.accepted else None) for r in df.collect()}


def test_keyed_state_equals_the_batch_fold_in_any_cut(spark, tmp_path):
    """Later requests first, some again, and a second run that goes on from the saved states."""
    t = Tables(spark, SMALL)
    tx = views.transactions(t, with_customer=False)
    ev = t.events.orderBy("ts", "event_id").checkpoint()
    late, early = (ev.where(c).checkpoint() for c in ("event_id % 3 = 0 OR event_id >= 700", "event_id % 3 != 0 AND event_id < 500"))
    rest = ev.join(late.unionByName(early), "event_id", "left_anti").select(ev.columns).checkpoint()
    _events_in(spark, tmp_path, [late, early.unionByName(late.limit(40))])
    base = str(tmp_path / "run")
    streams.decide_into(spark, str(tmp_path), base, max_bytes=1)
    both = late.unionByName(early)
    assert _decided(streams.decisions(spark, base)) == _decided(_fold_of(both, tx))
    seen = {r.event_id for r in streams.late_requests(spark, base).collect()}
    assert seen and seen <= {r.event_id for r in early.select("event_id").collect()}
    sent = {tuple(r) for r in streams.outbox_into(spark, str(tmp_path), base).collect()}
    before = spark.read.parquet(f"{base}/decisions").count()

    rest.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    early.limit(30).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))  # again
    streams.decide_into(spark, str(tmp_path), base, max_bytes=1)  # a new query: states come from the checkpoint
    want = _fold_of(ev, tx)
    got = streams.decisions(spark, base)
    assert _decided(got) == _decided(want)
    # only requests of the second run, and decisions they changed, went out again
    assert spark.read.parquet(f"{base}/decisions").count() - before < 2 * rest.count()
    expect = changes.apply_folds(tx, want)
    state = {r.transaction_id: (r.void_status, r.payment_status, r.status) for r in streams.order_state(got, tx).collect()}
    assert state == {r.transaction_id: (r.void_status, r.payment_status, r.status)
                     for r in expect.collect() if r.transaction_id in state}

    messages = streams.outbox_into(spark, str(tmp_path), base)
    again = streams.outbox_into(spark, str(tmp_path), base)  # nothing new: nothing is sent
    ids = [r.event_id for r in again.collect()]
    assert len(ids) == len(set(ids)) == messages.count()
    assert sent <= {tuple(r) for r in messages.collect()}  # what was out stays as it was
    full, cfg = views.transactions(t), views.system_config(spark)
    assert {r.event_id for r in pickup_outbox(want, full, cfg).collect()} <= set(ids)


def test_one_request_at_a_time():
    """The operator's rules are those of the plain loop."""
    for void in ("Active", "Voided"):
        for pay in ("Paid", "Unpaid"):
            for status in ("In-queue", "Ready to Claim", "Claimed", None):
                for action in ("VOID", "REVERT_VOID", "PAY", "Ready to Claim", "Claimed"):
                    for admin in (True, False):
                        for reason in ("r", " ", None):
                            after, ok, new = step((void, pay, status), action, admin, reason)
                            state, why, value = order_state.decide((void, pay, status), action, admin, reason)
                            assert state == after and (why is None) == ok and (not ok or value == new)


def test_requests_without_an_order(spark, tmp_path):
    ev = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), None, "error", 0.0, ""), (2, dt.datetime(2024, 1, 1), 10 ** 12,
                               "purchase", 0.0, "")], Tables(spark, SMALL).events.schema)
    _events_in(spark, tmp_path, [ev])
    base = str(tmp_path / "run")
    streams.decide_into(spark, str(tmp_path), base)
    assert {(r.event_id, r.order_id, r.reject_reason) for r in streams.decisions(spark, base).collect()} == {
        (1, None, "unknown_order"), (2, 10 ** 12, "unknown_order")}
