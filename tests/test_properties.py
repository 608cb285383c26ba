"""Identities between operators."""

import math

from pyspark.sql import functions as F

from washline.functions import timewin
from washline.operators import changes, kpi, leaderboards
from washline.sources import views
from washline.sources.tables import Tables

MID = "/root/testdata/sf0.01"
AS_OF = "1998-10-15"


def test_kpi_identities(spark):
    t = Tables(spark, MID)
    tx = views.transactions(t, with_customer=False)
    for w in ("This Month", "This Year", "Last 7 Days", "All Time"):
        k = kpi.report_kpis(tx, w, AS_OF).first()
        assert k.finished_count + k.unclaimed_count == k.active_count        # no NULL status here
        trend = kpi.sales_trend(tx, w, AS_OF).agg(F.sum("daily_total")).first()[0] or 0.0
        assert math.isclose(trend, k.total_sales, rel_tol=1e-12)
        shares = [r.share_pct for r in kpi.payment_mix(tx, w, AS_OF).collect()]
        assert not shares or math.isclose(sum(shares), 100.0, rel_tol=1e-12)


def test_leaderboard_income_equals_active_lines(spark):
    t = Tables(spark, MID)
    tx = views.transactions(t, with_customer=False)
    lines = views.transaction_batches(t, with_part=False)
    board = leaderboards.service_leaderboard(tx, lines, views.services(t), "This Year", AS_OF)
    total = board.agg(F.sum("total_income"), F.sum("usage_count")).first()
    kept = tx.where((F.col("void_status") == "Active") & timewin.in_window("created_at", "This Year", AS_OF))
    direct = lines.join(kept.select("transaction_id"), "transaction_id", "left_semi").agg(
        F.sum("subtotal").cast("double"), F.count(F.lit(1))).first()
    assert math.isclose(total[0], direct[0], rel_tol=1e-12) and total[1] == direct[1]
    ranks = [r.rank for r in board.orderBy("rank").collect()]
    assert ranks == list(range(1, len(ranks) + 1))


def test_fold_independent_of_input_partitioning(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    tx = views.transactions(t, with_customer=False)
    ev = views.change_events(t)
    a = {(r.event_id, r.accepted, r.reject_reason)
         for r in changes.annotate(ev.repartition(1), tx).collect()}
    b = {(r.event_id, r.accepted, r.reject_reason)
         for r in changes.annotate(ev.repartition(13, "event_id"), tx, partitions=5).collect()}
    assert a == b
