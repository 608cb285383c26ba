"""Numbers stated in FIXTURES.md §2 (measured there, independently of this code)."""

import pytest
from pyspark.sql import functions as F

from washline.operators import changes
from washline.plans.registry import QUERIES
from washline.sources import views
from washline.sources.tables import Tables

MID = "/root/testdata/sf0.01"


@pytest.mark.parametrize("sf_dir,expect", [
    (MID, (67, 46851986.79, 172, 105, 69, 13)),
    ("/root/testdata/sf0.001", (7, 3214838.26, 13, 6, 6, 0)),
])
def test_report_kpis_this_month(spark, sf_dir, expect):
    r = QUERIES["report_kpis"](spark, sf_dir).first()
    got = (r.finished_count, round(r.total_sales, 2), r.active_count, r.unclaimed_count,
           r.unpaid_count, r.voided_count)
    assert got == expect


def test_top_service_cards(spark):
    lit = QUERIES["top_service_literal"](spark, MID).first()
    win = QUERIES["top_service_windowed"](spark, MID).first()
    assert (lit.service_id, lit.usage_count) == (558, 49)
    assert (win.service_id, win.usage_count) == (149, 4)


def test_fold_accepted_counts(spark):
    t = Tables(spark, MID)
    ann = changes.annotate(views.change_events(t), views.transactions(t, with_customer=False))
    got = {r.kind: r["count"] for r in ann.where("accepted").groupBy("kind").count().collect()}
    assert got == {"void": 746, "payment": 132, "status": 135}


def test_daily_totals_all_orders(spark):
    tx = views.transactions(Tables(spark, MID), with_customer=False)
    r = (tx.groupBy(F.date_trunc("day", "created_at")).agg(F.sum("total_amount").alias("s"))
         .agg(F.count(F.lit(1)).alias("days"), F.sum("s").alias("total")).first())
    assert (r.days, str(r.total)) == (2399, "3758439620.06")


def test_batch_id_is_unique(spark):
    lines = views.transaction_batches(Tables(spark, MID), with_part=False)
    assert lines.select("batch_id").distinct().count() == lines.count() == 60000
