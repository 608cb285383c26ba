"""Published batches, totals by signed deltas, and the daily rollup."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.test_plans import _plan
from washline.operators import deltas, kpi, rollup
from washline.plans.context import AS_OF, WINDOW
from washline.sources import views
from washline.sources.published import PublishedTable
from washline.sources.tables import Tables

ROWS = "id long, month string, v long"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_batches_replace_partitions_once(spark, tmp_path):
    table = PublishedTable(spark, f"{tmp_path}/t", "month")
    base = [(1, "2001-07", 10), (2, "2001-08", 20), (3, None, 30), (4, "a/b=c", 40)]
    assert table.publish("base", spark.createDataFrame(base, ROWS))
    assert rows_of(table.read()) == sorted(base, key=str)
    change = spark.createDataFrame([(2, "2001-08", 21), (5, "2001-08", 50)], ROWS)
    assert table.publish("b1", change)
    after = sorted([base[0], (2, "2001-08", 21), (5, "2001-08", 50), *base[2:]], key=str)
    assert rows_of(table.read()) == after
    version = table.version()
    assert not table.publish("b1", change)  # a replay changes nothing
    assert table.version() == version and rows_of(table.read()) == after
    assert rows_of(table.read(["2001-07", None and ""])) == [base[0]]
    assert table.publish("b2", spark.createDataFrame([], ROWS), dropped=["2001-07"])
    assert rows_of(table.read()) == [r for r in after if r[1] != "2001-07"]
    assert table.vacuum() == 2 and rows_of(table.read()) == [r for r in after if r[1] != "2001-07"]


def test_death_between_stage_and_switch(spark, tmp_path):
    table = PublishedTable(spark, f"{tmp_path}/t", "month")
    base = [(1, "2001-07", 10), (2, "2001-08", 20)]
    table.publish("base", spark.createDataFrame(base, ROWS))
    reader = table.read()
    table.stage("b1", spark.createDataFrame([(9, "2001-07", 99), (8, "2001-09", 1)], ROWS))  # and no switch
    assert rows_of(PublishedTable(spark, f"{tmp_path}/t", "month").read()) == base
    # the batch runs again, with other rows staged over the dead ones
    assert table.publish("b1", spark.createDataFrame([(1, "2001-07", 11)], ROWS))
    assert rows_of(table.read()) == [(1, "2001-07", 11), (2, "2001-08", 20)]
    assert rows_of(reader) == base  # a reader that had begun keeps its version


def test_second_publisher_starts_again_from_what_it_finds(spark, tmp_path):
    one, two = (PublishedTable(spark, f"{tmp_path}/t", "month") for _ in range(2))
    one.publish("base", spark.createDataFrame([(1, "a", 1), (2, "b", 2)], ROWS))
    frame = spark.createDataFrame([(1, "a", 10)], ROWS)
    staged = two.stage("x", frame)
    one.publish("y", spark.createDataFrame([(2, "b", 20)], ROWS))
    assert two.switch("x", frame.schema.json(), staged)
    assert rows_of(one.read()) == [(1, "a", 10), (2, "b", 20)]


def test_unpublished_table(spark, tmp_path):
    with pytest.raises(ValueError):
        PublishedTable(spark, f"{tmp_path}/t", "month").read()


LINES = "batch_id string, transaction_id long, subtotal decimal(10,2)"


def test_totals_by_deltas_equal_a_recompute(spark, tmp_path):
    rng = random.Random(4)
    lines = {f"l{i}": (rng.choice([0, 0, 0, *range(400), None]), Decimal(rng.randrange(10_000)) / 100) for i in range(900)}
    orders = spark.range(400).toDF("transaction_id")

    def frame(held):
        return spark.createDataFrame([(k, *v) for k, v in held.items()], LINES)
    table = PublishedTable(spark, f"{tmp_path}/totals", "part")
    table.publish("base", deltas.full_totals(orders, frame(lines), span=50))
    for batch in range(4):
        before = dict(lines)
        low = 100 * batch
        for k in [k for k, (o, _) in lines.items() if o is not None and low <= o < low + 60 and rng.random() < 0.5]:
            if rng.random() < 0.4:
                del lines[k]
            else:
                lines[k] = (rng.randrange(low, low + 60), Decimal(rng.randrange(10_000)) / 100)  # may move to another order
        lines |= {f"n{batch}-{i}": (rng.randrange(low, low + 60), Decimal(rng.randrange(99))) for i in range(20)}
        change = deltas.line_changes(frame(before), frame(lines))
        assert deltas.apply_changes(table, f"b{batch}", change, span=50)
        assert not deltas.apply_changes(table, f"b{batch}", change, span=50)
        assert rows_of(table.read()) == rows_of(deltas.full_totals(orders, frame(lines), span=50))
    kept = table.manifest()["parts"]
    assert kept["7"].startswith("data/b3/") and kept["1"].startswith("data/b0/")  # parts keep their last batch's files


def test_untouched_parts_are_not_opened(spark, tmp_path):
    orders = spark.range(1000).toDF("transaction_id")
    lines = orders.select(F.col("transaction_id").cast("string").alias("batch_id"), "transaction_id",
                          F.lit(1).cast("decimal(10,2)").alias("subtotal"))
    table = PublishedTable(spark, f"{tmp_path}/totals", "part")
    table.publish("base", deltas.full_totals(orders, lines, span=100))
    files = table.read([3]).inputFiles()
    assert files and all("/_part=3/" in f for f in files) and len(table.read().inputFiles()) > len(files)
    change = spark.createDataFrame([(310, 1, Decimal(5)), (5000, 1, Decimal(2)), (None, 1, Decimal(2))],
                                   "transaction_id long, sign int, subtotal decimal(10,2)")
    deltas.apply_changes(table, "b", change, span=100)
    parts = table.manifest()["parts"]
    assert {k for k, v in parts.items() if v.startswith("data/b/")} == {"3", "50"}
    assert rows_of(table.read([50])) == [(50, 5000, 1, Decimal("2.00"))]


def orders_of(spark):
    return views.transactions(Tables(spark, SMALL), with_customer=False)


def test_rollup_answers_like_the_orders(spark, tmp_path):
    tx = orders_of(spark)
    late = (F.col("transaction_id") % 7) == 0
    rollup.merge_cells(rollup.daily_cells(tx.where(~late)), rollup.daily_cells(tx.where(late))).write.parquet(
        f"{tmp_path}/cells")
    cells = spark.read.parquet(f"{tmp_path}/cells")
    for window in ("Today", "Last 7 Days", "This Month", "This Year", "All Time"):
        assert rows_of(rollup.report_kpis(cells, window, AS_OF)) == rows_of(kpi.report_kpis(tx, window, AS_OF))
        assert rows_of(rollup.sales_trend(cells, window, AS_OF)) == rows_of(kpi.sales_trend(tx, window, AS_OF))
    assert rows_of(rollup.dashboard_cards(cells, AS_OF)) == rows_of(kpi.dashboard_cards(tx, AS_OF))
    assert rows_of(rollup.time_windows(cells, AS_OF)) == rows_of(kpi.time_windows(tx, AS_OF))
    assert rows_of(rollup.payment_mix(cells, "All Time", AS_OF).drop("share_label")) == rows_of(
        kpi.payment_mix(tx, "All Time", AS_OF))
    plan = _plan(rollup.report_kpis(cells, WINDOW, AS_OF))
    assert "orders.parquet" not in plan and "cells" in plan  # no order rows are read


def test_rollup_corrections_and_odd_rows(spark):
    schema = ("created_at timestamp_ntz, void_at timestamp_ntz, status string, payment_status string, "
              "void_status string, total_amount decimal(10,2)")
    day = dt.datetime(1998, 10, 15, 9)
    old = [(day, None, "In-queue", "Unpaid", "Active", Decimal(5)), (None, None, None, None, None, None),
           (day, day, "In-queue", "Paid", "Voided", Decimal(7))]
    new = [(day, None, "Claimed", "Paid", "Active", Decimal(6)), old[1], old[2]]
    a, b = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)
    corrected = rollup.merge_cells(rollup.daily_cells(a), rollup.daily_cells(a, -1), rollup.daily_cells(b))
    assert rows_of(corrected) == rows_of(rollup.merge_cells(rollup.daily_cells(b)))
    assert rollup.merge_cells(rollup.daily_cells(a), rollup.daily_cells(a, -1)).count() == 0
    card = rollup.report_kpis(corrected, "Today", AS_OF).first()
    assert (card.finished_count, card.total_sales, card.voided_count) == (1, 6.0, 1)
    empty = rollup.report_kpis(rollup.daily_cells(a.limit(0)), "Today", AS_OF).first()
    assert tuple(empty) == (0, 0.0, 0, 0, 0, 0, 0.0)
