"""Physical-plan checks: pushdown, pruning, bounded broadcasts, no hot-key windows."""

import re

from washline.plans.registry import QUERIES
from tests.conftest import SMALL


def _plan(df) -> str:
    """The text ``df.explain("formatted")`` prints."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_time_window_reaches_parquet_scan(spark):
    plan = _plan(QUERIES["sales_trend"](spark, SMALL)) + _plan(QUERIES["payment_mix"](spark, SMALL))
    # the "This Month" range on the order date is pushed into the scan
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", plan)
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(o_orderdate", plan)


def test_kpis_read_only_needed_columns_and_no_customer_join(spark):
    plan = _plan(QUERIES["report_kpis"](spark, SMALL))
    schema = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    assert schema and all("o_custkey" not in s and "c_name" not in s for s in schema)
    assert "customer" not in plan


def test_unique_check_reads_no_dimension(spark):
    plan = _plan(QUERIES["dq_unique"](spark, SMALL))
    lines = [x for x in plan.splitlines() if "ReadSchema" in x]
    assert not any("c_name" in x or "p_retailprice" in x for x in lines)


def test_fold_windows_are_split_by_range_partition(spark):
    from washline.operators import changes
    from washline.sources import views
    from washline.sources.tables import Tables

    t = Tables(spark, SMALL)
    ev, tx = views.change_events(t), views.transactions(t, with_customer=False)
    plan = changes.annotate(ev, tx)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"windowspecdefinition\(__part#\d+, order_id#", plan)
    assert not re.search(r"windowspecdefinition\(order_id#", plan), \
        "a window over requests is partitioned by order only"


def test_rank_numbers_inside_range_partitions(spark):
    from pyspark.sql import functions as F
    from washline.functions.ranking import global_row_number

    df = spark.range(5000).select(F.col("id"), (F.col("id") % 17).alias("x"))
    plan = global_row_number(df, [F.col("x").desc(), F.col("id")])._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"row_number\(\) windowspecdefinition\(__part#", plan)


def test_report_ranges_reach_the_scan_on_both_time_columns(spark, tmp_path):
    from washline.operators import kpi
    from washline.plans.context import AS_OF, WINDOW
    from washline.sources import views
    from washline.sources.tables import Tables

    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", _plan(QUERIES["report_kpis"](spark, SMALL)))
    # where void_at is a stored column its range is pushed too
    views.transactions(Tables(spark, SMALL), with_customer=False).write.parquet(f"{tmp_path}/tx")
    plan = _plan(kpi.report_kpis(spark.read.parquet(f"{tmp_path}/tx"), WINDOW, AS_OF))
    for column in ("created_at", "void_at"):
        assert re.search(rf"PushedFilters: \[[^\]]*GreaterThanOrEqual\({column}", plan)


def test_checks_run_no_fold(spark):
    for key in ("dq_unique", "dq_nulls", "dq_enum", "dq_length", "dq_fk_orphans"):
        group = f"build-{key}"
        spark.sparkContext.setJobGroup(group, key)
        QUERIES[key](spark, SMALL)
        # opening a table may read a footer; a fold would run dozens of jobs
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) <= 10, key
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_receipts_scan_each_table_few_times(spark):
    plan = _plan(QUERIES["receipt_history"](spark, SMALL))
    assert len(re.findall(r"ReadSchema", plan)) <= 8
