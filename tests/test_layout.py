"""Month-partitioned orders prune partitions; bucketed tables join without a shuffle."""

import tempfile

from pyspark.sql import functions as F

from tests.conftest import SMALL
from washline.operators import kpi
from washline.sources import layout, views
from washline.sources.tables import Tables

AS_OF = "1998-10-15"


def test_month_partitions_prune_and_agree(spark):
    tx = views.transactions(Tables(spark, SMALL), with_customer=False)
    path = tempfile.mkdtemp(prefix="orders-by-month-", dir="/tmp") + "/orders"
    layout.write_orders_by_month(tx, path)
    stored = spark.read.parquet(path)
    pruned = stored.where(layout.window_with_partitions("created_at", "This Month", AS_OF))
    plan = spark._jvm.PythonSQLUtils.explainString(pruned._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [isnotnull(created_month" in plan and "1998-10" in plan
    plain = tx.where(F.col("created_at").between("1998-10-01", "1998-10-31 23:59:59"))
    assert pruned.count() == plain.count()
    a = kpi.sales_trend(stored.where(layout.window_with_partitions("created_at", "This Year", AS_OF)),
                        "This Year", AS_OF).collect()
    b = kpi.sales_trend(tx, "This Year", AS_OF).collect()
    assert [(r.t_date, r.daily_total) for r in a] == [(r.t_date, r.daily_total) for r in b]


def test_bucketed_join_has_no_exchange(spark):
    t = Tables(spark, SMALL)
    spark.sql("DROP TABLE IF EXISTS wl_orders_b")
    spark.sql("DROP TABLE IF EXISTS wl_lines_b")
    layout.write_bucketed(views.transactions(t, with_customer=False).select("transaction_id", "total_amount"),
                          "wl_orders_b", 8)
    layout.write_bucketed(views.transaction_batches(t, with_part=False).select("transaction_id", "subtotal"),
                          "wl_lines_b", 8)
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = spark.table("wl_lines_b").join(spark.table("wl_orders_b"), "transaction_id")
        plan = spark._jvm.PythonSQLUtils.explainString(j._jdf.queryExecution(), "formatted")
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert j.count() == spark.table("wl_lines_b").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
        spark.sql("DROP TABLE IF EXISTS wl_orders_b")
        spark.sql("DROP TABLE IF EXISTS wl_lines_b")
