"""The order schema as Spark SQL temp views, for queries written as SQL text.

``register_order_views`` names the derived tables the way the order schema does
(Transactions, Transaction_Batches, Batch_Addons, Services, Addons, Category, Users,
system_config, Audit_Logs; Spark resolves names case-insensitively), so a report
written as SQL runs on Spark with parameters bound by name::

    register_order_views(spark, "/data/orders")
    spark.sql("SELECT COUNT(*) AS n FROM Transactions WHERE DATE(created_at) = :today",
              args={"today": datetime.date(1998, 10, 15)})

Views are lazy: each query plans from the parquet scans, so Catalyst prunes columns
and pushes filters exactly as for the DataFrame operators.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from washline.operators import changes
from washline.sources import views
from washline.sources.tables import Tables

VIEW_NAMES = ("transactions", "transaction_batches", "batch_addons", "services", "addons",
              "category", "users", "system_config", "audit_logs")


def register_order_views(spark: SparkSession, root: str, with_audit: bool = False) -> list[str]:
    """Create or replace the temp views; ``with_audit`` also folds the change log
    into ``audit_logs`` (runs the fold's checkpoints now)."""
    t = Tables(spark, root)
    tx = views.transactions(t)
    frames = {
        "transactions": tx,
        "transaction_batches": views.transaction_batches(t),
        "batch_addons": views.batch_addons(t),
        "services": views.services(t),
        "addons": views.addons(t),
        "category": views.category(t),
        "users": views.users(t),
        "system_config": views.system_config(spark),
    }
    if with_audit:
        ann = changes.annotate(views.change_events(t), views.transactions(t, with_customer=False))
        frames["audit_logs"] = changes.audit_rows(ann)
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    return list(frames)
