"""Per-run context handed to every registered query: the tables, the derived order
views, and the fixed report parameters used by the checks and the bench."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from washline.sources import views
from washline.sources.tables import Tables

# Report parameters of the registered queries (stand-ins for "today" and the
# screen's filter boxes). Fixed so Spark and the SQL oracle see the same inputs.
AS_OF = "1998-10-15"
WINDOW = "This Month"
#: Orders created before this day are purged by the delete requests.
PURGE_BEFORE = "2001-07-01 00:00:00"


class Ctx:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.t = Tables(spark, sf_dir)

    @cached_property
    def tx(self) -> DataFrame:
        return views.transactions(self.t)

    @cached_property
    def tx_lean(self) -> DataFrame:
        """Order headers without the customer join (no customer_name)."""
        return views.transactions(self.t, with_customer=False)

    @cached_property
    def batches(self) -> DataFrame:
        return views.transaction_batches(self.t)

    @cached_property
    def batches_lean(self) -> DataFrame:
        """Lines without the part join (no category_id, price_per_unit)."""
        return views.transaction_batches(self.t, with_part=False)

    @cached_property
    def batch_addons(self) -> DataFrame:
        return views.batch_addons(self.t)

    @cached_property
    def services(self) -> DataFrame:
        return views.services(self.t)

    @cached_property
    def addons(self) -> DataFrame:
        return views.addons(self.t)

    @cached_property
    def category(self) -> DataFrame:
        return views.category(self.t)

    @cached_property
    def users(self) -> DataFrame:
        return views.users(self.t)

    @cached_property
    def config(self) -> DataFrame:
        return views.system_config(self.spark)

    @cached_property
    def changes(self) -> DataFrame:
        return views.change_events(self.t)
