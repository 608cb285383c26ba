"""A global row number that does not funnel all rows into one task.

Rows are range-partitioned on the sort key and written once with their partition; rows are numbered
inside each partition and shifted by the row count of all earlier ones. The table of offsets has one
row per partition, so broadcasting it is bounded by the partition count, not by the data.

The sort key must be a total order (end it with a unique id) so numbering is deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from washline.functions.running import PART, checkpointed


def global_row_number(df: DataFrame, order: Sequence[Column], out: str = "rank",
                      partitions: int | None = None) -> DataFrame:
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(df.repartitionByRange(n, *order).withColumn(PART, F.spark_partition_id()))
    offsets = ranged.groupBy(PART).agg(F.count(F.lit(1)).alias("__n")).select(
        F.col(PART).alias("__p"),
        F.coalesce(F.sum("__n").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("__off"))
    local = ranged.withColumn("__rn", F.row_number().over(Window.partitionBy(PART).orderBy(*order)))
    return (local.join(F.broadcast(offsets), F.col(PART) == F.col("__p"))
            .withColumn(out, (F.col("__off") + F.col("__rn")).cast("long"))
            .drop(PART, "__p", "__rn", "__off"))
