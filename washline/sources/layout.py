"""Table layouts for the order facts on shared storage.

* Orders are written partitioned by creation month (``created_month`` = 'yyyy-MM'), so
  a report window also prunes whole partitions (``window_with_partitions``), not only
  row groups by min/max statistics.
* Orders and lines can be written bucketed by ``transaction_id`` into the session
  catalog with the same bucket count, so the lines-to-orders join reads co-located
  buckets without a shuffle.
* ``write_keyed`` sorts a table by its key over range partitions, with a Bloom filter per row group; ``lookup_keyed``
  then finds a list of keys by skipping files and row groups.

The first two writers add no shuffle of their own: each task writes the months it holds.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from washline.functions import timewin

PART_COL = "created_month"


def with_month(tx: DataFrame, ts_col: str = "created_at") -> DataFrame:
    return tx.withColumn(PART_COL, F.date_format(ts_col, "yyyy-MM"))


def write_orders_by_month(tx: DataFrame, path: str, mode: str = "overwrite") -> None:
    (with_month(tx).sortWithinPartitions(PART_COL)
     .write.mode(mode).partitionBy(PART_COL).parquet(path))


def window_with_partitions(col: str, name: str, as_of, part_col: str = PART_COL) -> Column:
    """``in_window`` plus the equivalent predicate on the month partition column, which
    Spark applies as a PartitionFilter before listing files."""
    pred = timewin.in_window(col, name, as_of)
    lo, hi = timewin.bounds(name, as_of)
    if lo is not None:
        pred = pred & (F.col(part_col) >= F.lit(f"{lo:%Y-%m}"))
    if hi is not None:
        last = hi - dt.timedelta(microseconds=1)
        pred = pred & (F.col(part_col) <= F.lit(f"{last:%Y-%m}"))
    return pred


def write_bucketed(df: DataFrame, table: str, buckets: int, key: str = "transaction_id",
                   mode: str = "overwrite") -> None:
    """Save ``df`` as a catalog table bucketed and sorted by ``key``. Tables written
    with the same key and bucket count join without an exchange."""
    df.write.mode(mode).bucketBy(buckets, key).sortBy(key).saveAsTable(table)


#: Keys that are handed to the scan as values; longer lists are joined.
MOST_KEYS = 1000


def write_keyed(df: DataFrame, path: str, key: str, partitions: int, mode: str = "overwrite") -> None:
    """``df`` sorted by ``key`` over range partitions, so that row groups hold narrow ranges of keys, with a Bloom
    filter on it for keys that fall into a range without being there."""
    (df.repartitionByRange(partitions, key).sortWithinPartitions(key).write.mode(mode)
     .option(f"parquet.bloom.filter.enabled#{key}", "true")
     .option("parquet.block.size", str(8 << 20)).parquet(path))


def lookup_keyed(spark: SparkSession, path: str, keys: DataFrame, key: str) -> DataFrame:
    """The rows of a ``write_keyed`` table whose ``key`` is in ``keys`` (a column of that name; NULL finds nothing).

    Up to ``MOST_KEYS`` distinct keys become values of the scan's filter: row groups are skipped by statistics and Bloom
    filters, and the table is not shuffled. More keys than that are joined, with the range they span as a
    filter and Spark's runtime Bloom filter where it pays."""
    table = spark.read.parquet(path)
    wanted = keys.select(key).where(F.col(key).isNotNull()).distinct()
    some = [r[0] for r in wanted.limit(MOST_KEYS + 1).collect()]
    if len(some) <= MOST_KEYS:
        # values next to each other go in one range: the scan's filter stays short, the second one is exact
        some.sort()
        spans = _spans(some, 10)
        near = reduce(lambda a, b: a | b, [F.col(key).between(a, b) for a, b in spans], F.lit(False))
        return table.where(near & F.col(key).isin(some))
    ends = wanted.agg(F.min(key).alias("a"), F.max(key).alias("b")).first()
    return table.where(F.col(key).between(ends["a"], ends["b"])).join(wanted, key, "left_semi")


def _spans(values: list, most: int) -> list[tuple]:
    """At most ``most`` ranges that cover the sorted ``values``, cut into equal numbers of them."""
    step = max(1, -(-len(values) // most))
    return [(values[i], values[min(i + step, len(values)) - 1]) for i in range(0, len(values), step)]
