"""Running ("as of the previous row") values per key that survive a hot key.

A plain ``Window.partitionBy(key).orderBy(ts)`` sends every row of one key to one task. Here the
rows are range-partitioned on (key, order) instead, so partitions are even whatever the keys are:
a hot key, a burst of rows at one instant and the NULL key (a key like any other) are all split.
The partition a row landed in is stored with it by one reliable write (``cut``), so every later
pass sees the same cut.

* Inside (partition, key) values come from ordinary windows.
* Only keys that cross a partition's edge need a value from before: at most two (partition, key)
  pairs per partition. ``crossing`` lists them, ``carry`` runs over their summaries, and ``attach``
  joins the result back; these tables are bounded by the number of partitions, so they are
  broadcast, and nothing depends on how many rows or keys there are.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from washline.session import checkpoint_dir, ensure_checkpoint_dir

PART = "__part"


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (lineage cut) of ``df`` into ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class released_shuffles:
    """While active, Spark deletes a query's shuffle files as soon as the query has ended."""

    KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.old = self.spark.conf.get(self.KEY, "false")
        self.spark.conf.set(self.KEY, "true")

    def __exit__(self, *exc) -> None:
        self.spark.conf.set(self.KEY, self.old)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below ``spark.checkpoint.dir`` and read again (lineage cut): for tables as long as the
    input, a fraction of a checkpoint's size, of which later steps read the columns they need."""
    spark = df.sparkSession
    if any(isinstance(f.dataType, T.NullType) for f in df.schema):  # Parquet has no such columns
        return checkpointed(df)
    path = f"{checkpoint_dir(spark).rstrip('/')}/written/{name}-{uuid.uuid4().hex}"
    with released_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame, keys: Sequence[str], order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """``df`` range-partitioned on (keys, order), written once, with the partition as ``PART``.

    ``order`` must end with a unique column."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *[F.col(c) for c in (*keys, *order)])
    return written(ranged.withColumn(PART, F.spark_partition_id()), "cut")


def before(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    """The rows of the same partition and key strictly before a row."""
    return Window.partitionBy(PART, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    on = left[PART] == right[f"_r{PART}"]
    for k in keys:
        on = on & left[k].eqNullSafe(right[f"_r{k}"])
    return on


def _renamed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"_r{c}" for c in (PART, *keys)})


def crossing(rows: DataFrame, keys: Sequence[str], stored: bool = True) -> DataFrame:
    """The (partition, key) pairs of keys found in several partitions: at most two per partition. ``stored``: found at once
    and kept; otherwise found when the result is asked for."""
    pairs = rows.groupBy(PART, *keys).agg(F.count(F.lit(1)).alias("_n"))
    several = pairs.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    pairs = several.where(F.col("_n") > 1).select(PART, *keys)
    return checkpointed(pairs) if stored else pairs


def edge_rows(rows: DataFrame, cross: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose summaries a carry needs."""
    cross = _renamed(cross, keys)
    return rows.join(F.broadcast(cross), _same(rows, cross, keys), "left_semi")


def carry(summary: DataFrame, keys: Sequence[str], stored: bool = True, **values) -> DataFrame:
    """Per (partition, key) of ``summary`` what comes in from the key's earlier partitions.

    Each value is a function of the window over the earlier partitions; later values may use the
    columns of earlier ones."""
    w = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    for name, value in values.items():
        summary = summary.withColumn(name, value(w))
    carried = summary.select(PART, *keys, *values)
    return checkpointed(carried) if stored else carried


def attach(rows: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the carried columns, NULL for keys that do not cross an edge."""
    carried = _renamed(carried, keys)
    return rows.join(F.broadcast(carried), _same(rows, carried, keys), "left").drop(
        *[f"_r{c}" for c in (PART, *keys)])


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str],
            lasts: Mapping[str, Column] | None = None,
            sums: Mapping[str, Column] | None = None,
            maxs: Mapping[str, Column] | None = None,
            partitions: int | None = None) -> DataFrame:
    """Add, for every row, over the rows of the same key strictly before it in ``order``:

    * ``lasts[out]``: the last non-NULL value of the expression (NULL if none);
    * ``sums[out]``: the sum of the expression (0 if none);
    * ``maxs[out]``: its largest value (NULL if none).
    """
    keys, lasts, sums, maxs = list(keys), dict(lasts or {}), dict(sums or {}), dict(maxs or {})
    rows = cut(df.select("*", *[c.alias(f"__v_{o}") for o, c in {**lasts, **sums, **maxs}.items()]),
               keys, order, partitions)
    at = F.struct(*order)
    summary = edge_rows(rows, crossing(rows, keys), keys).groupBy(PART, *keys).agg(
        *[F.max_by(f"__v_{o}", F.when(F.col(f"__v_{o}").isNotNull(), at)).alias(f"__b_{o}") for o in lasts],
        *[F.sum(f"__v_{o}").alias(f"__b_{o}") for o in sums],
        *[F.max(f"__v_{o}").alias(f"__b_{o}") for o in maxs])
    come = carry(summary, keys,
                 **{f"__c_{o}": (lambda w, o=o: F.last(f"__b_{o}", ignorenulls=True).over(w)) for o in lasts},
                 **{f"__c_{o}": (lambda w, o=o: F.sum(f"__b_{o}").over(w)) for o in sums},
                 **{f"__c_{o}": (lambda w, o=o: F.max(f"__b_{o}").over(w)) for o in maxs})
    w = before(keys, order)
    out = attach(rows, come, keys)
    done = {o: F.coalesce(F.last(f"__v_{o}", ignorenulls=True).over(w), F.col(f"__c_{o}")) for o in lasts}
    done |= {o: F.coalesce(F.sum(f"__v_{o}").over(w), F.lit(0)) + F.coalesce(F.col(f"__c_{o}"), F.lit(0))
             for o in sums}
    done |= {o: F.greatest(F.max(f"__v_{o}").over(w), F.col(f"__c_{o}")) for o in maxs}
    return out.select("*", *[c.alias(o) for o, c in done.items()]).drop(
        PART, *[f"__{x}_{o}" for o in done for x in "vc"])
