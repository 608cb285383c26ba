"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from washline.session import checkpoint_dir, ensure_checkpoint_dir

#: A word is a run of characters other than space, tab, LF, VT, FF and CR.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder the session names in spark.checkpoint.dir."""
    ensure_checkpoint_dir(spark)
    return f"{checkpoint_dir(spark)}/washline-llm/{name}-{uuid.uuid4().hex}"


def scratch_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared scratch folder; returns the reread table and its path.

    Cuts lineage: a lost executor costs a reread of shared files, not a recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with released_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_scratch(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    jvm = spark._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


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


class small_batches:
    """While active, what readers and Python workers get at once is bounded by bytes or some rows.

    For tables with rows of about a megabyte: Spark's own bounds (4096 and 10000 rows, 64 MB) let a task hold
    several times all it reads, in the executor and in its Python worker."""

    KEYS = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.parquet.columnarReaderBatchSize": "16"}

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.old = {k: self.spark.conf.get(k) for k in self.KEYS}
        for k, v in self.KEYS.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *exc) -> None:
        for k, v in self.old.items():
            self.spark.conf.set(k, v)


def held_out(doc_id: Column) -> Column:
    """True for the quarter of ids no classifier may learn from: crc32(id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def hash_sample(rows: DataFrame, n: int, total: int, *by: str) -> DataFrame:
    """``n`` of the ``total`` rows, the first by a hash of the columns ``by`` (all rows if there are fewer).

    The hash filters first, with room for an eighth more, so that what the final cut moves is bounded by ``n``
    and not by the number of partitions; rows that agree in all of ``by`` count as they come."""
    draw = F.pmod(F.xxhash64(*by), F.lit(1 << 30))
    share = 1.125 * n / max(total, 1) + 16 / max(total, 1)
    near = rows if share >= 1 else rows.where(draw < F.lit(int(share * (1 << 30))))
    return near.orderBy(draw, *by).limit(n)


def word_count(text: Column) -> Column:
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have yet (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df
