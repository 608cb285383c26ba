"""Structured Streaming forms of the daily sales trend, the order change fold and
the pickup outbox.

All sources are file streams over the table folders; sinks and checkpoints live
under the session's ``spark.checkpoint.dir`` (a shared folder on a cluster), so a
restarted query resumes from its offsets and state. ``run_available_now`` drives a
query over everything currently present and returns the sink as a batch
DataFrame, which is how the registered queries and tests use them.
"""

from __future__ import annotations

import os
import uuid
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from washline.functions.formatting import instant_to_ntz, ntz_to_instant, strip
from washline.functions.running import checkpointed
from washline.operators import changes
from washline.operators.outbox import pickup_outbox
from washline.session import checkpoint_dir
from washline.sources import views
from washline.sources.tables import Tables
from washline.streaming import order_state as keyed


def table_stream(spark: SparkSession, root: str, name: str, max_bytes: int = 512 << 20) -> DataFrame:
    """A file stream over one table (a ``name.parquet`` folder or file under ``root``).
    ``maxBytesPerTrigger`` bounds a micro-batch; results do not depend on it."""
    tables = Tables(spark, root)
    schema = tables.read(name).schema
    path = tables.path(name)
    reader = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(max_bytes))
    if os.path.isdir(path) or "://" in path:
        return reader.parquet(path)
    return reader.option("pathGlobFilter", os.path.basename(path)).parquet(os.path.dirname(path))


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"


def run_available_now(df: DataFrame, name: str, mode: str = "append", base: str | None = None) -> DataFrame:
    """Run a streaming DataFrame over all available input and return its sink.

    ``append``: a parquet file sink. ``complete``: each micro-batch's full result
    replaces the sink table (foreachBatch), for aggregates whose complete result is
    wanted. Passing the same ``base`` again resumes from the saved offsets and state,
    so only new input is processed.
    """
    spark = df.sparkSession
    base = base or _scratch(spark, name)
    out, ckpt = f"{base}/out", f"{base}/checkpoint"
    w = df.writeStream.trigger(availableNow=True).option("checkpointLocation", ckpt).queryName(
        f"{name}_{uuid.uuid4().hex[:6]}")
    if mode == "complete":
        def _replace(batch: DataFrame, _epoch: int) -> None:
            batch.write.mode("overwrite").parquet(out)
        q = w.outputMode("complete").foreachBatch(_replace).start()
    else:
        q = w.outputMode("append").format("parquet").option("path", out).start()
    q.awaitTermination()
    return spark.read.parquet(out)


# --- ST-1: daily sales ------------------------------------------------------------

def daily_sales_stream(spark: SparkSession, root: str, watermark: str = "1 day") -> DataFrame:
    orders = table_stream(spark, root, "orders")
    tx = views.transactions(SimpleNamespace(orders=orders), with_customer=False)
    active = tx.where(F.col("void_status") == "Active").withColumn(
        "_ts", ntz_to_instant("created_at"))
    return (active.withWatermark("_ts", watermark)
            .groupBy(F.window("_ts", "1 day").alias("w"))
            .agg(F.sum("total_amount").alias("_amt")))


def daily_sales_final(spark: SparkSession, root: str, base: str | None = None) -> DataFrame:
    """Append mode: a day is written once the watermark (latest order time seen minus
    one day) has passed its end, and never changes afterwards; orders arriving later
    than the watermark are dropped. The newest days stay open until later input
    moves the watermark."""
    res = run_available_now(daily_sales_stream(spark, root), "daily_sales_final", mode="append", base=base)
    return res.select(instant_to_ntz("w.start").alias("t_date"),
                      F.col("_amt").cast("double").alias("daily_total"))


def daily_sales(spark: SparkSession, root: str) -> DataFrame:
    """Complete-mode result: equals the batch daily trend over all time."""
    res = run_available_now(daily_sales_stream(spark, root), "daily_sales", mode="complete")
    return res.select(instant_to_ntz("w.start").alias("t_date"),
                      F.col("_amt").cast("double").alias("daily_total"))


# --- ST-3: order state --------------------------------------------------------------
# A stateful operator holds one state per order (``streaming.order_state``). Everything a run keeps is below one
# base folder: decisions and messages with the checkpoints of their queries. The same base again goes on from there.

def change_stream(spark: SparkSession, root: str, max_bytes: int = 512 << 20) -> DataFrame:
    return views.change_events(SimpleNamespace(events=table_stream(spark, root, "events", max_bytes)))


class _rocksdb:
    """While active, new streaming queries keep their state in RocksDB."""

    KEY = "spark.sql.streaming.stateStore.providerClass"

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.old = self.spark.conf.get(self.KEY, None)
        self.spark.conf.set(self.KEY, keyed.PROVIDER)

    def __exit__(self, *exc) -> None:
        if self.old is None:
            self.spark.conf.unset(self.KEY)
        else:
            self.spark.conf.set(self.KEY, self.old)


def _drain(stream: DataFrame, base: str, name: str) -> None:
    """Run a stream over all that is there, into ``base/name``."""
    with _rocksdb(stream.sparkSession):
        (stream.writeStream.trigger(availableNow=True).outputMode("append").format("parquet")
         .option("checkpointLocation", f"{base}/{name}-checkpoint").option("path", f"{base}/{name}")
         .start().awaitTermination())


def decide_into(spark: SparkSession, root: str, base: str, max_bytes: int = 512 << 20) -> None:
    """Drain the change stream: decisions into ``base/decisions``."""
    tx = views.transactions(Tables(spark, root), with_customer=False)
    _drain(keyed.decide_stream(change_stream(spark, root, max_bytes), tx), base, "decisions")


def decisions(spark: SparkSession, base: str) -> DataFrame:
    """Every request so far with its decision in force."""
    found = spark.read.schema(keyed.DECISION).parquet(f"{base}/decisions")
    return keyed.in_force(found).withColumn("reason", strip("reason"))


def late_requests(spark: SparkSession, base: str) -> DataFrame:
    """Requests that came in a later micro-batch than a later request of their order: the ones that
    may have changed earlier decisions."""
    return spark.read.schema(keyed.DECISION).parquet(f"{base}/decisions").where("late").select(
        "event_id", "order_id", "ts").distinct()


def order_state(decided: DataFrame, tx: DataFrame) -> DataFrame:
    """Current state of every order with at least one accepted change."""
    changed = decided.where("accepted").groupBy(F.col("order_id").alias("transaction_id")).agg(
        F.count(F.lit(1)).alias("accepted_changes"))
    return changes.apply_folds(tx, decided).join(changed, "transaction_id").select(
        "transaction_id", "void_status", "payment_status", "status", "accepted_changes")


def _removed(spark: SparkSession, base: str, result: DataFrame) -> DataFrame:
    """``result``, written, after the run's folders are removed."""
    out = checkpointed(result)
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out


def current_orders(spark: SparkSession, root: str, max_bytes: int = 512 << 20) -> DataFrame:
    """The state of the changed orders after a run over all available input."""
    base = _scratch(spark, "order_state")
    decide_into(spark, root, base, max_bytes)
    tx = views.transactions(Tables(spark, root), with_customer=False)
    return _removed(spark, base, order_state(decisions(spark, base), tx))


# --- ST-2: outbox -------------------------------------------------------------------

def outbox_into(spark: SparkSession, root: str, base: str) -> DataFrame:
    """Drain the decisions of ``base`` into messages, appended to ``base/outbox``; gives all messages so far.

    A message goes out when its request is first accepted, and once: later decisions on a request do not send
    again, a repeated decision row is dropped by its event id, and a restarted query goes on behind the rows it
    has read. What a late request makes of a message that is out already is for its reader to see in ``decisions``."""
    ready = (spark.readStream.schema(keyed.DECISION).parquet(f"{base}/decisions").where("first_ready")
             .withColumn("_sent_at", F.current_timestamp()).withWatermark("_sent_at", "1 hour")
             .dropDuplicatesWithinWatermark(["event_id"]))
    _drain(pickup_outbox(ready, views.transactions(Tables(spark, root)), views.system_config(spark)), base, "outbox")
    return spark.read.parquet(f"{base}/outbox")


def outbox(spark: SparkSession, root: str, max_bytes: int = 512 << 20) -> DataFrame:
    """All messages of a run over all available input."""
    base = _scratch(spark, "outbox")
    decide_into(spark, root, base, max_bytes)
    return _removed(spark, base, outbox_into(spark, root, base))
