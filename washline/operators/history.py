"""Order state over time: intervals from accepted requests, and the state at any time.

``intervals`` turns decided requests (``changes.annotate``) into rows (order, void, payment, status,
valid_from, valid_to): one from the start (valid_from NULL) for every order, and one from each accepted
request on, up to the next; requests at one instant leave the state after the last of them.
``state_at`` gives the state of an order at any number of times.

Both are running values over a range cut of (order, time): the state is what the last accepted request
before left, the end of an interval the next request's time (the same pass, run backwards). No pairs of
rows are formed, an order may hold any share of them, and NULL is a key like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from washline.functions.running import running

STATE = ["void_status", "payment_status", "status"]


def states_after(annotated: DataFrame) -> DataFrame:
    """The state each accepted request that changes the order's state leaves: order_id, ts, event_id,
    void_status, payment_status, status."""
    def new(kind: str, before: str) -> Column:
        return F.when(F.col("kind") == kind, F.col("new_value")).otherwise(F.col(before))

    return annotated.where(F.col("accepted") & F.col("kind").isin("void", "payment", "status")).select(
        "order_id", "ts", "event_id", new("void", "void_before").alias("void_status"),
        new("payment", "paid_before").alias("payment_status"), new("status", "status_before").alias("status"))


def _starts(tx: DataFrame) -> DataFrame:
    """The state of every order before any request."""
    return tx.select(F.col("transaction_id").alias("order_id"), F.lit(None).cast("timestamp_ntz").alias("ts"),
                     F.lit(None).cast("bigint").alias("event_id"), *STATE)


def intervals(annotated: DataFrame, tx: DataFrame, partitions: int | None = None) -> DataFrame:
    """transaction_id, void_status, payment_status, status, valid_from (NULL: from the start) and valid_to
    (NULL: still valid), half open. ``tx`` are the orders before any request."""
    rows = _starts(tx).unionByName(states_after(annotated))
    # backwards in time, so that "the last row before" is the next request
    back = rows.withColumn("_rts", -F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("_rid", -F.col("event_id"))
    back = back.withColumn("_open", F.col("ts").isNull())
    nexts = running(back, ["order_id"], ["_open", "_rts", "_rid"], lasts={"valid_to": F.col("ts")},
                    partitions=partitions)
    return nexts.where(F.col("valid_to").isNull() | F.col("ts").isNull() | (F.col("ts") < F.col("valid_to"))).select(
        F.col("order_id").alias("transaction_id"), *STATE, F.col("ts").alias("valid_from"), "valid_to")


def state_at(annotated: DataFrame, tx: DataFrame, times: DataFrame, partitions: int | None = None) -> DataFrame:
    """The state of each row of ``times`` (probe_id, order_id, at; probe_id unique): its order's state after
    all requests up to and at that time. Unknown orders and rows without a time have no state."""
    moves = _starts(tx).unionByName(states_after(annotated)).select(
        "order_id", "ts", F.lit(0).alias("_probe"), F.col("event_id").alias("_id"), F.struct(*STATE).alias("_state"))
    asked = times.where(F.col("at").isNotNull()).select(
        "order_id", F.col("at").alias("ts"), F.lit(1).alias("_probe"), F.col("probe_id").alias("_id"),
        F.lit(None).cast(moves.schema["_state"].dataType).alias("_state"))
    # NULL sorts first: the start of an order comes before its requests, and requests before probes at their time
    seen = running(moves.unionByName(asked), ["order_id"], ["ts", "_probe", "_id"], lasts={"_now": F.col("_state")},
                   partitions=partitions).where(F.col("_probe") == 1)
    out = seen.select(F.col("_id").alias("probe_id"), "order_id", F.col("ts").alias("at"),
                      *[F.col(f"_now.{c}").alias(c) for c in STATE])
    untimed = times.where(F.col("at").isNull()).select(
        "probe_id", "order_id", "at", *[F.lit(None).cast("string").alias(c) for c in STATE])
    return out.unionByName(untimed)
