"""Pickup-ready messages: one row per accepted move to "Ready to Claim" of an order
with an e-mail address, subject and body filled from the configuration.

Sending is outside this library; the rows are the outbox a mailer would drain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from washline.operators.catalog import config_pivot
from washline.sources import schemas


def fill_template(template: Column, placeholders: list[tuple[str, Column]]) -> Column:
    """Replace each tag in turn (a later tag also replaces text an earlier value
    brought in), like successive ``str.replace`` calls."""
    out = template
    for tag, value in placeholders:
        out = F.replace(out, F.lit(tag), F.coalesce(value.cast("string"), F.lit("None")))
    return out


def pickup_outbox(annotated: DataFrame, tx: DataFrame, config: DataFrame) -> DataFrame:
    moves = annotated.where(F.col("accepted") & (F.col("action") == "Ready to Claim")).select(
        "event_id", F.col("order_id").alias("transaction_id"), "ts")
    orders = tx.where(F.col("customer_email").isNotNull() & (F.col("customer_email") != "")).select(
        "transaction_id", "display_id", "customer_name", "customer_email")
    cfg = config_pivot(config, ["pickup_ready_subject", "pickup_ready_body"])
    tags = [("{customer}", F.col("customer_name")), ("{order_id}", F.col("display_id"))]
    subject = F.coalesce(F.col("pickup_ready_subject"), F.lit(schemas.SUBJECT_DEFAULT))
    body = F.coalesce(F.col("pickup_ready_body"), F.lit(schemas.BODY_DEFAULT))
    return (moves.join(orders, "transaction_id")
            .crossJoin(F.broadcast(cfg))
            .select("event_id", "transaction_id",
                    F.col("customer_email").alias("receiver"),
                    fill_template(subject, tags).alias("subject"),
                    fill_template(body, tags).alias("body"),
                    F.col("ts").alias("queued_at")))
