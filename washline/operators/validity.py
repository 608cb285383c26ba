"""Validity windows: a code issued at time t is good until t + 10 minutes, once.

For every attempt, the code in force is the latest one issued to the same user
before the attempt (an as-of join); the attempt is valid when it falls inside that
code's window and no earlier valid attempt already used the code. Both steps are
running "previous value" steps over one cut of the events (``functions.running``),
so no pairs of rows are ever formed and no user is too large for a task. A NULL
user is a user like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from washline.functions.running import PART, attach, before, carry, crossing, cut, edge_rows

VALIDITY = "INTERVAL 10 MINUTES"
ORDER = ["ts", "event_id"]


def _code() -> Column:
    return F.when(F.col("_tok"), F.struct(F.col("event_id").alias("token_id"), F.col("ts").alias("issued_at")))


def _with_code(u: DataFrame, user: str) -> DataFrame:
    """The code in force before each row, and for attempts whether its window is open."""
    code = F.coalesce(F.last(_code(), ignorenulls=True).over(before([user], ORDER)), F.col("_code_in"))
    u = u.withColumn("_code", code)
    return (u.withColumn("token_id", F.col("_code.token_id")).withColumn("issued_at", F.col("_code.issued_at"))
            .withColumn("in_window", ~F.col("_tok") & F.col("token_id").isNotNull()
                        & (F.col("ts") < F.col("issued_at") + F.expr(VALIDITY))))


def _used() -> Column:
    return F.when(F.col("in_window"), F.col("token_id"))


def valid_window_join(issues: DataFrame, attempts: DataFrame, user: str = "user_id",
                      partitions: int | None = None) -> DataFrame:
    """``issues`` and ``attempts``: (user_id, event_id, ts). One row per attempt."""
    keys, at = [user], F.struct(*ORDER)
    u = cut(issues.select(user, "event_id", "ts", F.lit(True).alias("_tok"))
            .unionByName(attempts.select(user, "event_id", "ts", F.lit(False).alias("_tok"))),
            keys, ORDER, partitions)
    edge = edge_rows(u, crossing(u, keys), keys)
    codes = carry(edge.groupBy(PART, *keys).agg(F.max_by(_code(), F.when(F.col("_tok"), at)).alias("_b")),
                  keys, _code_in=lambda w: F.last("_b", ignorenulls=True).over(w))
    uses = carry(_with_code(attach(edge, codes, keys), user).groupBy(PART, *keys).agg(
        F.max_by(_used(), F.when(_used().isNotNull(), at)).alias("_b")),
        keys, _used_in=lambda w: F.last("_b", ignorenulls=True).over(w))
    a = _with_code(attach(attach(u, codes, keys), uses, keys), user)
    a = a.withColumn("_used", F.coalesce(F.last(_used(), ignorenulls=True).over(before(keys, ORDER)),
                                         F.col("_used_in"))).where(~F.col("_tok"))
    return a.select(F.col("event_id").alias("attempt_id"), user, "ts", "token_id", "issued_at",
                    (F.col("in_window") & F.coalesce(F.col("_used") != F.col("token_id"), F.lit(True)))
                    .alias("valid"))
