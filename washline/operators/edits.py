"""Line edits on orders: a fold over two levels.

Requests (event_id, ts, order_id, action, actor_id, is_admin, batch_id, service_id, weight):

* ``EDIT_LINE`` puts another service and weight on a line, with loads and subtotal at the current
  price (add-on money is not part of it and the stored unit price stays, as in the edit form);
* ``ADD_LINE`` adds a line (id ``new-<event_id>``, category 1);
* ``DELETE_LINE`` takes a line out.

Level one is the order: a request passes while the order is known, not voided, not Claimed, and
Unpaid unless an Admin asks. That is the fold of ``changes`` over all requests together.

Level two is the lines. A line must be there, the service must be an active one, and the weight must
be that of the order's first line (the lowest id among those that are there). Accepted edits
therefore never change the first line's weight; it changes only when the first line is deleted. So the
life of an order falls into epochs, each with one first line, found from the lines' deletion times by
a running maximum in the order of line ids, and after the last base line an epoch of added lines. All
requests of an epoch are decided at once as soon as its weight is known: the weight the last accepted
edit before the epoch left on its first line, or the stored one. Rounds repeat until no epoch is open;
there are more than two only where a first line had itself been edited to the weight of an earlier
first line, and so on.

Every step is a join, a partial aggregate or a running value over a range cut, so that one order may
hold any share of the lines and requests.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from washline.functions.running import running, written
from washline.operators import changes
from washline.operators.catalog import kg_per_load

EDIT_ACTIONS = changes.EDIT_ACTIONS
WEIGHT, MONEY = "decimal(8,2)", "decimal(10,2)"
AT = "struct<ts:timestamp_ntz,event_id:bigint>"
#: Later than any request.
END = "named_struct('ts', TIMESTAMP_NTZ '9999-12-31 23:59:59', 'event_id', CAST(9223372036854775807 AS BIGINT))"
#: The category an added line gets.
ADDED_CATEGORY = 1


@dataclass
class Edited:
    """The decisions on edit requests and what they make of lines and totals."""

    requests: DataFrame  # event_id, order_id, action, batch_id, accepted, reject_reason
    lines: DataFrame  # the columns of the given lines
    totals: DataFrame  # transaction_id, total_amount


def _at() -> Column:
    return F.struct("ts", "event_id")


def _added(order: str = "order_id") -> Column:
    """The epoch of an order after its last base line."""
    return F.concat(F.lit("+"), F.coalesce(F.col(order).cast("string"), F.lit("")))


def _epochs(lines: DataFrame, deletes: DataFrame, orders: DataFrame, partitions: int | None) -> DataFrame:
    """epoch_id, order_id, from_at (NULL: from the start) and base_weight of each epoch of ``orders``."""
    gone = deletes.groupBy("batch_id").agg(F.min(_at()).alias("del_at"))
    lives = lines.join(gone, "batch_id", "left").withColumn("_end", F.coalesce("del_at", F.expr(END)))
    stairs = running(lives, ["order_id"], ["batch_id"], maxs={"_before": F.col("_end")}, partitions=partitions)
    first = stairs.where(F.col("_before").isNull() | (F.col("_before") < F.col("_end"))).select(
        F.col("batch_id").alias("epoch_id"), "order_id", F.col("_before").alias("from_at"),
        F.col("weight").alias("base_weight"))
    last = lives.groupBy("order_id").agg(F.max("_end").alias("_end"))
    bare = orders.join(last, "order_id", "left").where(F.col("_end").isNull() | (F.col("_end") < F.expr(END)))
    return first.unionByName(bare.select(
        _added().alias("epoch_id"), "order_id", F.col("_end").alias("from_at"),
        F.lit(None).cast(WEIGHT).alias("base_weight")))


def _with_epoch(asked: DataFrame, epochs: DataFrame, partitions: int | None) -> DataFrame:
    """``asked`` with the epoch each request falls in: the last that began before it."""
    start = F.coalesce(F.col("from_at"), F.expr("named_struct('ts', TIMESTAMP_NTZ '0001-01-01 00:00:00', "
                                                "'event_id', CAST(-9223372036854775808 AS BIGINT))"))
    rows = (asked.select("*", F.lit(None).cast("string").alias("_epoch"), F.lit(0).alias("_kind"))
            .unionByName(epochs.select("order_id", start["ts"].alias("ts"), start["event_id"].alias("event_id"),
                                       F.col("epoch_id").alias("_epoch"), F.lit(1).alias("_kind")),
                         allowMissingColumns=True))
    # an epoch begins with the request that ended the one before, so it counts after that request
    placed = running(rows, ["order_id"], ["ts", "event_id", "_kind", "_epoch"], lasts={"epoch_id": F.col("_epoch")},
                     partitions=partitions)
    return placed.where(F.col("_kind") == 0).drop("_kind", "_epoch")


def _settle(asked: DataFrame, epochs: DataFrame) -> DataFrame:
    """The weight of every epoch that has requests: epoch_id, first_weight.

    ``asked``: EDIT_LINE and ADD_LINE requests that only their weight can refuse (event_id, ts, target,
    epoch_id, weight), target being the epoch whose first line they touch."""
    start = epochs.select(F.col("epoch_id").alias("target"), "from_at")
    # what an epoch's weight may depend on: requests on its first line from before it
    prior = asked.join(start, "target").where(_at() <= F.col("from_at")).select(
        "target", "epoch_id", "ts", "event_id", "weight")
    prior = written(prior, "edits-prior")
    opening = asked.where(F.col("epoch_id") == F.col("target")).where(F.col("epoch_id").startswith("+")).groupBy(
        "epoch_id").agg(F.min_by("weight", _at()).alias("_opening"))
    needed = asked.select("epoch_id").distinct()
    state = epochs.join(needed, "epoch_id", "left_semi").join(opening, "epoch_id", "left").select(
        "epoch_id", F.coalesce("base_weight", "_opening").alias("_plain"),
        F.lit(None).cast(WEIGHT).alias("first_weight"), F.lit(False).alias("known"))
    state = written(state, "edits-state")
    while True:
        seen = state.where("known").select("epoch_id", "first_weight", F.lit(True).alias("_seen"))
        told = prior.join(seen, "epoch_id", "left")
        accepted = F.col("weight") == F.col("first_weight")
        added = F.col("target").startswith("+")
        facts = told.groupBy(F.col("target").alias("epoch_id")).agg(
            F.count(F.when(F.col("_seen").isNull(), 1)).alias("_open"),
            # the last edit of a line counts, but the first of the added lines
            F.max_by("weight", F.when(accepted & ~added, _at())).alias("_last"),
            F.min_by("weight", F.when(accepted & added, _at())).alias("_first"))
        ready = F.coalesce(F.col("_open"), F.lit(0)) == 0
        state = written(state.join(facts, "epoch_id", "left").select(
            "epoch_id", "_plain",
            F.when(F.col("known"), F.col("first_weight"))
             .when(ready, F.coalesce("_last", "_first", "_plain")).alias("first_weight"),
            (F.col("known") | ready).alias("known")), "edits-state")
        if state.where(~F.col("known")).isEmpty():
            return state.select("epoch_id", "first_weight")


def _judged(edits: DataFrame, changes_log: DataFrame, tx: DataFrame, partitions: int | None) -> DataFrame:
    """``edits`` with the reason for which the order's state refuses them (NULL: it does not)."""
    cols = ["event_id", "ts", "order_id", "action", "actor_id", "is_admin"]
    log = changes_log.select(*cols, "reason").unionByName(
        edits.select(*cols, F.lit(None).cast("string").alias("reason")))
    decided = changes.annotate(log, tx, partitions).where(F.col("kind") == "edit").select(
        F.col("event_id").alias("_id"), F.col("reject_reason").alias("order_reason"))
    return edits.join(decided, edits["event_id"] == F.col("_id")).drop("_id")


def apply_edits(lines: DataFrame, tx: DataFrame, services: DataFrame, changes_log: DataFrame, edits: DataFrame,
                config: DataFrame | None = None, partitions: int | None = None) -> Edited:
    """Decide ``edits`` and apply the accepted ones.

    ``lines``: batch_id, transaction_id, service_id, category_id, load_count, weight, price_per_unit,
    subtotal. ``tx``: the orders before any request (with total_amount). ``services``: service_id,
    price_per_load, status. Event ids are unique over ``changes_log`` and ``edits``."""
    spark = lines.sparkSession
    limit = (F.broadcast(kg_per_load(config)) if config is not None
             else spark.range(1).select(F.lit(7).cast(WEIGHT).alias("kg_per_load")))
    judged = written(_judged(
        edits.withColumn("weight", F.col("weight").cast(WEIGHT)), changes_log, tx, partitions), "edits-judged")
    # written, so that its size is known before the lines meet it: they are shuffled only where it is large
    orders = written(judged.select("order_id").distinct(), "edits-orders")
    base = lines.select("batch_id", F.col("transaction_id").alias("order_id"),
                        F.col("weight").cast(WEIGHT).alias("weight"))
    base = written(base.join(orders, "order_id", "left_semi"), "edits-base")
    mine = base.select("batch_id", F.col("order_id").alias("_line_order"))
    prices = services.where(F.col("status") == "Active").select(
        F.col("service_id").alias("_sid"), F.col("price_per_load").alias("_price"))
    known = (judged.join(mine, "batch_id", "left").join(prices, F.col("service_id") == F.col("_sid"), "left")
             .withColumn("_here", F.col("_line_order").isNotNull() & F.col("_line_order").eqNullSafe(F.col("order_id"))))
    passes = F.col("order_reason").isNull()
    deletes = known.where(passes & (F.col("action") == "DELETE_LINE") & F.col("_here"))
    gone = written(deletes.groupBy("batch_id").agg(F.min(_at()).alias("del_at")), "edits-gone")
    known = known.join(gone, "batch_id", "left")
    on_line = F.col("action").isin("EDIT_LINE", "DELETE_LINE")
    # the request that deletes a line still finds it; what comes later does not
    there = F.col("_here") & (F.col("del_at").isNull() | (_at() <= F.col("del_at")))
    plain = (F.when(F.col("order_reason").isNotNull(), F.col("order_reason"))
             .when(on_line & ~there, "no_line")
             .when((F.col("action") != "DELETE_LINE") & F.col("weight").isNull(), "no_weight")
             .when((F.col("action") != "DELETE_LINE") & F.col("_price").isNull(), "no_service"))
    known = written(known.withColumn("_reason", plain).drop("_sid", "_line_order", "_here", "order_reason", "del_at"),
                    "edits-known")
    epochs = written(_epochs(base, deletes.select("batch_id", "ts", "event_id"), orders, partitions), "edits-epochs")
    weighed = known.where(F.col("_reason").isNull() & F.col("action").isin("EDIT_LINE", "ADD_LINE")).select(
        "event_id", "ts", "order_id", "weight",
        F.when(F.col("action") == "ADD_LINE", _added()).otherwise(F.col("batch_id")).alias("target"))
    weighed = written(_with_epoch(weighed, epochs, partitions), "edits-weighed")
    first = _settle(weighed, epochs)
    verdict = weighed.join(first, "epoch_id", "left").select(
        F.col("event_id").alias("_id"), F.coalesce(F.col("weight") == F.col("first_weight"), F.lit(False)).alias("_fits"))
    decided = known.join(verdict, F.col("event_id") == F.col("_id"), "left")
    reason = F.coalesce(F.col("_reason"), F.when(~F.col("_fits"), "weight_differs"))
    decided = written(decided.withColumn("reject_reason", reason).drop("_reason", "_id", "_fits"), "edits-decided")
    taken = decided.where(F.col("reject_reason").isNull()).crossJoin(limit)
    loads = F.ceil(F.col("weight") / F.col("kg_per_load")).cast("long")
    taken = taken.withColumn("_loads", loads).withColumn("_sub", (F.col("_loads") * F.col("_price")).cast(MONEY))

    last = written(_last_edits(taken), "edits-last")
    marks = written(last.select(F.xxhash64("_b").alias("_mark")).distinct(), "edits-marks")
    final = _final_lines(lines, taken, last, marks)
    touched = written(taken.groupBy(F.col("order_id").alias("_o")).agg(F.lit(True).alias("_touched")), "edits-touched")
    # only the touched orders are summed
    mine = lines.join(touched, F.col("transaction_id") == F.col("_o"), "left_semi")
    sums = _final_lines(mine, taken, last, marks).groupBy(F.col("transaction_id").alias("_s")).agg(
        F.sum("subtotal").alias("_sum"))
    totals = (tx.select("transaction_id", "total_amount").join(touched, F.col("transaction_id") == F.col("_o"), "left")
              .join(sums, F.col("transaction_id") == F.col("_s"), "left")
              .select("transaction_id", F.when(F.col("_touched"), F.coalesce(F.col("_sum"), F.lit(0)))
                      .otherwise(F.col("total_amount")).alias("total_amount")))
    return Edited(decided.select("event_id", "order_id", "action", "batch_id",
                                 F.col("reject_reason").isNull().alias("accepted"), "reject_reason"), final, totals)


def _last_edits(taken: DataFrame) -> DataFrame:
    """Per line id (``_b``) whether it is deleted and what its last edit makes of it."""
    return taken.where(F.col("action") != "ADD_LINE").groupBy(F.col("batch_id").alias("_b")).agg(
        F.max(F.col("action") == "DELETE_LINE").alias("_gone"),
        F.max_by(F.struct("service_id", "weight", F.col("_loads").alias("load_count"), F.col("_sub").alias("subtotal")),
                 F.when(F.col("action") == "EDIT_LINE", _at())).alias("_new"))


def _final_lines(lines: DataFrame, taken: DataFrame, last: DataFrame, marks: DataFrame) -> DataFrame:
    """Base lines without the deleted ones, edited ones with their last edit, and added ones.

    Few lines are edited, so only those whose id has a hash of an edited one (``marks``) meet the edits (``last``)
    by their id; the others stay as they are, without a shuffle by id."""
    kinds = {c: t for c, t in lines.dtypes}
    new = {c: F.coalesce(F.col(f"_new.{c}").cast(kinds[c]), F.col(c)).alias(c)
           for c in ("service_id", "weight", "load_count", "subtotal")}
    marked = F.xxhash64("batch_id") == F.col("_mark")
    kept = (lines.join(marks, marked, "left_semi").join(last, F.col("batch_id") == F.col("_b"), "left")
            .where(~F.coalesce(F.col("_gone"), F.lit(False)))
            .select(*[new.get(c, F.col(c)).cast(kinds[c]).alias(c) for c in lines.columns])
            .unionByName(lines.join(marks, marked, "left_anti")))
    made = {"batch_id": F.concat(F.lit("new-"), F.col("event_id").cast("string")), "transaction_id": F.col("order_id"),
            "service_id": F.col("service_id"), "category_id": F.lit(ADDED_CATEGORY), "weight": F.col("weight"),
            "load_count": F.col("_loads"), "price_per_unit": F.col("_price"), "subtotal": F.col("_sub"),
            "created_at": F.col("ts")}
    added = taken.where(F.col("action") == "ADD_LINE").select(*[
        made.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in lines.columns])
    return kept.unionByName(added)
