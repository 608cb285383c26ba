"""Folding order change requests into order state, with the guards of the order
screens, and the audit rows of accepted changes.

Requests (one row each, ordered by (ts, event_id) per order):

* ``VOID`` (needs a non-blank reason) and ``REVERT_VOID``: Admin only. Voiding a
  voided order or reverting an active one is refused, so the first reason after
  the last revert stays.
* ``PAY``: an Admin toggles Paid/Unpaid; Staff may only move Unpaid -> Paid.
* ``Ready to Claim`` / ``Claimed``: only while Paid; a move to the current status
  is a no-op; Claimed is terminal.
* ``EDIT_LINE``, ``ADD_LINE`` and ``DELETE_LINE``: an Admin, or Staff while Unpaid. Only the guard is
  decided here; what they do to lines is ``operators.edits``.
* No payment, status or line change on an order that is voided at that moment, or whose
  status is Claimed.

The rules form an acyclic chain (void <- nothing; payment <- void; status <- void,
payment), so the fold is three "previous value" computations per order:

1. void state before each request = target of the last kept void/revert request;
2. payment state before each request: Admin toggles counted since the last Staff
   request (payment resets to Paid there), by parity;
3. status before each request and whether a Claimed move was accepted earlier.

All three run over one cut of the requests (``functions.running``): ordinary windows
inside a range partition, and for the orders that cross a partition's edge a small
carry of void state, payment and status from one partition to the next. One order may
hold any share of the requests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from washline.functions.formatting import is_blank, strip
from washline.functions.running import PART, attach, before, carry, crossing, cut, edge_rows, running

ORDER = ["ts", "event_id"]
KEYS = ["order_id"]
STATUS_ACTIONS = ("Ready to Claim", "Claimed")
EDIT_ACTIONS = ("EDIT_LINE", "ADD_LINE", "DELETE_LINE")


def _flip(c: Column) -> Column:
    return F.when(c == "Paid", "Unpaid").otherwise("Paid")


def _action() -> Column:
    return F.col("action")


def _void_kind() -> Column:
    return _action().isin("VOID", "REVERT_VOID")


def _target_v() -> Column:
    """Void state a kept void/revert request sets (NULL for every other request)."""
    kept = _void_kind() & F.col("is_admin") & ((_action() == "REVERT_VOID") | ~is_blank("reason"))
    return F.when(kept, F.when(_action() == "VOID", "Voided").otherwise("Active"))


def _base_open() -> Column:
    return F.coalesce(F.col("base_status") != "Claimed", F.lit(True))


def _valid() -> Column:
    return _action().isin("PAY", *STATUS_ACTIONS) & (F.col("void_before") == "Active") & _base_open()


def _candidate() -> Column:
    return F.col("_valid") & _action().isin(*STATUS_ACTIONS) & (F.col("paid_before") == "Paid")


def _paid(flips: Column, anchor: Column) -> Column:
    """Payment before a request from the Admin flips before it and that count at the
    last Staff request before it (NULL when none)."""
    return (F.when(anchor.isNotNull(),
                   F.when((flips - anchor) % 2 == 0, F.lit("Paid")).otherwise(F.lit("Unpaid")))
             .otherwise(F.when(flips % 2 == 0, F.col("base_pay")).otherwise(_flip(F.col("base_pay")))))


def _with_void(ev: DataFrame) -> DataFrame:
    """Void state before each request, and whether it may change payment or status."""
    last = F.last(_target_v(), ignorenulls=True).over(before(KEYS, ORDER))
    return ev.withColumn("void_before", F.coalesce(last, F.col("_void_in"), F.col("base_void"))
                         ).withColumn("_valid", _valid())


def _pay() -> Column:
    return F.col("_valid") & (_action() == "PAY")


def _with_flips(ev: DataFrame) -> DataFrame:
    """Admin flips before each request inside its partition, and that count at the last Staff one."""
    w = before(KEYS, ORDER)
    ev = ev.withColumn("_flips", F.coalesce(
        F.sum(F.when(_pay() & F.col("is_admin"), 1).otherwise(0)).over(w), F.lit(0)))
    return ev.withColumn("_anchor", F.last(F.when(_pay() & ~F.col("is_admin"), F.col("_flips")),
                                           ignorenulls=True).over(w))


def _with_paid(ev: DataFrame) -> DataFrame:
    """Payment state before each request: parity of the flips since the last Staff request."""
    come = F.coalesce(F.col("_flips_in"), F.lit(0))
    flips = come + F.col("_flips")
    anchor = F.coalesce(come + F.col("_anchor"), F.col("_anchor_in"))
    return ev.withColumn("paid_before", _paid(flips, anchor))


def state_before(ev: DataFrame, partitions: int | None = None, stored: bool = True) -> DataFrame:
    """``ev`` with the state before each request: void_before, paid_before, _status_prev and
    _claimed_prev (status and whether a Claimed move was accepted earlier). ``stored``: see ``crossing``."""
    at = F.struct(*ORDER)
    rows = cut(ev, KEYS, ORDER, partitions)
    edge = edge_rows(rows, crossing(rows, KEYS, stored), KEYS)

    voids = carry(edge.groupBy(PART, *KEYS).agg(
        F.max_by(_target_v(), F.when(_target_v().isNotNull(), at)).alias("_b")),
        KEYS, stored, _void_in=lambda w: F.last("_b", ignorenulls=True).over(w))
    edge = _with_flips(_with_void(attach(edge, voids, KEYS)))

    staff = _pay() & ~F.col("is_admin")
    pays = carry(edge.groupBy(PART, *KEYS).agg(
        F.sum(F.when(_pay() & F.col("is_admin"), 1).otherwise(0)).alias("_n"),
        F.max_by("_flips", F.when(staff, at)).alias("_staff")),
        KEYS, stored, _flips_in=lambda w: F.coalesce(F.sum("_n").over(w), F.lit(0)),
        _anchor_in=lambda w: F.last(F.col("_flips_in") + F.col("_staff"), ignorenulls=True).over(w))
    edge = _with_paid(attach(edge, pays, KEYS))

    moves = carry(edge.groupBy(PART, *KEYS).agg(
        F.max_by(F.when(_candidate(), _action()), F.when(_candidate(), at)).alias("_b"),
        F.max(F.when(_candidate() & (_action() == "Claimed"), F.lit(True))).alias("_c")),
        KEYS, stored, _status_in=lambda w: F.last("_b", ignorenulls=True).over(w),
        _claimed_in=lambda w: F.max("_c").over(w))

    out = attach(attach(attach(rows, voids, KEYS), pays, KEYS), moves, KEYS)
    out = _with_paid(_with_flips(_with_void(out)))
    w = before(KEYS, ORDER)
    status = F.last(F.when(_candidate(), _action()), ignorenulls=True).over(w)
    claimed = F.last(F.when(_candidate() & (_action() == "Claimed"), F.lit(True)), ignorenulls=True).over(w)
    return (out.withColumn("_status_prev", F.coalesce(status, F.col("_status_in")))
            .withColumn("_claimed_prev", F.coalesce(claimed, F.col("_claimed_in")))
            .drop(PART, "_flips", "_anchor", "_void_in", "_flips_in", "_anchor_in", "_status_in",
                  "_claimed_in"))


def annotate(changes: DataFrame, tx: DataFrame, partitions: int | None = None, stored: bool = True) -> DataFrame:
    """Every change request with the order state before it, its acceptance, the
    reason for a refusal, and the old/new value it writes.

    ``changes``: event_id, ts, order_id, action, actor_id, is_admin, reason.
    ``tx``: the orders before any request (transaction_id, status, payment_status,
    void_status, and display_id if there is one). Requests for unknown orders, or without
    an order, are refused (``unknown_order``).
    """
    base = tx.select(F.col("transaction_id").alias("_base_id"),
                     F.col("status").alias("base_status"),
                     F.col("payment_status").alias("base_pay"),
                     F.col("void_status").alias("base_void"),
                     (F.col("display_id") if "display_id" in tx.columns
                      else F.concat(F.lit("ORD-"), F.col("transaction_id").cast("string"))).alias("display_id"))
    ev = changes.join(base, changes["order_id"] == base["_base_id"], "left")
    return _decide(state_before(ev, partitions, stored))


def _decide(ev: DataFrame) -> DataFrame:
    action, is_void_kind, base_open = _action(), _void_kind(), _base_open()
    is_edit = action.isin(*EDIT_ACTIONS)
    after_claim = F.coalesce(F.col("_claimed_prev"), F.lit(False))
    # a Claimed order is Paid, and neither changes any more
    ev = (ev.withColumn("status_before", F.when(after_claim, "Claimed").otherwise(
              F.coalesce("_status_prev", "base_status")))
          .withColumn("paid_before", F.when(after_claim, "Paid").otherwise(F.col("paid_before"))))

    reject = (
        F.when(F.col("_base_id").isNull(), "unknown_order")
         .when(is_void_kind & ~F.col("is_admin"), "not_admin")
         .when((action == "VOID") & is_blank("reason"), "blank_reason")
         .when((action == "VOID") & (F.col("void_before") == "Voided"), "already_voided")
         .when((action == "REVERT_VOID") & (F.col("void_before") == "Active"), "not_voided")
         .when(is_void_kind, F.lit(None))
         .when(~base_open | after_claim, "order_claimed")
         .when(F.col("void_before") == "Voided", "order_voided")
         .when(((action == "PAY") | is_edit) & ~F.col("is_admin") & (F.col("paid_before") == "Paid"),
               "staff_on_paid")
         .when(is_edit | (action == "PAY"), F.lit(None))
         .when(F.col("paid_before") != "Paid", "unpaid")
         .when(action == F.col("status_before"), "no_change")
    )
    kind = (F.when(is_void_kind, "void").when(action == "PAY", "payment").when(is_edit, "edit")
            .otherwise("status"))
    old_value = (F.when(is_void_kind, F.col("void_before"))
                  .when(action == "PAY", F.col("paid_before"))
                  .when(is_edit, F.lit(None))
                  .otherwise(F.col("status_before")))
    new_value = (F.when(action == "VOID", "Voided").when(action == "REVERT_VOID", "Active")
                  .when(action == "PAY", F.when(F.col("is_admin"), _flip(F.col("paid_before")))
                                          .otherwise(F.lit("Paid")))
                  .when(~is_edit, action))
    return ev.select(
        "event_id", "ts", "order_id", "action", "actor_id", "is_admin",
        strip("reason").alias("reason"),
        kind.alias("kind"), reject.isNull().alias("accepted"), reject.alias("reject_reason"),
        old_value.alias("old_value"), new_value.alias("new_value"),
        "base_status", "base_pay", "base_void", "display_id",
        "void_before", "paid_before", "status_before",
    )


def void_decisions(changes: DataFrame, tx: DataFrame, partitions: int | None = None) -> DataFrame:
    """The decisions on VOID and REVERT_VOID requests only: nothing else changes void state, so the other
    requests, payment and status are left out from the start. Same columns as ``annotate`` as far as
    ``fold_voids`` needs them."""
    base = tx.select(F.col("transaction_id").alias("_base_id"), F.col("void_status").alias("base_void"))
    asked = changes.where(_void_kind()).select("event_id", "ts", "order_id", "action", "is_admin", "reason")
    ev = asked.join(base, asked["order_id"] == base["_base_id"], "left")
    ev = running(ev, KEYS, ORDER, lasts={"_last": _target_v()}, partitions=partitions)
    before_it = F.coalesce("_last", "base_void")
    target = F.when(_action() == "VOID", "Voided").otherwise("Active")
    return ev.select(
        "event_id", "ts", "order_id", strip("reason").alias("reason"), F.lit("void").alias("kind"),
        target.alias("new_value"),
        (F.col("_base_id").isNotNull() & _target_v().isNotNull() & F.coalesce(before_it != target, F.lit(True)))
        .alias("accepted"))


def _per_order_last(acc: DataFrame, fields: list[str]) -> DataFrame:
    """Last accepted change per order, as a partial aggregate (no hot-key window)."""
    return acc.groupBy("order_id").agg(
        F.max_by(F.struct(*fields), F.struct(*ORDER)).alias("_last"),
        F.count(F.lit(1)).alias("accepted_changes"))


def fold_voids(annotated: DataFrame) -> DataFrame:
    """Orders whose void state changed: final void status, reason and time."""
    acc = annotated.where(F.col("accepted") & (F.col("kind") == "void"))
    last = _per_order_last(acc, ["new_value", "reason", "ts"])
    voided = F.col("_last.new_value") == "Voided"
    return last.select(
        F.col("order_id").alias("transaction_id"),
        F.col("_last.new_value").alias("void_status"),
        F.when(voided, F.col("_last.reason")).alias("void_reason"),
        F.when(voided, F.col("_last.ts")).alias("void_at"),
        "accepted_changes")


def fold_payment_toggles(annotated: DataFrame) -> DataFrame:
    acc = annotated.where(F.col("accepted") & (F.col("kind") == "payment"))
    last = _per_order_last(acc, ["new_value"])
    return last.select(F.col("order_id").alias("transaction_id"),
                       F.col("_last.new_value").alias("payment_status"), "accepted_changes")


def fold_status_changes(annotated: DataFrame) -> DataFrame:
    acc = annotated.where(F.col("accepted") & (F.col("kind") == "status"))
    last = _per_order_last(acc, ["new_value"])
    return last.select(F.col("order_id").alias("transaction_id"),
                       F.col("_last.new_value").alias("status"), "accepted_changes")


def transition_guard(annotated: DataFrame) -> DataFrame:
    return annotated.select("event_id", F.col("order_id").alias("transaction_id"), "action",
                            "kind", "accepted", "reject_reason")


def audit_rows(annotated: DataFrame) -> DataFrame:
    """One audit row per accepted change, as the screens log them (old and new
    values filled in as well)."""
    acc = annotated.where("accepted")
    display, action = F.col("display_id"), F.col("action")
    description = (
        F.when(action == "VOID", F.concat(F.lit("Voided "), display, F.lit(". Reason: "), F.col("reason")))
         .when(action == "REVERT_VOID", F.concat(F.lit("Reverted void on "), display, F.lit(".")))
         .when(action == "PAY", F.concat(F.lit("Payment: "), F.col("new_value")))
         .otherwise(F.concat(F.lit("Status: "), F.col("new_value"))))
    return acc.select(
        F.col("event_id").alias("log_id"),
        F.col("actor_id").alias("user_id"),
        F.when(action.isin("VOID", "REVERT_VOID"), action).otherwise(F.lit("UPDATE")).alias("action_type"),
        F.lit("Transaction").alias("entity_type"),
        F.col("order_id").alias("entity_id"),
        description.alias("description"),
        "old_value", "new_value",
        F.col("ts").alias("timestamp"))


def login_audit_rows(logins: DataFrame) -> DataFrame:
    """One audit row per successful login (user_id, event_id, ts)."""
    none = F.lit(None).cast("string")
    return logins.select(
        F.col("event_id").alias("log_id"), "user_id", F.lit("LOGIN").alias("action_type"),
        F.lit("User").alias("entity_type"), F.col("user_id").alias("entity_id"),
        F.lit("Successful login").alias("description"), none.alias("old_value"),
        none.alias("new_value"), F.col("ts").alias("timestamp"))


def apply_folds(tx: DataFrame, annotated: DataFrame) -> DataFrame:
    """Current orders: base rows overridden by the last accepted void, payment and
    status change (three per-order aggregates joined back on the key)."""
    v = fold_voids(annotated).drop("accepted_changes")
    p = fold_payment_toggles(annotated).drop("accepted_changes")
    s = fold_status_changes(annotated).drop("accepted_changes")
    out = (tx.join(v.withColumnRenamed("void_status", "_vs").withColumnRenamed("void_reason", "_vr")
                   .withColumnRenamed("void_at", "_va"), "transaction_id", "left")
           .join(p.withColumnRenamed("payment_status", "_ps"), "transaction_id", "left")
           .join(s.withColumnRenamed("status", "_st"), "transaction_id", "left"))
    changed_void = F.col("_vs").isNotNull()

    def old(c: str) -> Column:
        return F.col(c) if c in tx.columns else F.lit(None).cast("string" if c == "void_reason" else "timestamp_ntz")

    return out.select(
        *[c for c in tx.columns if c not in ("status", "payment_status", "void_status",
                                             "void_reason", "void_at")],
        F.coalesce("_st", "status").alias("status"),
        F.coalesce("_ps", "payment_status").alias("payment_status"),
        F.when(changed_void, F.col("_vs")).otherwise(F.col("void_status")).alias("void_status"),
        F.when(changed_void, F.col("_vr")).otherwise(old("void_reason")).alias("void_reason"),
        F.when(changed_void, F.col("_va")).otherwise(old("void_at")).alias("void_at"),
    )


__all__ = ["annotate", "apply_folds", "audit_rows", "fold_payment_toggles", "fold_status_changes",
           "fold_voids", "transition_guard"]
