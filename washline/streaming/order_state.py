"""Order state kept by a stateful operator: one state per order in RocksDB.

Requests stream in, in any order and cut. For each order the operator holds its state as of the last
request it has seen, and the requests it has decided with the state each left. A request later than all
before it is decided from the order's state alone. A late one takes the order back to the state before it:
only this order's later requests are decided again, and only decisions that change go out again. So a
micro-batch reads and writes the states of the orders it touches and nothing else, however long the
stream has run; a restarted query goes on from the saved states.

Decisions go out as rows with a revision per order; the highest revision of a request is in force
(``in_force``). ``first_ready`` is true on the one row with which a request to mark an order ready was accepted for
the first time, so messages sent on it are sent once, whatever is decided again later. A request that
comes twice (the same time and id) counts once. Orders begin in the state of the orders table, which is read
once, as initial state; requests for orders that are not there are refused, also those without an order.

The rules are those of ``operators.changes``, one request at a time (``decide``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE = "void string, payment string, status string"
DECISION = ("event_id bigint, order_id bigint, ts timestamp_ntz, action string, is_admin boolean, reason string, "
            "kind string, accepted boolean, reject_reason string, new_value string, late boolean, "
            "first_ready boolean, revision bigint")
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
READY = "Ready to Claim"


def decide(state: tuple[str, str, str], action: str, is_admin: bool, reason: str | None
           ) -> tuple[tuple[str, str, str], str | None, str | None]:
    """(state after, reason of the refusal or None, value written) of one request."""
    void, payment, status = state
    if action in ("VOID", "REVERT_VOID"):
        why = ("not_admin" if not is_admin else
               "blank_reason" if action == "VOID" and not (reason or "").strip() else
               "already_voided" if action == "VOID" and void == "Voided" else
               "not_voided" if action == "REVERT_VOID" and void == "Active" else None)
        new = "Voided" if action == "VOID" else "Active"
        return (state if why else (new, payment, status)), why, new
    why = "order_claimed" if status == "Claimed" else "order_voided" if void == "Voided" else None
    if action == "PAY":
        why = why or ("staff_on_paid" if not is_admin and payment == "Paid" else None)
        new = "Paid" if not is_admin or payment != "Paid" else "Unpaid"
        return (state if why else (void, new, status)), why, new
    why = why or ("unpaid" if payment != "Paid" else "no_change" if action == status else None)
    return (state if why else (void, payment, action)), why, action


class OrderState(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.base = handle.getValueState("base", STATE)
        self.now = handle.getValueState("now", f"{STATE}, micros bigint, event_id bigint, revision bigint")
        self.log = handle.getMapState(
            "log", "micros bigint, event_id bigint",
            f"action string, is_admin boolean, reason string, reject string, {STATE}, sent boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new, base = {}, None
        for part in rows:
            base = tuple(part.iloc[0][["void_status", "payment_status", "status"]]) if base is None else base
            new |= {(r.micros, r.event_id): (r.action, r.is_admin, r.reason) for r in part.itertuples(index=False)}
        new = {at: r for at, r in sorted(new.items()) if not self.log.containsKey(at)}
        if not self.base.exists() and base is not None and base[0] is not None:
            self.base.update(base)
        if not self.base.exists():
            for at, r in new.items():
                self.log.updateValue(at, (*r, "unknown_order", None, None, None, False))
            yield _rows(key, [(at, r, "unknown_order", None, False, False) for at, r in new.items()], 0)
            return
        if not new:
            return
        *state, micros, event_id, revision = self.now.get() if self.now.exists() else (*self.base.get(), None, None, 0)
        state, last, first = tuple(state), None if micros is None else (micros, event_id), next(iter(new))
        todo: dict = dict(new)
        old: dict = {}
        if last is not None and first < last:
            state, before = tuple(self.base.get()), None
            for at, entry in self.log.iterator():
                at = tuple(at)
                if at > first:
                    old[at] = tuple(entry)
                elif before is None or at > before:
                    before, state = at, tuple(entry[4:7])
            todo |= {at: entry[:3] for at, entry in old.items()}
        out = []
        for at in sorted(todo):
            request = todo[at]
            state, why, value = decide(state, *request)
            was = old.get(at)
            ready = request[0] == READY and why is None
            sent = bool(was and was[7])
            entry = (*request, why, *state, sent or ready)
            if entry != was:
                self.log.updateValue(at, entry)
            if was is None or was[3] != why or (why is None and value != _value(was)):
                out.append((at, request, why, value, last is not None and at < last and was is None, ready and not sent))
        end = max(max(todo), last) if last is not None else max(todo)
        self.now.update((*state, *end, revision + 1))
        yield _rows(key, out, revision + 1)


def _value(entry: tuple) -> str:
    """The value an accepted request wrote, from the state it left."""
    action, void, payment = entry[0], entry[4], entry[5]
    return void if action in ("VOID", "REVERT_VOID") else payment if action == "PAY" else action


def _rows(key, found: list, revision: int) -> pd.DataFrame:
    order = None if key[0] is None or pd.isna(key[0]) else int(key[0])
    kinds = {"VOID": "void", "REVERT_VOID": "void", "PAY": "payment"}
    return pd.DataFrame(
        [(at[1], order, pd.Timestamp(at[0], unit="us"), r[0], r[1], r[2], kinds.get(r[0], "status"), why is None, why,
          value, late, first, revision) for at, r, why, value, late, first in found],
        columns=[c.split()[0] for c in DECISION.split(", ")]).astype({"order_id": "Int64"})


def decide_stream(requests: DataFrame, orders: DataFrame) -> DataFrame:
    """The decisions on a stream of ``requests`` (event_id, ts, order_id, action, is_admin, reason); ``orders`` are
    the orders before any request (transaction_id, void_status, payment_status, status)."""
    rows = requests.select("order_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "event_id", "action",
                           "is_admin", "reason")
    start = orders.select(F.col("transaction_id").alias("_id"), "void_status", "payment_status", "status")
    return rows.join(start, F.col("order_id") == F.col("_id"), "left").drop("_id").groupBy(
        "order_id").transformWithStateInPandas(OrderState(), DECISION, "Append", "None")


def in_force(decisions: DataFrame) -> DataFrame:
    """Of all decisions that went out, the last on each request."""
    columns = [c for c in decisions.columns if c not in ("event_id", "revision")]
    return decisions.groupBy("event_id").agg(F.max_by(F.struct(*columns), "revision").alias("_r")).select(
        "event_id", "_r.*")
