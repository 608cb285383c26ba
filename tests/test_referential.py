"""Deletes over all foreign keys against one request at a time."""

import random

import pytest

from washline.operators import referential
from washline.sources import schemas

# A chain with a RESTRICT key below CASCADE keys, and a cycle, beside the declared keys.
INJECTED = [("audit_logs", "entity_id", "batch_addons", "batch_addon_id", "RESTRICT")]


def simulate(tables, requests, fks):
    """{seq: outcome} and the tables afterwards; ``tables``: {name: {key: row}}."""
    tables = {t: {k: dict(r) for k, r in rows.items()} for t, rows in tables.items()}
    out = {}
    for seq, table, key in sorted(requests):
        if key not in tables[table]:
            out[seq] = "missing"
            continue
        gone, todo = set(), [(table, key)]
        while todo:
            t, k = todo.pop()
            if (t, k) in gone:
                continue
            gone.add((t, k))
            for child, fk, parent, _, action in fks:
                if parent == t and action == "CASCADE":
                    todo += [(child, c) for c, r in tables[child].items() if str(r[fk]) == k]
        if any(str(r[fk]) == k for t, k in gone for child, fk, parent, _, action in fks
               if parent == t and action == "RESTRICT" for r in tables[child].values()):
            out[seq] = "refused"
            continue
        out[seq] = "deleted"
        for child, fk, parent, _, action in fks:
            if action == "SET NULL":
                for r in tables[child].values():
                    if (parent, str(r[fk])) in gone:
                        r[fk] = None
        for t, k in gone:
            del tables[t][k]
    return out, tables


COLUMNS = {
    "users": [], "services": [], "category": [], "addons": [], "transactions": ["created_by"],
    "transaction_batches": ["transaction_id", "service_id", "category_id"],
    "batch_addons": ["batch_id", "addon_id"], "audit_logs": ["user_id", "entity_id"]}
POINTS_TO = {"created_by": "users", "transaction_id": "transactions", "service_id": "services",
             "category_id": "category", "batch_id": "transaction_batches", "addon_id": "addons",
             "user_id": "users", "entity_id": "batch_addons"}
SIZES = {"users": 4, "services": 6, "category": 2, "addons": 5, "transactions": 12, "transaction_batches": 30,
         "batch_addons": 25, "audit_logs": 10}


def random_tables(rng, hot):
    made = {}
    for t, n in SIZES.items():
        rows = {}
        for i in range(n):
            rows[str(i)] = {c: None if rng.random() < 0.15 else
                            (0 if hot and rng.random() < 0.4 else rng.randrange(SIZES[POINTS_TO[c]]))
                            for c in COLUMNS[t]}
        made[t] = rows
    return made


def frames(spark, tables):
    return {t: spark.createDataFrame(
        [(int(k), *[r[c] for c in COLUMNS[t]]) for k, r in rows.items()],
        ", ".join(f"{c} long" for c in [referential.primary_key(t), *COLUMNS[t]])) for t, rows in tables.items()}


@pytest.mark.parametrize("seed,fks,hot", [
    (1, schemas.FOREIGN_KEYS, False), (2, schemas.FOREIGN_KEYS, True),
    (3, schemas.FOREIGN_KEYS + INJECTED, False), (4, schemas.FOREIGN_KEYS + INJECTED, True)])
def test_requests_in_order(spark, seed, fks, hot):
    rng = random.Random(seed)
    tables = random_tables(rng, hot)
    requests = [(i, t := rng.choice(list(SIZES)), str(rng.randrange(SIZES[t] + 1))) for i in range(60)]
    requests += [(1000 + i, "services", str(i)) for i in range(6)]
    asked = spark.createDataFrame([*requests, (9999, "services", None)], "seq long, table_name string, row_key string")
    got = referential.delete_requests(frames(spark, tables), asked, fks)
    expect, left = simulate(tables, requests, fks)
    assert {r.seq: r.outcome for r in got.outcomes.collect()} == {**expect, 9999: "missing"}
    assert len(set(expect.values())) == 3
    for t in tables:
        rows = {str(r[0]): {c: r[c] for c in COLUMNS[t]} for r in got.survivors(t).collect()}
        assert rows == left[t], t


def test_restrict_below_cascade_vetoes_the_whole_request(spark):
    tables = {t: {} for t in SIZES}
    tables["transactions"] = {"1": {"created_by": None}, "2": {"created_by": None}}
    tables["transaction_batches"] = {k: {"transaction_id": int(t), "service_id": None, "category_id": None}
                                     for k, t in (("10", "1"), ("20", "2"))}
    tables["batch_addons"] = {"100": {"batch_id": 10, "addon_id": None}, "200": {"batch_id": 20, "addon_id": None}}
    tables["audit_logs"] = {"7": {"user_id": None, "entity_id": 100}}
    requests = [(1, "transactions", "1"), (2, "transactions", "2"), (3, "audit_logs", "7"), (4, "transactions", "1")]
    asked = spark.createDataFrame(requests, "seq long, table_name string, row_key string")
    got = referential.delete_requests(frames(spark, tables), asked, schemas.FOREIGN_KEYS + INJECTED)
    assert {r.seq: r.outcome for r in got.outcomes.collect()} == {
        1: "refused", 2: "deleted", 3: "deleted", 4: "deleted"}
    assert got.survivors("batch_addons").count() == 0


def test_cascades_that_form_a_cycle(spark):
    fks = [("transactions", "created_by", "users", "user_id", "CASCADE"),
           ("users", "home", "transactions", "transaction_id", "CASCADE")]
    tables = {"users": spark.createDataFrame([(1, 10), (2, 11), (3, None)], "user_id long, home long"),
              "transactions": spark.createDataFrame([(10, 2), (11, 1), (12, 3)], "transaction_id long, created_by long")}
    asked = spark.createDataFrame([(1, "users", "1")], "seq long, table_name string, row_key string")
    got = referential.delete_requests(tables, asked, fks)
    assert [r.user_id for r in got.survivors("users").collect()] == [3]
    assert [r.transaction_id for r in got.survivors("transactions").collect()] == [12]


def test_chain_of_requests_that_wait_for_each_other(spark):
    """Each service is held by a line of an order that an earlier request deletes; rounds stay few."""
    tables = {"services": spark.range(5).toDF("service_id"), "transactions": spark.range(5).toDF("transaction_id"),
              "transaction_batches": spark.createDataFrame(
                  [(i, i, i, None) for i in range(5)],
                  "batch_id long, transaction_id long, service_id long, category_id long")}
    rows = [(2 * i, "services", str(i)) for i in range(5)] + [(2 * i + 1, "transactions", str(i)) for i in range(5)]
    rows += [(100 + i, "services", str(i)) for i in range(5)]
    got = referential.delete_requests(tables, spark.createDataFrame(rows, "seq long, table_name string, row_key string"))
    assert {r.seq: r.outcome for r in got.outcomes.collect()} == {
        **{2 * i: "refused" for i in range(5)}, **{2 * i + 1: "deleted" for i in range(5)},
        **{100 + i: "deleted" for i in range(5)}}


def test_requests_that_cannot_be_refused_are_not_followed_root_by_root(spark, monkeypatch):
    """Orders have no RESTRICT key below them: their rows get times, and only the service goes through the closure."""
    seen = []
    closure = referential.closure
    monkeypatch.setattr(referential, "closure", lambda tables, roots, fks: seen.append(roots) or closure(tables, roots, fks))
    tables = {"services": spark.range(2).toDF("service_id"), "transactions": spark.range(4).toDF("transaction_id"),
              "transaction_batches": spark.createDataFrame(
                  # the line 7 is there twice, in two orders: it goes with the first of them
                  [(7, 0, 0, None), (7, 1, 0, None), (8, 2, 0, None), (9, 3, 1, None)],
                  "batch_id long, transaction_id long, service_id long, category_id long")}
    rows = [(1, "transactions", "0"), (2, "transactions", "2"), (3, "services", "0"), (4, "transactions", "1"),
            (5, "services", "1"), (6, "transactions", "0"), (7, "nothing", "0")]
    got = referential.delete_requests(tables, spark.createDataFrame(rows, "seq long, table_name string, row_key string"))
    assert {r.seq: r.outcome for r in got.outcomes.collect()} == {
        1: "deleted", 2: "deleted", 3: "deleted", 4: "deleted", 5: "refused", 6: "missing", 7: "missing"}
    assert {(r.root_table, r.root_key) for r in seen[0].collect()} == {("services", "0"), ("services", "1")}
    assert sorted(r.batch_id for r in got.survivors("transaction_batches").collect()) == [9]
    assert {(r.table_name, r.row_key, r.deleted_seq) for r in got.deleted.collect()} == {
        ("transactions", "0", 1), ("transactions", "1", 4), ("transactions", "2", 2), ("services", "0", 3),
        ("transaction_batches", "7", 1), ("transaction_batches", "8", 2)}


def test_lines_are_not_written_with_their_keys(spark, monkeypatch):
    """Of lines and their add-ons only what refers to a requested row is kept, and rows of one key go together."""
    kept = []
    written = referential.written
    monkeypatch.setattr(referential, "written", lambda df, name: kept.append(written(df, name)) or kept[-1])
    lines = [(f"line-{i}", i % 20, 1 + i % 3, None) for i in range(60)]
    # line-0 is there again, in the order 19 that stays, with the only use of service 0; line-19 is in order 19 alone
    lines += [("line-0", 19, 0, None), (None, 0, 4, None)]
    extras = [(f"extra-{i}", f"line-{i}", 1 + i % 2) for i in range(60)] + [("extra-60", "line-0", 0), ("extra-61", "line-19", 3)]
    tables = {"services": spark.range(5).toDF("service_id"), "transactions": spark.range(20).toDF("transaction_id"),
              "transaction_batches": spark.createDataFrame(
                  lines, "batch_id string, transaction_id long, service_id long, category_id long"),
              "addons": spark.range(4).toDF("addon_id"),
              "batch_addons": spark.createDataFrame(extras, "batch_addon_id string, batch_id string, addon_id long")}
    rows = [(100 + i, "transactions", str(i)) for i in range(19)]
    rows += [(50, "services", "0"), (200, "services", "0"), (201, "services", "4"), (202, "addons", "0"), (203, "addons", "3")]
    got = referential.delete_requests(
        tables, spark.createDataFrame(rows, "seq long, table_name string, row_key string"),
        lean={"transaction_batches": tables["transaction_batches"].drop("category_id")})
    outcomes = {r.seq: r.outcome for r in got.outcomes.collect()}
    assert {s: o for s, o in outcomes.items() if s < 100 or s >= 200} == {
        50: "refused", 200: "deleted", 201: "deleted", 202: "deleted", 203: "refused"}
    assert {(r.batch_id, r.transaction_id) for r in got.survivors("transaction_batches").collect()} == {
        *((f"line-{i}", 19) for i in (19, 39, 59)), (None, 0)}
    assert {r.batch_addon_id for r in got.survivors("batch_addons").collect()} == {
        "extra-19", "extra-39", "extra-59", "extra-61"}
    assert max(df.count() for df in kept) <= 19  # the requested orders
