"""Orphans in the audit log of the accepted changes, on tables of our own."""

import datetime as dt

import __spark_entry__ as E

T = dt.datetime(2024, 1, 1)


def write(spark, to):
    def put(name, schema, *rows):
        spark.createDataFrame(list(rows), schema).write.parquet(f"{to}/{name}.parquet")

    put("customer", "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
        (1, "c", 0, 0.0, "m"))
    put("supplier", "s_suppkey long, s_name string, s_nationkey int, s_acctbal double", (3, "s", 0, 1.0))
    put("part", "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
        (1, "p", "b", "t", 1, 1.0))
    put("orders", "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string", (1, 1, "O", 1.0, T, "5-LOW"))
    put("lineitem", "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_shipdate timestamp_ntz", (1, 1, 3, 1, 1.0, 1.0, 0.0, T))
    # 21 is staff and pays; 22 pays again and is refused; 13 is an admin and a user that is there; no login at all
    put("events", "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
        *[(n, T + dt.timedelta(minutes=i), 1, "purchase", 0.0, "") for i, n in enumerate([21, 22, 13])])


def test_orphans_are_sought_in_the_audit_rows_of_accepted_changes(spark, tmp_path):
    write(spark, tmp_path)
    found = {r.fk_name: r.orphan_count for r in E.queries()["dq_fk_orphans"](spark, str(tmp_path)).collect()}
    assert found["audit_logs.user_id->users.user_id"] == 1  # the actor of 21
