"""SQL text on the registered views, with bound parameters, agrees with the DataFrame operators."""

import datetime as dt

from tests.conftest import SMALL
from washline.plans.registry import QUERIES
from washline.plans.sql_views import register_order_views

MID = "/root/testdata/sf0.01"
AS_OF = dt.date(1998, 10, 15)


def test_bound_dates_select_the_report_month(spark):
    register_order_views(spark, MID)
    r = spark.sql("""
        SELECT count_if(open) AS n, sum(total_amount) FILTER (WHERE open) AS amount
        FROM (SELECT total_amount, void_status = 'Active' AS open FROM Transactions
              WHERE date_trunc('month', created_at) = date_trunc('month', CAST(:day AS TIMESTAMP_NTZ)))""",
                  args={"day": AS_OF}).first()
    k = QUERIES["report_kpis"](spark, MID).first()
    assert (r.n, float(r.amount)) == (k.active_count, k.total_sales)


def test_views_join_on_their_keys(spark):
    register_order_views(spark, MID)
    got = spark.sql("""
        WITH kept AS (SELECT transaction_id FROM Transactions
                      WHERE void_status = :state
                        AND date_trunc('month', created_at) = date_trunc('month', CAST(:day AS TIMESTAMP_NTZ)))
        SELECT service_id, count(*) AS n, sum(subtotal) AS income
        FROM Transaction_Batches LEFT SEMI JOIN kept USING (transaction_id) GROUP BY service_id""",
                    args={"day": AS_OF, "state": "Active"}).collect()
    board = QUERIES["service_leaderboard"](spark, MID).collect()
    assert {(r.service_id, r.n, float(r.income)) for r in got} == {
        (r.service_id, r.usage_count, r.total_income) for r in board}


def test_audit_view_and_last_login_shape(spark):
    names = register_order_views(spark, SMALL, with_audit=True)
    assert "audit_logs" in names
    n = spark.sql("SELECT COUNT(*) AS n FROM Audit_Logs WHERE action_type IN ('VOID', 'REVERT_VOID')").first().n
    assert n == 60    # accepted void/revert changes at sf0.001 (FIXTURES §2)
