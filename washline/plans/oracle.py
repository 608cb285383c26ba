"""Oracle SQL (DuckDB dialect) for the registered queries.

Each text starts with the order views as CTEs over the driver's tables, written
from the same mapping as ``sources.views``; the query below them is the plain SQL
statement of the operator. Money is summed as DECIMAL and cast to DOUBLE at the
end, as on the Spark side, so both engines return identical values.
"""

from __future__ import annotations

# Fixed values of the report inputs and the order schema, written out here so that the check shares nothing
# with what it checks.
AS_OF = "1998-10-15"
WINDOW = "This Month"
WINDOWS = {
    "Today": "{c} >= TIMESTAMP '1998-10-15 00:00:00' AND {c} < TIMESTAMP '1998-10-16 00:00:00'",
    "Last 7 Days": "{c} >= TIMESTAMP '1998-10-08 00:00:00'",
    "This Month": "{c} >= TIMESTAMP '1998-10-01 00:00:00' AND {c} < TIMESTAMP '1998-11-01 00:00:00'",
    "This Year": "{c} >= TIMESTAMP '1998-01-01 00:00:00' AND {c} < TIMESTAMP '1999-01-01 00:00:00'",
    "All Time": "TRUE",
}
CONFIG_SEED = [('admin_email', 'your-business@gmail.com'), ('pickup_ready_subject', 'Order Ready for Pickup'),
 ('pickup_ready_body', 'Your load is marked as complete and ready for pickup!'), ('kg_per_load', '7')]
ENUMS = {('users', 'status'): ['Active', 'Inactive'],
 ('users', 'role'): ['Admin', 'Staff'],
 ('services', 'status'): ['Active', 'Inactive'],
 ('addons', 'pricing_type'): ['Fixed', 'Per Kg'],
 ('addons', 'status'): ['Active', 'Inactive'],
 ('transactions', 'status'): ['In-queue', 'Ready to Claim', 'Claimed'],
 ('transactions', 'payment_status'): ['Paid', 'Unpaid'],
 ('transactions', 'void_status'): ['Active', 'Voided'],
 ('audit_logs', 'action_type'): ['CREATE', 'UPDATE', 'DELETE', 'VOID', 'LOGIN', 'REVERT_VOID']}
LENGTHS = {('users', 'username'): 50,
 ('users', 'email'): 100,
 ('users', 'full_name'): 100,
 ('services', 'service_name'): 100,
 ('category', 'name'): 50,
 ('addons', 'addon_name'): 100,
 ('transactions', 'display_id'): 20,
 ('transactions', 'customer_name'): 100,
 ('transactions', 'customer_email'): 100,
 ('transactions', 'customer_contact'): 50,
 ('audit_logs', 'entity_type'): 50}
NOT_NULL = {'users': ['username', 'full_name'],
 'services': ['service_name', 'price_per_load'],
 'category': ['name'],
 'addons': ['addon_name', 'price'],
 'transactions': ['display_id', 'customer_name'],
 'transaction_batches': ['load_count', 'weight', 'price_per_unit', 'subtotal'],
 'batch_addons': ['price', 'subtotal'],
 'audit_logs': ['action_type', 'entity_type']}
UNIQUE = {'users': [['user_id'], ['username'], ['email']],
 'services': [['service_id']],
 'category': [['category_id'], ['name']],
 'addons': [['addon_id']],
 'transactions': [['transaction_id'], ['display_id']],
 'transaction_batches': [['batch_id']],
 'batch_addons': [['batch_addon_id']],
 'audit_logs': [['log_id']]}
FOREIGN_KEYS = [('transactions', 'created_by', 'users', 'user_id'),
 ('transaction_batches', 'transaction_id', 'transactions', 'transaction_id'),
 ('transaction_batches', 'service_id', 'services', 'service_id'),
 ('transaction_batches', 'category_id', 'category', 'category_id'),
 ('batch_addons', 'batch_id', 'transaction_batches', 'batch_id'),
 ('batch_addons', 'addon_id', 'addons', 'addon_id'), ('audit_logs', 'user_id', 'users', 'user_id')]
SPECIAL_CHARS = '!@#$%^&*(),.?":{}|<>'

_BID = ("concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), "
        "CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), "
        "CAST(CAST(l_shipdate AS DATE) AS VARCHAR))")
_EMAIL = "'user' || CAST(o_custkey % 100 AS VARCHAR) || '@example.com'"
_VOID_AT = "CASE WHEN o_orderkey % 20 = 0 THEN o_orderdate + INTERVAL 3 DAY END"
_W = "CAST(l_quantity AS DECIMAL(8,2))"
_ADDON_SUB = "CAST(CAST(l_extendedprice AS DECIMAL(10,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(10,2))"


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_CFG_ROWS = ", ".join(f"({_sql_str(k)}, {_sql_str(v)})" for k, v in CONFIG_SEED)

VIEWS_SQL = f"""
WITH
cat AS (
  SELECT CAST(row_number() OVER (ORDER BY p_type) AS BIGINT) AS category_id, p_type AS name,
         'Type ' || p_type AS description
  FROM (SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL)),
txl AS (
  SELECT o_orderkey AS transaction_id, 'ORD-' || CAST(o_orderkey AS VARCHAR) AS display_id, o_custkey,
    CASE WHEN o_custkey % 5 = 0 THEN NULL WHEN o_custkey % 7 = 0 THEN ''
         WHEN o_custkey % 3 = 0 THEN upper({_EMAIL}) ELSE {_EMAIL} END AS customer_email,
    CAST(NULL AS VARCHAR) AS customer_contact, CAST(NULL AS VARCHAR) AS overall_note,
    o_orderdate + to_days(CASE WHEN o_orderkey % 50 = 0 THEN -1 ELSE 2 END) AS pickup_date,
    CASE o_orderstatus WHEN 'O' THEN 'In-queue' WHEN 'P' THEN 'Ready to Claim'
                       WHEN 'F' THEN 'Claimed' END AS status,
    CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2', '3') THEN 'Paid' ELSE 'Unpaid' END
      AS payment_status,
    CAST(o_totalprice AS DECIMAL(10,2)) AS total_amount,
    o_custkey % 10 AS created_by,
    CASE WHEN o_orderkey % 20 = 0 THEN 'Voided' ELSE 'Active' END AS void_status,
    CASE WHEN o_orderkey % 20 = 0 THEN 'void-' || CAST(o_orderkey AS VARCHAR) END AS void_reason,
    {_VOID_AT} AS void_at,
    o_orderdate AS created_at,
    coalesce({_VOID_AT}, o_orderdate) AS updated_at
  FROM orders),
tx AS (
  SELECT transaction_id, display_id, c_name AS customer_name, customer_email, customer_contact,
         overall_note, pickup_date, status, payment_status, total_amount, created_by, void_status,
         void_reason, void_at, created_at, updated_at
  FROM txl LEFT JOIN customer ON txl.o_custkey = customer.c_custkey),
tb AS (
  SELECT {_BID} AS batch_id, l_orderkey AS transaction_id, l_partkey AS service_id,
    cat.category_id,
    CAST(CASE WHEN {_W} > 0 THEN ceil({_W} / 7) ELSE 0 END AS BIGINT) AS load_count,
    {_W} AS weight, CAST(p_retailprice AS DECIMAL(10,2)) AS price_per_unit,
    CAST(l_extendedprice AS DECIMAL(10,2)) AS subtotal, CAST(NULL AS VARCHAR) AS special_notes,
    l_shipdate AS created_at
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN cat ON cat.name = p_type),
ba AS (
  SELECT {_BID} AS batch_addon_id, {_BID} AS batch_id, l_suppkey AS addon_id,
    CAST(l_linenumber AS DECIMAL(8,2)) AS quantity, {_ADDON_SUB} AS price, {_ADDON_SUB} AS subtotal
  FROM lineitem WHERE l_discount > 0),
sv AS (
  SELECT p_partkey AS service_id, p_name AS service_name, p_brand AS description,
    CAST(p_retailprice AS DECIMAL(10,2)) AS price_per_load,
    CASE WHEN p_size > 45 THEN 'Inactive' ELSE 'Active' END AS status
  FROM part),
ad AS (
  SELECT s_suppkey AS addon_id, s_name AS addon_name, CAST(NULL AS VARCHAR) AS description,
    CAST(abs(s_acctbal) AS DECIMAL(10,2)) AS price,
    CASE WHEN s_nationkey % 2 = 0 THEN 'Fixed' ELSE 'Per Kg' END AS pricing_type,
    CASE WHEN s_acctbal < 0 THEN 'Inactive' ELSE 'Active' END AS status
  FROM supplier),
us AS (
  SELECT s_suppkey AS user_id, s_name AS username,
    'staff' || CAST(s_suppkey AS VARCHAR) || '@example.com' AS email, s_name AS full_name,
    CASE WHEN s_acctbal < 0 THEN 'Inactive' ELSE 'Active' END AS status,
    CASE WHEN s_suppkey % 3 = 0 THEN 'Admin' ELSE 'Staff' END AS role
  FROM supplier),
cfg AS (SELECT * FROM (VALUES {_CFG_ROWS}) AS v(config_key, config_value)),
ce AS (
  SELECT event_id, ts, user_id AS order_id,
    CASE event_type WHEN 'error' THEN 'VOID' WHEN 'signup' THEN 'REVERT_VOID'
      WHEN 'purchase' THEN 'PAY' WHEN 'view' THEN 'Ready to Claim' WHEN 'click' THEN 'Claimed' END
      AS action,
    event_id % 10 AS actor_id, (event_id % 10) % 3 = 0 AS is_admin,
    CASE WHEN event_id % 11 = 0 THEN '  ' ELSE 'r' || CAST(event_id AS VARCHAR) END AS reason
  FROM events WHERE event_type IN ('error', 'signup', 'purchase', 'view', 'click'))
"""


def win(col: str, name: str = WINDOW) -> str:
    return "(" + WINDOWS[name].format(c=col) + ")"


def money(expr: str) -> str:
    return f"('₱' || format('{{:,.2f}}', {expr}))"


def dsum(expr: str) -> str:
    return f"CAST(coalesce(sum({expr}), 0) AS DOUBLE)"


ACTIVE = "void_status = 'Active'"
CREATED = win("created_at")

Q: dict[str, str] = {}

Q["report_kpis"] = f"""
SELECT *, CASE WHEN active_count > 0 THEN total_sales / CAST(active_count AS DOUBLE) ELSE 0.0 END
          AS avg_value
FROM (
  SELECT
    count(CASE WHEN status = 'Claimed' AND {ACTIVE} AND {CREATED} THEN 1 END) AS finished_count,
    CAST(coalesce(sum(CASE WHEN {ACTIVE} AND {CREATED} THEN total_amount ELSE 0 END), 0) AS DOUBLE)
      AS total_sales,
    count(CASE WHEN {ACTIVE} AND {CREATED} THEN 1 END) AS active_count,
    count(CASE WHEN status != 'Claimed' AND {ACTIVE} AND {CREATED} THEN 1 END) AS unclaimed_count,
    count(CASE WHEN payment_status = 'Unpaid' AND {ACTIVE} AND {CREATED} THEN 1 END) AS unpaid_count,
    count(CASE WHEN void_status = 'Voided' AND {win('void_at')} THEN 1 END) AS voided_count
  FROM txl WHERE {CREATED} OR {win('void_at')})
"""

Q["dashboard_cards"] = f"""
SELECT count(CASE WHEN status = 'In-queue' THEN 1 END) AS pending_count,
       count(CASE WHEN status = 'Ready to Claim' THEN 1 END) AS ready_count,
       {dsum("CASE WHEN " + win('created_at', 'Today') + " THEN total_amount END")} AS sales_today
FROM txl WHERE {ACTIVE}
"""

Q["sales_trend"] = f"""
SELECT date_trunc('day', created_at) AS t_date, {dsum('total_amount')} AS daily_total,
       strftime(date_trunc('day', created_at), '%b %d') AS day_label
FROM txl WHERE {ACTIVE} AND {win('created_at', 'All Time')}
GROUP BY 1
"""

Q["payment_mix"] = f"""
SELECT payment_status, CAST(amt AS DOUBLE) AS sum_amount,
       100.0 * CAST(amt AS DOUBLE) / CAST(sum(amt) OVER () AS DOUBLE) AS share_pct,
       printf('%.1f%%', 100.0 * CAST(amt AS DOUBLE) / CAST(sum(amt) OVER () AS DOUBLE)) AS share_label
FROM (SELECT payment_status, sum(total_amount) AS amt FROM txl
      WHERE {ACTIVE} AND {CREATED} GROUP BY payment_status)
WHERE amt > 0
"""

Q["time_windows"] = "\nUNION ALL\n".join(
    f"SELECT '{w}' AS window_name, count(CASE WHEN {ACTIVE} AND {win('created_at', w)} THEN 1 END) "
    f"AS n_orders, {dsum('CASE WHEN ' + ACTIVE + ' AND ' + win('created_at', w) + ' THEN total_amount END')} "
    f"AS total_amount FROM txl" for w in WINDOWS)

Q["user_stats"] = """
SELECT count(*) AS total_users, count(CASE WHEN status = 'Active' THEN 1 END) AS active_users,
       count(CASE WHEN lower(trim(role)) = 'admin' THEN 1 END) AS admin_count,
       count(CASE WHEN lower(trim(role)) = 'staff' THEN 1 END) AS staff_count
FROM us
"""

Q["catalog_status_counts"] = """
SELECT CAST(coalesce(sum(CASE WHEN status = 'Active' THEN n END), 0) AS BIGINT) AS active_count,
       CAST(coalesce(sum(CASE WHEN status = 'Inactive' THEN n END), 0) AS BIGINT) AS inactive_count
FROM (SELECT status, count(*) AS n FROM sv GROUP BY status
      UNION ALL SELECT status, count(*) AS n FROM ad GROUP BY status)
"""

Q["recent_orders"] = f"""
SELECT transaction_id, display_id, customer_name, status, payment_status,
       {money('total_amount')} AS amount_text,
       coalesce(strftime(created_at, '%Y-%m-%d %H:%M'), 'N/A') AS date_text
FROM tx ORDER BY created_at DESC, transaction_id DESC LIMIT 5
"""

_KEPT = f"SELECT transaction_id FROM txl WHERE {ACTIVE} AND {CREATED}"

Q["service_leaderboard"] = f"""
SELECT CAST(row_number() OVER (ORDER BY total_income DESC, usage_count DESC, service_id) AS BIGINT)
         AS rank, *
FROM (SELECT s.service_id, s.service_name, count(b.batch_id) AS usage_count,
             CAST(sum(b.subtotal) AS DOUBLE) AS total_income
      FROM sv s JOIN tb b ON s.service_id = b.service_id
      WHERE b.transaction_id IN ({_KEPT})
      GROUP BY s.service_id, s.service_name)
"""

Q["addon_leaderboard"] = f"""
SELECT CAST(row_number() OVER (ORDER BY total_income DESC, usage_count DESC, addon_id) AS BIGINT)
         AS rank, *
FROM (SELECT a.addon_id, a.addon_name, count(x.batch_addon_id) AS usage_count,
             CAST(sum(x.subtotal) AS DOUBLE) AS total_income
      FROM ad a JOIN ba x ON a.addon_id = x.addon_id JOIN tb b ON x.batch_id = b.batch_id
      WHERE b.transaction_id IN ({_KEPT})
      GROUP BY a.addon_id, a.addon_name)
"""


def _top1(id_col: str, name_col: str, from_sql: str) -> str:
    return f"""
SELECT {id_col}, {name_col}, usage_count,
       CASE WHEN usage_count > 0 THEN {name_col} || ' (' || CAST(usage_count AS VARCHAR) || ')'
            ELSE 'None' END AS label
FROM ({from_sql}) ORDER BY usage_count DESC, {id_col} LIMIT 1
"""


_MONTH_ON = win("t.created_at")
Q["top_service_literal"] = _top1("service_id", "service_name", f"""
  SELECT s.service_id, s.service_name, count(b.batch_id) AS usage_count
  FROM sv s LEFT JOIN tb b ON s.service_id = b.service_id
  LEFT JOIN txl t ON b.transaction_id = t.transaction_id AND {_MONTH_ON}
  GROUP BY s.service_id, s.service_name""")

Q["top_service_windowed"] = _top1("service_id", "service_name", f"""
  SELECT s.service_id, s.service_name, count(b.batch_id) AS usage_count
  FROM sv s LEFT JOIN (SELECT * FROM tb WHERE transaction_id IN ({_KEPT})) b
    ON s.service_id = b.service_id
  GROUP BY s.service_id, s.service_name""")

Q["top_addon_literal"] = _top1("addon_id", "addon_name", f"""
  SELECT a.addon_id, a.addon_name, count(x.batch_addon_id) AS usage_count
  FROM ad a LEFT JOIN ba x ON a.addon_id = x.addon_id
  LEFT JOIN tb b ON x.batch_id = b.batch_id
  LEFT JOIN txl t ON b.transaction_id = t.transaction_id AND {_MONTH_ON}
  GROUP BY a.addon_id, a.addon_name""")

Q["top_addon_windowed"] = _top1("addon_id", "addon_name", f"""
  SELECT a.addon_id, a.addon_name, count(x.batch_addon_id) AS usage_count
  FROM ad a LEFT JOIN (SELECT * FROM ba WHERE batch_id IN
      (SELECT batch_id FROM tb WHERE transaction_id IN ({_KEPT}))) x ON a.addon_id = x.addon_id
  GROUP BY a.addon_id, a.addon_name""")

_SEARCH = ("(customer_name ILIKE '%customer#0000001%' OR display_id ILIKE '%customer#0000001%') "
           "AND payment_status = 'Paid' AND void_status = 'Active'")

Q["transaction_search"] = f"""
SELECT transaction_id, display_id, customer_name, status, payment_status,
       {money('total_amount')} AS amount_text, strftime(created_at, '%Y-%m-%d %H:%M') AS date_text,
       void_status, CAST(total_amount AS DOUBLE) AS total_amount, created_at
FROM tx WHERE {_SEARCH}
ORDER BY created_at DESC, transaction_id DESC
"""

Q["search_stats"] = f"""
SELECT count(*) AS total_trans,
  {dsum("CASE WHEN " + ACTIVE + " AND payment_status = 'Paid' THEN total_amount END")} AS paid_sum,
  {dsum("CASE WHEN " + ACTIVE + " AND payment_status = 'Unpaid' THEN total_amount END")} AS unpaid_sum,
  count(CASE WHEN {ACTIVE} AND coalesce(status != 'Claimed', TRUE) THEN 1 END) AS unclaimed_count
FROM tx WHERE {_SEARCH}
"""

# The further specs, their windows written out as dates.
for _name, _where in {
    "month_ready": "created_at >= TIMESTAMP '1998-10-01 00:00:00' AND created_at < TIMESTAMP '1998-11-01 00:00:00' "
                   "AND status = 'Ready to Claim' AND void_status = 'Active'",
    "voided": "void_status = 'Voided'",
    "all": "TRUE",
}.items():
    for _key in ("transaction_search", "search_stats"):
        Q[f"{_key}_{_name}"] = Q[_key].replace(_SEARCH, _where)

Q["active_orders"] = f"""
SELECT transaction_id, display_id, customer_name, status, payment_status,
       {money('total_amount')} AS amount_text, CAST(total_amount AS DOUBLE) AS total_amount, created_at
FROM tx WHERE {ACTIVE} AND status != 'Claimed' AND customer_name ILIKE '%Customer#00000012%'
ORDER BY total_amount DESC, transaction_id
"""

Q["active_orders_by_status"] = f"""
SELECT transaction_id, display_id, status,
       CAST(list_position(['In-queue', 'Ready to Claim', 'Claimed'], status) AS BIGINT) AS status_rank
FROM txl WHERE {ACTIVE} ORDER BY status_rank, transaction_id
"""

Q["indexed_transaction_search"] = Q["transaction_search"]
Q["indexed_active_orders"] = Q["active_orders"]

Q["active_catalog"] = """
SELECT 'service' AS kind, service_id AS item_id, service_name AS item_name,
       CAST(price_per_load AS DOUBLE) AS price, CAST(NULL AS VARCHAR) AS pricing_type
FROM sv WHERE status = 'Active'
UNION ALL
SELECT 'addon', addon_id, addon_name, CAST(price AS DOUBLE), pricing_type FROM ad WHERE status = 'Active'
"""

Q["catalog_listing"] = """
SELECT 'service' AS kind, service_id AS item_id, service_name AS item_name, description,
       printf('₱%.2f', price_per_load) AS price_text, CAST(NULL AS VARCHAR) AS pricing_type, status
FROM sv
UNION ALL
SELECT 'addon', addon_id, addon_name, description, printf('₱%.2f', price), pricing_type, status FROM ad
UNION ALL
SELECT 'category', category_id, name, description, NULL, NULL, NULL FROM cat
"""

Q["catalog_by_name"] = """
SELECT service_name, arg_max(service_id, service_id) AS service_id,
       CAST(arg_max(price_per_load, service_id) AS DOUBLE) AS price_per_load
FROM sv WHERE status = 'Active' GROUP BY service_name
"""

Q["lookup_by_keys"] = """
SELECT transaction_id, display_id, customer_name, status, payment_status, void_status,
       CAST(total_amount AS DOUBLE) AS total_amount, created_at
FROM tx WHERE transaction_id IN (SELECT order_id FROM ce)
"""

Q["lookup_keyed"] = Q["lookup_by_keys"]

Q["config_kg_per_load"] = """
SELECT b.batch_id, CAST(b.weight AS DOUBLE) AS weight, CAST(k.kg AS DOUBLE) AS kg_per_load,
       CAST(CASE WHEN b.weight > 0 THEN ceil(b.weight / k.kg) ELSE 0 END AS BIGINT) AS load_count
FROM tb b CROSS JOIN (SELECT CAST(coalesce(max(CASE WHEN config_key = 'kg_per_load'
                                   THEN config_value END), '7') AS DECIMAL(8,2)) AS kg FROM cfg) k
"""

Q["load_count"] = """
SELECT batch_id, CAST(weight AS DOUBLE) AS weight, load_count FROM tb
"""

Q["customer_emails"] = """
SELECT DISTINCT lower(customer_email) AS customer_email FROM txl
WHERE customer_email IS NOT NULL AND customer_email != ''
"""

Q["scan_transactions"] = """
SELECT transaction_id, display_id, customer_name, customer_email, customer_contact, overall_note,
       pickup_date, status, payment_status, CAST(total_amount AS DOUBLE) AS total_amount, created_by,
       void_status, void_reason, void_at, created_at, updated_at
FROM tx
"""

_W1 = "OVER (PARTITION BY order_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_STRIP = r"regexp_replace(reason, '^\s+|\s+$', '', 'g')"
FOLD_SQL = f"""
, ev AS (
  SELECT ce.*, t.transaction_id AS base_id, t.display_id, t.status AS base_status,
         t.payment_status AS base_pay, t.void_status AS base_void
  FROM ce LEFT JOIN txl t ON ce.order_id = t.transaction_id),
v1 AS (
  SELECT *, CASE WHEN action IN ('VOID', 'REVERT_VOID') AND is_admin
                  AND (action = 'REVERT_VOID' OR length({_STRIP}) > 0)
             THEN CASE WHEN action = 'VOID' THEN 'Voided' ELSE 'Active' END END AS tv
  FROM ev),
v2 AS (SELECT *, coalesce(last_value(tv IGNORE NULLS) {_W1}, base_void) AS void_before FROM v1),
p1 AS (
  SELECT *, action IN ('PAY', 'Ready to Claim', 'Claimed') AND void_before = 'Active'
            AND coalesce(base_status != 'Claimed', TRUE) AS valid
  FROM v2),
p2 AS (
  SELECT *, coalesce(sum(CASE WHEN valid AND action = 'PAY' AND is_admin THEN 1 ELSE 0 END) {_W1}, 0)
            AS flips
  FROM p1),
p3 AS (
  SELECT *, last_value(CASE WHEN valid AND action = 'PAY' AND NOT is_admin THEN flips END IGNORE NULLS)
            {_W1} AS anchor
  FROM p2),
p4 AS (
  SELECT *, CASE WHEN anchor IS NOT NULL
                 THEN CASE WHEN (flips - anchor) % 2 = 0 THEN 'Paid' ELSE 'Unpaid' END
                 WHEN flips % 2 = 0 THEN base_pay
                 WHEN base_pay = 'Paid' THEN 'Unpaid' ELSE 'Paid' END AS paid_before
  FROM p3),
s1 AS (
  SELECT *, valid AND action IN ('Ready to Claim', 'Claimed') AND paid_before = 'Paid' AS cand FROM p4),
s2 AS (
  SELECT *, coalesce(last_value(CASE WHEN cand THEN action END IGNORE NULLS) {_W1}, base_status)
              AS status_before,
            coalesce(last_value(CASE WHEN cand AND action = 'Claimed' THEN TRUE END IGNORE NULLS) {_W1},
                     FALSE) AS after_claim
  FROM s1),
s3 AS (
  SELECT *,
    CASE WHEN base_id IS NULL THEN 'unknown_order'
         WHEN action IN ('VOID', 'REVERT_VOID') AND NOT is_admin THEN 'not_admin'
         WHEN action = 'VOID' AND coalesce(length({_STRIP}) = 0, TRUE) THEN 'blank_reason'
         WHEN action = 'VOID' AND void_before = 'Voided' THEN 'already_voided'
         WHEN action = 'REVERT_VOID' AND void_before = 'Active' THEN 'not_voided'
         WHEN action IN ('VOID', 'REVERT_VOID') THEN NULL
         WHEN NOT coalesce(base_status != 'Claimed', TRUE) OR after_claim THEN 'order_claimed'
         WHEN void_before = 'Voided' THEN 'order_voided'
         WHEN action = 'PAY' AND NOT is_admin AND paid_before = 'Paid' THEN 'staff_on_paid'
         WHEN action != 'PAY' AND paid_before != 'Paid' THEN 'unpaid'
         WHEN action != 'PAY' AND action = status_before THEN 'no_change' END AS reject_reason
  FROM s2),
ann AS (
  SELECT event_id, ts, order_id, action, actor_id, is_admin, {_STRIP} AS reason,
    CASE WHEN action IN ('VOID', 'REVERT_VOID') THEN 'void' WHEN action = 'PAY' THEN 'payment'
         ELSE 'status' END AS kind,
    reject_reason IS NULL AS accepted, reject_reason,
    CASE WHEN action IN ('VOID', 'REVERT_VOID') THEN void_before WHEN action = 'PAY' THEN paid_before
         ELSE status_before END AS old_value,
    CASE WHEN action = 'VOID' THEN 'Voided' WHEN action = 'REVERT_VOID' THEN 'Active'
         WHEN action = 'PAY' THEN CASE WHEN is_admin THEN CASE WHEN paid_before = 'Paid' THEN 'Unpaid'
                                                              ELSE 'Paid' END
                                       ELSE 'Paid' END
         ELSE action END AS new_value,
    base_status, base_pay, base_void, display_id
  FROM s3)
"""


def _fold_last(kind: str, select: str) -> str:
    return FOLD_SQL + f"""
SELECT order_id AS transaction_id, {select},
       count(*) OVER (PARTITION BY order_id) AS accepted_changes
FROM ann WHERE accepted AND kind = '{kind}'
QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY ts DESC, event_id DESC) = 1
"""


Q["fold_voids"] = _fold_last("void", """new_value AS void_status,
       CASE WHEN new_value = 'Voided' THEN reason END AS void_reason,
       CASE WHEN new_value = 'Voided' THEN ts END AS void_at""")
Q["fold_payment_toggles"] = _fold_last("payment", "new_value AS payment_status")
Q["fold_status_changes"] = _fold_last("status", "new_value AS status")

Q["transition_guard"] = FOLD_SQL + """
SELECT event_id, order_id AS transaction_id, action, kind, accepted, reject_reason FROM ann
"""

AUDIT_SQL = FOLD_SQL + """
, alog AS (
  SELECT event_id AS log_id, actor_id AS user_id,
    CASE WHEN action IN ('VOID', 'REVERT_VOID') THEN action ELSE 'UPDATE' END AS action_type,
    'Transaction' AS entity_type, order_id AS entity_id,
    CASE WHEN action = 'VOID' THEN 'Voided ' || display_id || '. Reason: ' || reason
         WHEN action = 'REVERT_VOID' THEN 'Reverted void on ' || display_id || '.'
         WHEN action = 'PAY' THEN 'Payment: ' || new_value
         ELSE 'Status: ' || new_value END AS description,
    old_value, new_value, ts AS timestamp
  FROM ann WHERE accepted)
"""

Q["audit_rows"] = AUDIT_SQL + "SELECT * FROM alog"

Q["pickup_outbox"] = FOLD_SQL + """
, c AS (SELECT coalesce(max(CASE WHEN config_key = 'pickup_ready_subject' THEN config_value END),
                        'Notification') AS subj,
               coalesce(max(CASE WHEN config_key = 'pickup_ready_body' THEN config_value END), '')
                 AS body FROM cfg)
SELECT a.event_id, t.transaction_id, t.customer_email AS receiver,
  replace(replace(c.subj, '{customer}', t.customer_name), '{order_id}', t.display_id) AS subject,
  replace(replace(c.body, '{customer}', t.customer_name), '{order_id}', t.display_id) AS body,
  a.ts AS queued_at
FROM ann a JOIN tx t ON a.order_id = t.transaction_id CROSS JOIN c
WHERE a.accepted AND a.action = 'Ready to Claim'
  AND t.customer_email IS NOT NULL AND t.customer_email != ''
"""


# --- pricing -------------------------------------------------------------------

_ADDON_AMT = """
  SELECT x.batch_id, sum(CASE WHEN a.pricing_type = 'Per Kg' THEN a.price * b.weight ELSE a.price END
                         * x.quantity) AS addon_amt
  FROM ba x JOIN ad a ON x.addon_id = a.addon_id JOIN tb b ON x.batch_id = b.batch_id
  GROUP BY x.batch_id"""

_LOADS = "CAST(CASE WHEN b.weight > 0 THEN ceil(b.weight / 7) ELSE 0 END AS BIGINT)"

_PRICED = f"""
  SELECT b.batch_id, b.transaction_id, b.service_id, {_LOADS} AS loads,
         {_LOADS} * s.price_per_load AS base, coalesce(x.addon_amt, 0) AS addon
  FROM tb b JOIN sv s ON b.service_id = s.service_id LEFT JOIN ({_ADDON_AMT}) x ON b.batch_id = x.batch_id
  WHERE {_LOADS} > 0"""

Q["price_cart"] = f"""
SELECT batch_id, transaction_id, service_id, loads, CAST(base AS DOUBLE) AS base_amount,
       CAST(addon AS DOUBLE) AS addon_amount, CAST(base + addon AS DOUBLE) AS subtotal
FROM ({_PRICED})
"""

Q["price_cart_totals"] = f"""
SELECT transaction_id, CAST(sum(base + addon) AS DOUBLE) AS cart_total, count(*) AS n_lines
FROM ({_PRICED}) GROUP BY transaction_id
"""

Q["reprice_line"] = """
SELECT b.batch_id, b.transaction_id, CAST(ceil(b.weight / 7) AS BIGINT) AS load_count,
       CAST(CAST(ceil(b.weight / 7) AS BIGINT) * s.price_per_load AS DOUBLE) AS subtotal,
       CAST(b.price_per_unit AS DOUBLE) AS price_per_unit, CAST(b.subtotal AS DOUBLE) AS old_subtotal
FROM tb b JOIN sv s ON b.service_id = s.service_id
"""

Q["weight_mismatch"] = """
SELECT b.transaction_id, b.batch_id, CAST(b.weight AS DOUBLE) AS weight,
       CAST(f.w AS DOUBLE) AS order_weight
FROM tb b JOIN (SELECT transaction_id, arg_min(weight, batch_id) AS w FROM tb GROUP BY transaction_id) f
  ON b.transaction_id = f.transaction_id
WHERE b.weight != f.w
"""

_SUMS = "SELECT transaction_id, sum(subtotal) AS s FROM tb GROUP BY transaction_id"

Q["recompute_totals"] = f"""
SELECT t.transaction_id, CAST(coalesce(x.s, 0) AS DOUBLE) AS total_amount,
       CAST(t.total_amount AS DOUBLE) AS stored_total
FROM txl t LEFT JOIN ({_SUMS}) x ON t.transaction_id = x.transaction_id
"""

Q["dq_total_drift"] = f"""
SELECT t.transaction_id, CAST(t.total_amount AS DOUBLE) AS stored_total,
       CAST(coalesce(x.s, 0) AS DOUBLE) AS line_total,
       CAST(t.total_amount - coalesce(x.s, 0) AS DOUBLE) AS drift
FROM txl t LEFT JOIN ({_SUMS}) x ON t.transaction_id = x.transaction_id
WHERE t.total_amount != coalesce(x.s, 0)
"""

Q["cart_addon_qty"] = """
SELECT batch_id, addon_id, CAST(sum(quantity) AS DOUBLE) AS quantity FROM ba GROUP BY batch_id, addon_id
"""

Q["cart_addon_text"] = """
SELECT batch_id, string_agg(addon_name || ' x' || CASE WHEN q % 1 = 0 THEN CAST(CAST(q AS BIGINT) AS VARCHAR)
                                             ELSE CAST(q AS VARCHAR) END, ', ' ORDER BY addon_id) AS addon_text
FROM (SELECT x.batch_id, x.addon_id, a.addon_name, sum(x.quantity) AS q
      FROM ba x JOIN ad a ON x.addon_id = a.addon_id GROUP BY x.batch_id, x.addon_id, a.addon_name)
GROUP BY batch_id
"""

Q["cart_addon_summary"] = """
SELECT batch_id, addon_id,
       addon_name || ' (x' || CASE WHEN q % 1 = 0 THEN CAST(CAST(q AS BIGINT) AS VARCHAR)
                                   ELSE CAST(q AS VARCHAR) END || ')' AS summary
FROM (SELECT x.batch_id, x.addon_id, a.addon_name, sum(x.quantity) AS q
      FROM ba x JOIN ad a ON x.addon_id = a.addon_id GROUP BY x.batch_id, x.addon_id, a.addon_name)
"""

# --- receipts ------------------------------------------------------------------

Q["receipt_lines"] = """
SELECT b.batch_id, b.transaction_id, s.service_name, CAST(b.weight AS DOUBLE) AS weight,
       CAST(b.subtotal AS DOUBLE) AS subtotal, printf('₱%.2f', b.subtotal) AS subtotal_text
FROM tb b JOIN sv s ON b.service_id = s.service_id
"""

Q["receipt_typed"] = """
SELECT b.batch_id, b.transaction_id, s.service_name, c.name AS cat_name, CAST(b.weight AS DOUBLE) AS weight,
       b.load_count, CAST(b.subtotal AS DOUBLE) AS subtotal
FROM tb b JOIN sv s ON b.service_id = s.service_id JOIN cat c ON b.category_id = c.category_id
"""

Q["receipt_addons"] = """
SELECT x.batch_id, x.batch_addon_id, a.addon_name, CAST(x.quantity AS DOUBLE) AS quantity,
       CAST(x.subtotal AS DOUBLE) AS subtotal
FROM ba x JOIN ad a ON x.addon_id = a.addon_id
"""

Q["receipt_active"] = f"""
SELECT t.transaction_id, t.display_id, t.customer_name, coalesce(p.ty, 'N/A') AS type_name,
       CAST(coalesce(p.n, 0) AS BIGINT) AS n_lines, 'TOTAL: ' || {money('t.total_amount')} AS total_text,
       'STATUS: ' || t.status || ' | ' || t.payment_status AS status_text
FROM tx t LEFT JOIN (SELECT b.transaction_id, arg_min(c.name, b.batch_id) AS ty, count(*) AS n
                     FROM tb b JOIN cat c ON b.category_id = c.category_id GROUP BY b.transaction_id) p
  ON t.transaction_id = p.transaction_id
"""

_NL = "chr(10)"
_WIDE = "'" + "=" * 40 + "'"
_THIN = "'" + "-" * 40 + "'"
_TITLE = "'" + "LAUNDRY RECEIPT".center(40) + "'"

Q["receipt_history"] = f"""
SELECT transaction_id, 0 AS section, CAST(NULL AS VARCHAR) AS batch_id, 0 AS sub,
       CAST(NULL AS VARCHAR) AS item_id,
       {_WIDE} || {_NL} || {_TITLE} || {_NL} || {_WIDE} || {_NL} || 'Order ID: ' || display_id || {_NL}
       || 'Date: ' || strftime(created_at, '%Y-%m-%d %H:%M') || {_NL} || 'Customer: ' || customer_name
       || {_NL} || 'Status: ' || status || ' | ' || payment_status || {_NL}
       || CASE WHEN void_status = 'Voided' THEN {_NL} || '*** VOIDED ON ' || CAST(void_at AS VARCHAR)
               || ' ***' || {_NL} || 'Reason: ' || coalesce(void_reason, 'None') || {_NL} ELSE '' END
       || {_THIN} AS text
FROM tx
UNION ALL
SELECT b.transaction_id, 1, b.batch_id, 0, NULL,
       s.service_name || ' (' || CAST(b.weight AS VARCHAR) || 'kg)' || {_NL} || '  Subtotal: '
       || {money('b.subtotal')}
FROM tb b JOIN sv s ON b.service_id = s.service_id
UNION ALL
SELECT b.transaction_id, 1, x.batch_id, 1, x.batch_addon_id,
       '  + Add-on: ' || a.addon_name || ' (' || {money('x.subtotal')} || ')'
FROM ba x JOIN ad a ON x.addon_id = a.addon_id JOIN tb b ON x.batch_id = b.batch_id
  JOIN sv s ON b.service_id = s.service_id
UNION ALL
SELECT b.transaction_id, 1, b.batch_id, 2, NULL, '' FROM tb b JOIN sv s ON b.service_id = s.service_id
UNION ALL
SELECT transaction_id, 2, NULL, 0, NULL,
       {_THIN} || {_NL} || 'TOTAL AMOUNT:          ' || {money('total_amount')} || {_NL} || {_WIDE}
FROM tx
"""


Q["receipt_active_text"] = f"""
, head AS ({Q["receipt_active"].strip()}),
shown AS (SELECT b.*, s.service_name FROM tb b JOIN cat c ON b.category_id = c.category_id
          JOIN sv s ON b.service_id = s.service_id)
SELECT transaction_id, 0 AS section, CAST(NULL AS VARCHAR) AS batch_id, 0 AS sub, CAST(NULL AS VARCHAR) AS item_id,
       'LAUNDRY RECEIPT' || {_NL} || 'ID: ' || display_id || {_NL} || 'CUSTOMER: ' || coalesce(customer_name, 'None')
       || {_NL} || 'TYPE: ' || type_name || {_NL} || {_THIN} AS text
FROM head
UNION ALL
SELECT transaction_id, 2, NULL, 0, NULL, {_THIN} || {_NL} || total_text || {_NL} || status_text FROM head
UNION ALL
SELECT transaction_id, 1, batch_id, 0, NULL,
       service_name || ' (' || CAST(weight AS VARCHAR) || 'kg - ' || CAST(load_count AS VARCHAR) || ' Load/s) : '
       || {money('subtotal')}
FROM shown
UNION ALL
SELECT b.transaction_id, 1, x.batch_id, 1, x.batch_addon_id,
       '  + ' || a.addon_name || ' x' || CASE WHEN x.quantity % 1 = 0 THEN CAST(CAST(x.quantity AS BIGINT) AS VARCHAR)
                                              ELSE CAST(x.quantity AS VARCHAR) END
FROM ba x JOIN ad a ON x.addon_id = a.addon_id JOIN shown b ON x.batch_id = b.batch_id
"""


# --- loads, updates, deletes ------------------------------------------------------

Q["order_explode_header"] = """
SELECT t.transaction_id, t.customer_name, t.customer_email, CAST(sum(b.subtotal) AS DOUBLE) AS total_amount,
       count(*) AS n_lines
FROM tb b JOIN tx t ON b.transaction_id = t.transaction_id
GROUP BY t.transaction_id, t.customer_name, t.customer_email
"""

Q["order_explode_lines"] = """
SELECT b.transaction_id, b.batch_id, b.service_id, b.category_id, CAST(b.weight AS DOUBLE) AS weight,
       b.load_count, CAST(b.price_per_unit AS DOUBLE) AS price_per_unit, CAST(b.subtotal AS DOUBLE) AS subtotal
FROM tb b JOIN tx t ON b.transaction_id = t.transaction_id
"""

Q["order_explode_addons"] = """
SELECT x.batch_id, x.addon_id, CAST(sum(x.quantity) AS DOUBLE) AS quantity,
       CAST(max(x.price) AS DOUBLE) AS unit_price, CAST(sum(x.subtotal) AS DOUBLE) AS total_price
FROM ba x JOIN tb b ON x.batch_id = b.batch_id JOIN tx t ON b.transaction_id = t.transaction_id
GROUP BY x.batch_id, x.addon_id
"""

Q["append_with_defaults"] = f"""
SELECT transaction_id, display_id, customer_name,
       CASE WHEN length(regexp_replace(customer_email, '^\\s+|\\s+$', '', 'g')) > 0
            THEN regexp_replace(customer_email, '^\\s+|\\s+$', '', 'g') END AS customer_email,
       CAST(NULL AS VARCHAR) AS customer_contact, CAST(NULL AS VARCHAR) AS overall_note, pickup_date,
       'In-queue' AS status, 'Unpaid' AS payment_status, CAST(total_amount AS DOUBLE) AS total_amount,
       created_by, 'Active' AS void_status, CAST(NULL AS VARCHAR) AS void_reason,
       CAST(NULL AS TIMESTAMP) AS void_at, TIMESTAMP '{AS_OF} 00:00:00' AS created_at,
       TIMESTAMP '{AS_OF} 00:00:00' AS updated_at
FROM tx
"""

_NOW = f"TIMESTAMP '{AS_OF} 00:00:00'"
Q["append_services"] = f"""
SELECT service_id, regexp_replace(service_name, '^\\s+|\\s+$', '', 'g') AS service_name, description,
       CAST(price_per_load AS DOUBLE) AS price_per_load, 'Active' AS status, {_NOW} AS created_at, {_NOW} AS updated_at
FROM sv
"""
Q["append_addons"] = f"""
SELECT addon_id, regexp_replace(addon_name, '^\\s+|\\s+$', '', 'g') AS addon_name, description,
       CAST(price AS DOUBLE) AS price, 'Fixed' AS pricing_type, 'Active' AS status, {_NOW} AS created_at,
       {_NOW} AS updated_at
FROM ad
"""
Q["append_category"] = """
SELECT category_id, regexp_replace(name, '^\\s+|\\s+$', '', 'g') AS name, description FROM cat
"""
Q["append_users"] = f"""
SELECT user_id, regexp_replace(username, '^\\s+|\\s+$', '', 'g') AS username,
       CASE WHEN length(trim(email)) > 0 THEN trim(email) END AS email,
       regexp_replace(full_name, '^\\s+|\\s+$', '', 'g') AS full_name, CASE WHEN user_id % 2 = 0 THEN status END AS status,
       role, {_NOW} AS created_at, {_NOW} AS updated_at, CAST(NULL AS TIMESTAMP) AS last_login
FROM us
"""
Q["append_lines"] = f"""
SELECT batch_id, transaction_id, service_id, category_id, load_count, CAST(weight AS DOUBLE) AS weight,
       CAST(price_per_unit AS DOUBLE) AS price_per_unit, CAST(subtotal AS DOUBLE) AS subtotal,
       CAST(NULL AS VARCHAR) AS special_notes, {_NOW} AS created_at, {_NOW} AS updated_at
FROM tb
"""
Q["append_line_addons"] = """
SELECT batch_addon_id, batch_id, addon_id, 1.0::DOUBLE AS quantity, CAST(price AS DOUBLE) AS price,
       CAST(subtotal AS DOUBLE) AS subtotal
FROM ba
"""
Q["users_by_role"] = """
SELECT user_id, username, full_name, role, status,
       CAST(list_position(['Admin', 'Staff'], role) AS BIGINT) AS role_rank
FROM us
"""

_LO = "1998-10-01 00:00:00"
Q["insert_ignore"] = f"""
, ids AS (SELECT transaction_id, created_at,
                    'ORD-' || CAST(CAST(epoch(created_at) AS BIGINT) AS VARCHAR) AS display_id FROM txl),
inc AS (SELECT * FROM ids WHERE created_at >= TIMESTAMP '{_LO}' - INTERVAL 7 DAY
        QUALIFY row_number() OVER (PARTITION BY display_id ORDER BY transaction_id) = 1)
SELECT display_id, transaction_id, created_at FROM inc
WHERE display_id NOT IN (SELECT display_id FROM ids WHERE created_at < TIMESTAMP '{_LO}')
"""

Q["apply_updates"] = """
, u AS (SELECT user_id AS service_id, ts, event_id, CAST(value AS DECIMAL(10,2)) AS price,
                  CASE WHEN event_id % 4 = 0 THEN '' ELSE 'desc-' || CAST(event_id AS VARCHAR) END AS d
           FROM events WHERE event_type = 'purchase'),
lp AS (SELECT service_id, price, ts FROM u
       QUALIFY row_number() OVER (PARTITION BY service_id ORDER BY ts DESC, event_id DESC) = 1),
ld AS (SELECT service_id, d FROM u WHERE length(trim(d)) > 0
       QUALIFY row_number() OVER (PARTITION BY service_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT s.service_id, s.service_name, coalesce(ld.d, s.description) AS description,
       CAST(coalesce(lp.price, s.price_per_load) AS DOUBLE) AS price_per_load, s.status, lp.ts AS updated_at
FROM sv s LEFT JOIN lp ON s.service_id = lp.service_id LEFT JOIN ld ON s.service_id = ld.service_id
"""

Q["delete_restrict"] = """
SELECT service_id, CASE WHEN service_id IN (SELECT service_id FROM tb) THEN 'refused' ELSE 'deleted' END
         AS outcome
FROM sv WHERE status = 'Inactive'
"""

Q["delete_cascade"] = """
, k AS (SELECT transaction_id FROM txl WHERE void_status = 'Voided'),
gl AS (SELECT batch_id FROM tb WHERE transaction_id IN (SELECT transaction_id FROM k)),
ga AS (SELECT batch_addon_id FROM ba WHERE batch_id IN (SELECT batch_id FROM gl))
SELECT 'transactions' AS table_name,
       count(CASE WHEN transaction_id IN (SELECT transaction_id FROM k) THEN 1 END) AS deleted_rows,
       count(CASE WHEN transaction_id NOT IN (SELECT transaction_id FROM k) THEN 1 END) AS remaining_rows
FROM txl
UNION ALL
SELECT 'transaction_batches', count(CASE WHEN batch_id IN (SELECT batch_id FROM gl) THEN 1 END),
       count(CASE WHEN batch_id NOT IN (SELECT batch_id FROM gl) THEN 1 END) FROM tb
UNION ALL
SELECT 'batch_addons', count(CASE WHEN batch_addon_id IN (SELECT batch_addon_id FROM ga) THEN 1 END),
       count(CASE WHEN batch_addon_id NOT IN (SELECT batch_addon_id FROM ga) THEN 1 END) FROM ba
"""

Q["delete_set_null"] = """
SELECT transaction_id,
       CASE WHEN created_by IN (SELECT user_id FROM us WHERE status = 'Inactive') THEN NULL
            ELSE created_by END AS created_by
FROM txl
"""

# --- order state over time ---------------------------------------------------------

_HISTORY = FOLD_SQL + """
, acc AS (SELECT order_id, ts, event_id, kind, new_value FROM ann WHERE accepted),
st AS (
  SELECT order_id, ts, event_id, last_value(CASE WHEN kind = 'void' THEN new_value END IGNORE NULLS) OVER w AS v,
         last_value(CASE WHEN kind = 'payment' THEN new_value END IGNORE NULLS) OVER w AS p,
         last_value(CASE WHEN kind = 'status' THEN new_value END IGNORE NULLS) OVER w AS s
  FROM acc WINDOW w AS (PARTITION BY order_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
al AS (
  SELECT transaction_id, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS BIGINT) AS event_id, void_status, payment_status,
         status FROM txl
  UNION ALL
  SELECT t.transaction_id, st.ts, st.event_id, coalesce(st.v, t.void_status), coalesce(st.p, t.payment_status),
         coalesce(st.s, t.status)
  FROM st JOIN txl t ON t.transaction_id = st.order_id),
iv AS (
  SELECT transaction_id, void_status, payment_status, status, ts AS valid_from,
         lead(ts) OVER (PARTITION BY transaction_id ORDER BY ts NULLS FIRST, event_id NULLS FIRST) AS valid_to
  FROM al QUALIFY valid_to IS NULL OR ts IS NULL OR ts < valid_to)
"""
Q["state_intervals"] = _HISTORY + "SELECT * FROM iv"
Q["state_at_times"] = _HISTORY + """
SELECT e.event_id AS probe_id, e.user_id AS order_id, e.ts + INTERVAL 30 MINUTE AS at, iv.void_status,
       iv.payment_status, iv.status
FROM events e LEFT JOIN iv ON iv.transaction_id = e.user_id
  AND (iv.valid_from IS NULL OR iv.valid_from <= e.ts + INTERVAL 30 MINUTE)
  AND (iv.valid_to IS NULL OR iv.valid_to > e.ts + INTERVAL 30 MINUTE)
"""

Q["published_orders"] = FOLD_SQL + """
, lastv AS (SELECT * FROM ann WHERE accepted AND kind = 'void'
            QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY ts DESC, event_id DESC) = 1),
lastp AS (SELECT * FROM ann WHERE accepted AND kind = 'payment'
          QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY ts DESC, event_id DESC) = 1),
lasts AS (SELECT * FROM ann WHERE accepted AND kind = 'status'
          QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT t.transaction_id, strftime(t.created_at, '%Y-%m') AS created_month, coalesce(s.new_value, t.status) AS status,
       coalesce(p.new_value, t.payment_status) AS payment_status, coalesce(v.new_value, t.void_status) AS void_status,
       CASE WHEN v.order_id IS NULL THEN t.void_reason WHEN v.new_value = 'Voided' THEN v.reason END AS void_reason,
       CASE WHEN v.order_id IS NULL THEN t.void_at WHEN v.new_value = 'Voided' THEN v.ts END AS void_at,
       CAST(t.total_amount AS DOUBLE) AS total_amount
FROM txl t LEFT JOIN lastv v ON v.order_id = t.transaction_id LEFT JOIN lastp p ON p.order_id = t.transaction_id
  LEFT JOIN lasts s ON s.order_id = t.transaction_id
"""

# --- the daily rollup ------------------------------------------------------------------

Q["rollup_cells"] = """
SELECT date_trunc('day', created_at) AS created_day, date_trunc('day', void_at) AS void_day, status, payment_status,
       void_status, count(*) AS n_orders, CAST(sum(total_amount) AS DOUBLE) AS amount
FROM txl GROUP BY ALL
"""
for _key in ("report_kpis", "dashboard_cards", "sales_trend", "payment_mix", "time_windows"):
    Q[f"rollup_{_key}"] = Q[_key]

# --- INSERT IGNORE under three keys: one row after the other, with the taken values in lists ----

Q["insert_ignore_users"] = """
, inc AS (
  SELECT *, row_number() OVER (ORDER BY n) AS i FROM (
    SELECT c_custkey AS n, c_custkey % 1100 AS user_id,
           'Supplier#' || lpad(CAST((c_custkey * 7) % 900 AS VARCHAR), 9, '0') AS username,
           CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 AND c_custkey % 2 = 0 THEN 'shared@example.com'
                ELSE 'staff' || CAST((c_custkey * 3) % 800 AS VARCHAR) || '@example.com' END AS email,
           c_name AS full_name
    FROM customer)),
walk AS (
  SELECT CAST(0 AS BIGINT) AS i, (SELECT list(user_id) FROM us) AS ids, (SELECT list(username) FROM us) AS names,
         (SELECT list(email) FROM us) AS mails, FALSE AS ok
  UNION ALL
  SELECT i, CASE WHEN ok THEN list_append(ids, user_id) ELSE ids END,
         CASE WHEN ok THEN list_append(names, username) ELSE names END,
         CASE WHEN ok AND email IS NOT NULL THEN list_append(mails, email) ELSE mails END, ok
  FROM (SELECT inc.i, w.ids, w.names, w.mails, inc.user_id, inc.username, inc.email,
               NOT list_contains(w.ids, inc.user_id) AND NOT list_contains(w.names, inc.username)
               AND coalesce(NOT list_contains(w.mails, inc.email), TRUE) AS ok
        FROM walk w JOIN inc ON inc.i = w.i + 1))
SELECT n, user_id, username, email, full_name FROM inc JOIN walk USING (i) WHERE walk.ok
"""

# --- deletes over all foreign keys: the phases of the requests written out ---------

_PURGE = """
, au AS (SELECT event_id AS log_id, user_id, 'LOGIN' AS action_type, 'User' AS entity_type, user_id AS entity_id,
                'Successful login' AS description, CAST(NULL AS VARCHAR) AS old_value,
                CAST(NULL AS VARCHAR) AS new_value, ts AS timestamp FROM events WHERE event_type = 'signup'),
idle AS (SELECT service_id FROM sv WHERE status = 'Inactive'),
tx1 AS (SELECT * FROM txl WHERE created_at >= TIMESTAMP '2001-07-01 00:00:00'),
tb1 AS (SELECT * FROM tb WHERE transaction_id IN (SELECT transaction_id FROM tx1)
        OR transaction_id NOT IN (SELECT transaction_id FROM txl)),
ba1 AS (SELECT * FROM ba WHERE batch_id IN (SELECT batch_id FROM tb1)),
s0 AS (SELECT service_id FROM idle WHERE service_id % 2 = 0
       AND service_id NOT IN (SELECT service_id FROM tb WHERE service_id IS NOT NULL)),
s2 AS (SELECT service_id FROM idle WHERE service_id NOT IN (SELECT service_id FROM s0)
       AND service_id NOT IN (SELECT service_id FROM tb1 WHERE service_id IS NOT NULL)),
a3 AS (SELECT addon_id FROM ad WHERE status = 'Inactive'
       AND addon_id NOT IN (SELECT addon_id FROM ba1 WHERE addon_id IS NOT NULL)),
u4 AS (SELECT user_id FROM us WHERE status = 'Inactive'),
c5 AS (SELECT category_id FROM cat
       WHERE category_id NOT IN (SELECT category_id FROM tb1 WHERE category_id IS NOT NULL))
"""

Q["delete_closure_outcomes"] = _PURGE + """
SELECT service_id AS seq, 'services' AS table_name, CAST(service_id AS VARCHAR) AS row_key,
       CASE WHEN service_id IN (SELECT service_id FROM s0) THEN 'deleted' ELSE 'refused' END AS outcome
FROM idle WHERE service_id % 2 = 0
UNION ALL
SELECT 1000000000000 + transaction_id, 'transactions', CAST(transaction_id AS VARCHAR), 'deleted'
FROM txl WHERE created_at < TIMESTAMP '2001-07-01 00:00:00'
UNION ALL
SELECT 2000000000000 + service_id, 'services', CAST(service_id AS VARCHAR),
       CASE WHEN service_id IN (SELECT service_id FROM s0) THEN 'missing'
            WHEN service_id IN (SELECT service_id FROM s2) THEN 'deleted' ELSE 'refused' END FROM idle
UNION ALL
SELECT 3000000000000 + addon_id, 'addons', CAST(addon_id AS VARCHAR),
       CASE WHEN addon_id IN (SELECT addon_id FROM a3) THEN 'deleted' ELSE 'refused' END
FROM ad WHERE status = 'Inactive'
UNION ALL
SELECT 4000000000000 + user_id, 'users', CAST(user_id AS VARCHAR), 'deleted' FROM u4
UNION ALL
SELECT 5000000000000 + category_id, 'category', CAST(category_id AS VARCHAR),
       CASE WHEN category_id IN (SELECT category_id FROM c5) THEN 'deleted' ELSE 'refused' END FROM cat
"""
Q["delete_closure_users"] = _PURGE + "SELECT * FROM us WHERE user_id NOT IN (SELECT user_id FROM u4)"
Q["delete_closure_services"] = _PURGE + """
SELECT service_id, service_name, description, CAST(price_per_load AS DOUBLE) AS price_per_load, status FROM sv
WHERE service_id NOT IN (SELECT service_id FROM s0) AND service_id NOT IN (SELECT service_id FROM s2)
"""
Q["delete_closure_category"] = _PURGE + """
SELECT category_id, name, description FROM cat WHERE category_id NOT IN (SELECT category_id FROM c5)
"""
Q["delete_closure_addons"] = _PURGE + """
SELECT addon_id, addon_name, description, CAST(price AS DOUBLE) AS price, pricing_type, status FROM ad
WHERE addon_id NOT IN (SELECT addon_id FROM a3)
"""
Q["delete_closure_transactions"] = _PURGE + """
SELECT transaction_id, display_id, customer_email, customer_contact, overall_note, pickup_date, status,
       payment_status, CAST(total_amount AS DOUBLE) AS total_amount,
       CASE WHEN created_by NOT IN (SELECT user_id FROM u4) THEN created_by END AS created_by, void_status,
       void_reason, void_at, created_at, updated_at
FROM tx1
"""
Q["delete_closure_transaction_batches"] = _PURGE + """
SELECT batch_id, transaction_id, service_id, category_id, load_count, CAST(weight AS DOUBLE) AS weight,
       CAST(price_per_unit AS DOUBLE) AS price_per_unit, CAST(subtotal AS DOUBLE) AS subtotal, special_notes,
       created_at
FROM tb1
"""
Q["delete_closure_batch_addons"] = _PURGE + """
SELECT batch_addon_id, batch_id, addon_id, CAST(quantity AS DOUBLE) AS quantity, CAST(price AS DOUBLE) AS price,
       CAST(subtotal AS DOUBLE) AS subtotal
FROM ba1
"""
Q["delete_closure_audit_logs"] = _PURGE + """
SELECT log_id, CASE WHEN user_id NOT IN (SELECT user_id FROM u4) THEN user_id END AS user_id, action_type,
       entity_type, entity_id, description, old_value, new_value, timestamp
FROM au
"""

# --- line edits: one request of every order after the other -------------------------
# The change fold with the edit requests in the log; ``guarded`` has the requests the order's state lets
# through, numbered per order. ``walk`` holds every line of the orders with requests (base lines there from
# the start, lines to be added not yet) and takes one request per order and step.

_EDIT_LOG = """
, er0 AS (
  SELECT event_id AS raw_id, 1000000000 + event_id AS event_id, ts, user_id AS order_id,
         CASE WHEN event_id % 5 < 3 THEN 'EDIT_LINE' WHEN event_id % 5 = 3 THEN 'ADD_LINE' ELSE 'DELETE_LINE' END
           AS action,
         event_id % 10 AS actor_id, (event_id % 10) % 3 = 0 AS is_admin,
         1 + (event_id // 15) % 7 AS line_number, 1 + event_id % 250 AS service_id
  FROM events WHERE event_id % 3 = 0),
ln AS (SELECT l_orderkey AS o, l_linenumber AS n, {bid} AS batch_id, {w} AS weight FROM lineitem
       WHERE l_orderkey IN (SELECT order_id FROM er0)),
er AS (
  SELECT e.event_id, e.ts, e.order_id, e.action, e.actor_id, e.is_admin,
         CASE WHEN e.action != 'ADD_LINE' THEN b.batch_id END AS batch_id, e.service_id,
         CASE WHEN e.raw_id % 4 = 0 THEN coalesce(b.weight, f.weight) ELSE f.weight END AS weight
  FROM er0 e
  LEFT JOIN (SELECT o, n, min(batch_id) AS batch_id, arg_min(weight, batch_id) AS weight FROM ln GROUP BY o, n) b
    ON b.o = e.order_id AND b.n = e.line_number
  LEFT JOIN (SELECT o, arg_min(weight, batch_id) AS weight FROM ln GROUP BY o) f ON f.o = e.order_id)
""".format(bid=_BID, w=_W)

_EDIT_FOLD = (_EDIT_LOG + FOLD_SQL.replace(
    "FROM ce LEFT JOIN txl", "FROM (SELECT * FROM ce UNION ALL SELECT event_id, ts, order_id, action, actor_id, "
    "is_admin, NULL FROM er) ce LEFT JOIN txl").replace(
    "WHEN action = 'PAY' AND NOT is_admin AND paid_before = 'Paid' THEN 'staff_on_paid'",
    "WHEN action IN ('PAY', 'EDIT_LINE', 'ADD_LINE', 'DELETE_LINE') AND NOT is_admin AND paid_before = 'Paid' "
    "THEN 'staff_on_paid' WHEN action IN ('EDIT_LINE', 'ADD_LINE', 'DELETE_LINE') THEN NULL")
    + """
, guarded AS (
  SELECT e.*, p.price_per_load AS price, row_number() OVER (PARTITION BY e.order_id ORDER BY e.ts, e.event_id) AS n
  FROM er e JOIN ann a ON a.event_id = e.event_id LEFT JOIN sv p ON p.service_id = e.service_id AND p.status = 'Active'
  WHERE a.accepted),
walk AS (
  SELECT CAST(0 AS BIGINT) AS n, b.transaction_id AS order_id, b.batch_id, '0' || b.batch_id AS rank, TRUE AS there,
         b.service_id, b.weight, b.load_count, b.subtotal, CAST(NULL AS VARCHAR) AS why
  FROM tb b WHERE b.transaction_id IN (SELECT order_id FROM guarded)
  UNION ALL
  SELECT CAST(0 AS BIGINT), order_id, 'new-' || CAST(event_id AS VARCHAR), '1' || lpad(CAST(n AS VARCHAR), 19, '0'),
         FALSE, NULL, NULL, NULL, NULL, NULL
  FROM guarded WHERE action = 'ADD_LINE'
  UNION ALL
  SELECT n, order_id, batch_id, rank,
         CASE WHEN why IS NOT NULL THEN there
              WHEN action = 'DELETE_LINE' AND batch_id = target THEN FALSE
              WHEN action = 'ADD_LINE' AND batch_id = 'new-' || CAST(event_id AS VARCHAR) THEN TRUE ELSE there END,
         CASE WHEN hit THEN new_service ELSE service_id END,
         CASE WHEN hit THEN new_weight ELSE weight END,
         CASE WHEN hit THEN CAST(ceil(new_weight / 7) AS BIGINT) ELSE load_count END,
         CASE WHEN hit THEN CAST(CAST(ceil(new_weight / 7) AS BIGINT) * price AS DECIMAL(10,2)) ELSE subtotal END,
         why
  FROM (
    SELECT *, why IS NULL AND ((action = 'EDIT_LINE' AND batch_id = target)
              OR (action = 'ADD_LINE' AND batch_id = 'new-' || CAST(event_id AS VARCHAR))) AS hit
    FROM (
      SELECT w.n + 1 AS n, w.order_id, w.batch_id, w.rank, w.there, w.service_id, w.weight, w.load_count, w.subtotal,
             g.event_id, g.action, g.batch_id AS target, g.service_id AS new_service, g.weight AS new_weight, g.price,
             CASE WHEN g.action != 'ADD_LINE' AND NOT coalesce(bool_or(w.there AND w.batch_id = g.batch_id)
                                                                OVER (PARTITION BY w.order_id), FALSE) THEN 'no_line'
                  WHEN g.action != 'DELETE_LINE' AND g.weight IS NULL THEN 'no_weight'
                  WHEN g.action != 'DELETE_LINE' AND g.price IS NULL THEN 'no_service'
                  WHEN g.action != 'DELETE_LINE' AND bool_or(w.there) OVER (PARTITION BY w.order_id)
                    AND coalesce(g.weight != arg_min(w.weight, w.rank) FILTER (WHERE w.there)
                                             OVER (PARTITION BY w.order_id), TRUE) THEN 'weight_differs' END AS why
      FROM walk w JOIN guarded g ON g.order_id = w.order_id AND g.n = w.n + 1))),
walked AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY order_id, batch_id ORDER BY n DESC) = 1),
verdict AS (
  SELECT e.event_id, e.order_id, e.action, e.batch_id,
         coalesce(a.reject_reason, CASE WHEN g.event_id IS NULL THEN NULL WHEN w.n IS NULL THEN 'no_line' ELSE w.why END)
           AS reject_reason
  FROM er e JOIN ann a ON a.event_id = e.event_id
  LEFT JOIN guarded g ON g.event_id = e.event_id
  LEFT JOIN (SELECT DISTINCT order_id, n, why FROM walk WHERE n > 0) w ON w.order_id = g.order_id AND w.n = g.n),
lines1 AS (
  SELECT b.batch_id, b.transaction_id, w.service_id, b.category_id, w.load_count, w.weight, b.price_per_unit,
         w.subtotal, b.special_notes, b.created_at
  FROM tb b JOIN walked w ON w.batch_id = b.batch_id WHERE w.there
  UNION ALL
  SELECT * FROM tb WHERE batch_id NOT IN (SELECT batch_id FROM walked)
  UNION ALL
  SELECT w.batch_id, w.order_id, w.service_id, 1, w.load_count, w.weight, g.price, w.subtotal, NULL, g.ts
  FROM walked w JOIN guarded g ON w.batch_id = 'new-' || CAST(g.event_id AS VARCHAR) WHERE w.there)
""")


def _recursive(sql: str) -> str:
    """The statement with recursion allowed in its WITH list."""
    return sql.replace("WITH\n", "WITH RECURSIVE\n", 1)


Q["totals_by_deltas"] = _EDIT_FOLD + """
SELECT t.transaction_id, count(l.batch_id) AS n_lines, CAST(coalesce(sum(l.subtotal), 0) AS DOUBLE) AS total_amount
FROM txl t LEFT JOIN lines1 l ON l.transaction_id = t.transaction_id GROUP BY t.transaction_id
"""
Q["edit_requests"] = _EDIT_FOLD + """
SELECT event_id, order_id, action, batch_id, reject_reason IS NULL AS accepted, reject_reason FROM verdict
"""
Q["edited_lines"] = _EDIT_FOLD + """
SELECT batch_id, transaction_id, service_id, category_id, load_count, CAST(weight AS DOUBLE) AS weight,
       CAST(price_per_unit AS DOUBLE) AS price_per_unit, CAST(subtotal AS DOUBLE) AS subtotal, special_notes, created_at
FROM lines1
"""
Q["edited_totals"] = _EDIT_FOLD + """
SELECT t.transaction_id,
       CAST(CASE WHEN t.transaction_id IN (SELECT order_id FROM verdict WHERE reject_reason IS NULL)
                 THEN coalesce((SELECT sum(l.subtotal) FROM lines1 l WHERE l.transaction_id = t.transaction_id), 0)
                 ELSE t.total_amount END AS DOUBLE) AS total_amount
FROM txl t
"""

Q["login_audit"] = """
SELECT event_id AS log_id, user_id, 'LOGIN' AS action_type, 'User' AS entity_type, user_id AS entity_id,
       'Successful login' AS description, CAST(NULL AS VARCHAR) AS old_value,
       CAST(NULL AS VARCHAR) AS new_value, ts AS timestamp
FROM events WHERE event_type = 'signup'
"""

Q["last_login"] = """
SELECT u.user_id, u.username, l.last_login
FROM us u LEFT JOIN (SELECT user_id, max(ts) AS last_login FROM events WHERE event_type = 'signup'
                     GROUP BY user_id) l ON u.user_id = l.user_id
"""


# --- data quality ------------------------------------------------------------------

_VIEW = {"transactions": "tx", "services": "sv", "addons": "ad", "category": "cat", "users": "us",
         "transaction_batches": "tb", "batch_addons": "ba", "audit_logs": "logins"}

#: The audit log that the checks read: the login records.
_LOGINS = """
, logins AS (SELECT event_id AS log_id, user_id, 'LOGIN' AS action_type, 'User' AS entity_type FROM events
             WHERE event_type = 'signup')
"""


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


Q["dq_nulls"] = _LOGINS + _union([
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(CASE WHEN {c} IS NULL THEN 1 END) AS null_count "
    f"FROM {_VIEW[t]}" for t, cols in NOT_NULL.items() for c in cols])

_ENUM_PARTS = []
for (_t, _c), _dom in ENUMS.items():
    if _t in _VIEW:
        _in = ", ".join(_sql_str(v) for v in _dom)
        _ENUM_PARTS.append(f"SELECT '{_t}' AS table_name, '{_c}' AS column_name, "
                           f"count(CASE WHEN {_c} IS NOT NULL AND {_c} NOT IN ({_in}) THEN 1 END) AS bad_count "
                           f"FROM {_VIEW[_t]}")
Q["dq_enum"] = _LOGINS + _union(_ENUM_PARTS)

Q["dq_length"] = _LOGINS + _union([
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, {n} AS max_len, "
    f"count(CASE WHEN length({c}) > {n} THEN 1 END) AS violations FROM {_VIEW[t]}"
    for (t, c), n in LENGTHS.items() if t in _VIEW])

Q["dq_unique"] = _LOGINS + _union([
    f"SELECT '{t}' AS table_name, '{','.join(k)}' AS key_name, count(*) AS duplicate_keys, "
    f"CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicate_rows FROM (SELECT {', '.join(k)}, count(*) AS n "
    f"FROM {_VIEW[t]} WHERE {' AND '.join(x + ' IS NOT NULL' for x in k)} GROUP BY {', '.join(k)} "
    f"HAVING count(*) > 1)" for t, keys in UNIQUE.items() if t in _VIEW for k in keys])

# the orphan check reads the audit rows of all accepted changes
_AUDITED = {**_VIEW, "audit_logs": "alog"}
Q["dq_fk_orphans"] = AUDIT_SQL + _union([
    f"SELECT '{ch}.{fk}->{pa}.{pk}' AS fk_name, count(*) AS orphan_count FROM {_AUDITED[ch]} "
    f"WHERE {fk} IS NOT NULL AND {fk} NOT IN (SELECT {pk} FROM {_VIEW[pa]} WHERE {pk} IS NOT NULL)"
    for ch, fk, pa, pk in FOREIGN_KEYS if ch in _VIEW and pa in _VIEW])

Q["dq_name_digits"] = _union([
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, "
    f"count(CASE WHEN regexp_matches({c}, '[0-9]') THEN 1 END) AS violations FROM {_VIEW[t]}"
    for t, c in [("transactions", "customer_name"), ("users", "full_name")]])

_BLANK = "coalesce(length(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')) = 0, TRUE)"
Q["dq_required"] = _union([
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, "
    f"count(CASE WHEN {_BLANK.format(c=c)} THEN 1 END) AS blank_count FROM {_VIEW[t]}"
    for t, c in [("transactions", "customer_name"), ("services", "service_name"), ("addons", "addon_name"),
                 ("category", "name"), ("users", "username"), ("users", "full_name")]])

Q["dq_pickup_date"] = """
SELECT transaction_id, created_at, pickup_date FROM txl WHERE pickup_date < date_trunc('day', created_at)
"""

Q["display_id_collisions"] = """
SELECT display_id, count(*) AS n_orders, min(transaction_id) AS first_id, max(transaction_id) AS last_id
FROM (SELECT transaction_id, 'ORD-' || CAST(CAST(epoch(created_at) AS BIGINT) AS VARCHAR) AS display_id FROM txl)
GROUP BY display_id HAVING count(*) > 1
"""

_SPECIAL = "[" + "".join("\\" + ch if ch in "\\^]-[" else ch for ch in SPECIAL_CHARS) + "]"
Q["text_rule_profile"] = f"""
SELECT lang, source, count(*) AS n_rows,
  count(CASE WHEN coalesce(length(text) < 8, TRUE) THEN 1 END) AS fail_length,
  count(CASE WHEN coalesce(NOT regexp_matches(text, '\\p{{Lu}}'), TRUE) THEN 1 END) AS fail_upper,
  count(CASE WHEN coalesce(NOT regexp_matches(text, '\\p{{Ll}}'), TRUE) THEN 1 END) AS fail_lower,
  count(CASE WHEN coalesce(NOT regexp_matches(text, '\\p{{Nd}}'), TRUE) THEN 1 END) AS fail_digit,
  count(CASE WHEN coalesce(NOT regexp_matches(text, {_sql_str(_SPECIAL)}), TRUE) THEN 1 END) AS fail_special,
  count(CASE WHEN coalesce(length(text) < 8, TRUE) OR coalesce(NOT regexp_matches(text, '\\p{{Lu}}'), TRUE)
               OR coalesce(NOT regexp_matches(text, '\\p{{Ll}}'), TRUE)
               OR coalesce(NOT regexp_matches(text, '\\p{{Nd}}'), TRUE)
               OR coalesce(NOT regexp_matches(text, {_sql_str(_SPECIAL)}), TRUE) THEN 1 END) AS fail_any
FROM documents GROUP BY lang, source
"""

Q["format_money"] = f"""
SELECT transaction_id, {money('total_amount')} AS amount_text, printf('₱%.2f', total_amount) AS amount_plain
FROM txl
"""

_WP = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
Q["valid_window_join"] = f"""
, u AS (SELECT user_id, event_id, ts, event_type = 'view' AS is_tok FROM events
        WHERE event_type IN ('view', 'click')),
m AS (SELECT *, last_value(CASE WHEN is_tok THEN event_id END IGNORE NULLS) {_WP} AS token_id,
                last_value(CASE WHEN is_tok THEN ts END IGNORE NULLS) {_WP} AS issued_at FROM u),
a AS (SELECT *, token_id IS NOT NULL AND ts < issued_at + INTERVAL 10 MINUTE AS in_win FROM m WHERE NOT is_tok),
b AS (SELECT *, last_value(CASE WHEN in_win THEN token_id END IGNORE NULLS) {_WP} AS prev_tok FROM a)
SELECT event_id AS attempt_id, user_id, ts, token_id, issued_at,
       in_win AND coalesce(prev_tok != token_id, TRUE) AS valid
FROM b
"""


# --- streaming forms (equal to their batch forms) ------------------------------------

Q["stream_daily_sales"] = f"""
SELECT date_trunc('day', created_at) AS t_date, {dsum('total_amount')} AS daily_total
FROM txl WHERE {ACTIVE} GROUP BY 1
"""

Q["stream_order_state"] = FOLD_SQL + """
, acc AS (SELECT * FROM ann WHERE accepted),
lv AS (SELECT order_id, new_value FROM acc WHERE kind = 'void'
       QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY ts DESC, event_id DESC) = 1),
lp AS (SELECT order_id, new_value FROM acc WHERE kind = 'payment'
       QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY ts DESC, event_id DESC) = 1),
ls AS (SELECT order_id, new_value FROM acc WHERE kind = 'status'
       QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY ts DESC, event_id DESC) = 1),
o AS (SELECT order_id, count(*) AS n, any_value(base_void) AS bv, any_value(base_pay) AS bp,
             any_value(base_status) AS bs FROM acc GROUP BY order_id)
SELECT o.order_id AS transaction_id, coalesce(lv.new_value, o.bv) AS void_status,
       coalesce(lp.new_value, o.bp) AS payment_status, coalesce(ls.new_value, o.bs) AS status,
       o.n AS accepted_changes
FROM o LEFT JOIN lv ON o.order_id = lv.order_id LEFT JOIN lp ON o.order_id = lp.order_id
  LEFT JOIN ls ON o.order_id = ls.order_id
"""

Q["stream_outbox"] = Q["pickup_outbox"]


def oracle_sql() -> dict[str, str]:
    """Full statements: the view CTEs, then each query (fold queries extend the CTEs)."""
    out = {}
    for k, v in Q.items():
        out[k] = _recursive(VIEWS_SQL + v) if "FROM walk w" in v else VIEWS_SQL + v
    return out
