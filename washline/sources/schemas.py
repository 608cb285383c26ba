"""The order schema: enum domains, column defaults, keys, foreign keys, limits.

These are declarations, not code paths: operators read them to build checks and
defaults, so one change here reaches every job.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values of the order schema (must equal the schema script's values).
# Enum domains in declaration order; that order is also the sort order.
# ---------------------------------------------------------------------------
ENUMS: dict[tuple[str, str], list[str]] = {
    ("users", "status"): ["Active", "Inactive"],
    ("users", "role"): ["Admin", "Staff"],
    ("services", "status"): ["Active", "Inactive"],
    ("addons", "pricing_type"): ["Fixed", "Per Kg"],
    ("addons", "status"): ["Active", "Inactive"],
    ("transactions", "status"): ["In-queue", "Ready to Claim", "Claimed"],
    ("transactions", "payment_status"): ["Paid", "Unpaid"],
    ("transactions", "void_status"): ["Active", "Voided"],
    ("audit_logs", "action_type"): ["CREATE", "UPDATE", "DELETE", "VOID", "LOGIN", "REVERT_VOID"],
}

STATUS_ORDER = ENUMS[("transactions", "status")]

# Column defaults applied when an insert leaves a column out. "now" means the
# job's explicit as_of timestamp, never the wall clock.
DEFAULTS: dict[str, dict[str, object]] = {
    "users": {"status": "Active", "role": "Staff", "created_at": "now", "updated_at": "now"},
    "services": {"status": "Active", "created_at": "now", "updated_at": "now"},
    "addons": {"pricing_type": "Fixed", "status": "Active", "created_at": "now", "updated_at": "now"},
    "transactions": {"customer_email": None, "status": "In-queue", "payment_status": "Unpaid",
                     "total_amount": "0.00", "void_status": "Active",
                     "created_at": "now", "updated_at": "now"},
    "transaction_batches": {"created_at": "now", "updated_at": "now"},
    "batch_addons": {"quantity": "1.00"},
    "audit_logs": {"timestamp": "now"},
}

# Columns and their types, as inserts write them.
TYPES: dict[str, list[tuple[str, str]]] = {
    "users": [("user_id", "long"), ("username", "string"), ("email", "string"), ("full_name", "string"),
              ("status", "string"), ("role", "string"), ("created_at", "timestamp_ntz"), ("updated_at", "timestamp_ntz"),
              ("last_login", "timestamp_ntz")],
    "services": [("service_id", "long"), ("service_name", "string"), ("description", "string"),
                 ("price_per_load", "decimal(10,2)"), ("status", "string"), ("created_at", "timestamp_ntz"),
                 ("updated_at", "timestamp_ntz")],
    "category": [("category_id", "long"), ("name", "string"), ("description", "string")],
    "addons": [("addon_id", "long"), ("addon_name", "string"), ("description", "string"), ("price", "decimal(10,2)"),
               ("pricing_type", "string"), ("status", "string"), ("created_at", "timestamp_ntz"),
               ("updated_at", "timestamp_ntz")],
    "transactions": [("transaction_id", "long"), ("display_id", "string"), ("customer_name", "string"),
                     ("customer_email", "string"), ("customer_contact", "string"), ("overall_note", "string"),
                     ("pickup_date", "timestamp_ntz"), ("status", "string"), ("payment_status", "string"),
                     ("total_amount", "decimal(10,2)"), ("created_by", "long"), ("void_status", "string"),
                     ("void_reason", "string"), ("void_at", "timestamp_ntz"), ("created_at", "timestamp_ntz"),
                     ("updated_at", "timestamp_ntz")],
    "transaction_batches": [("batch_id", "string"), ("transaction_id", "long"), ("service_id", "long"),
                            ("category_id", "long"), ("load_count", "long"), ("weight", "decimal(8,2)"),
                            ("price_per_unit", "decimal(10,2)"), ("subtotal", "decimal(10,2)"),
                            ("special_notes", "string"), ("created_at", "timestamp_ntz"),
                            ("updated_at", "timestamp_ntz")],
    "batch_addons": [("batch_addon_id", "string"), ("batch_id", "string"), ("addon_id", "long"),
                     ("quantity", "decimal(8,2)"), ("price", "decimal(10,2)"), ("subtotal", "decimal(10,2)")],
}

# VARCHAR(n) limits.
LENGTHS: dict[tuple[str, str], int] = {
    ("users", "username"): 50,
    ("users", "email"): 100,
    ("users", "full_name"): 100,
    ("services", "service_name"): 100,
    ("category", "name"): 50,
    ("addons", "addon_name"): 100,
    ("transactions", "display_id"): 20,
    ("transactions", "customer_name"): 100,
    ("transactions", "customer_email"): 100,
    ("transactions", "customer_contact"): 50,
    ("audit_logs", "entity_type"): 50,
}

# NOT NULL columns (keys excluded: they are checked by uniqueness).
NOT_NULL: dict[str, list[str]] = {
    "users": ["username", "full_name"],
    "services": ["service_name", "price_per_load"],
    "category": ["name"],
    "addons": ["addon_name", "price"],
    "transactions": ["display_id", "customer_name"],
    "transaction_batches": ["load_count", "weight", "price_per_unit", "subtotal"],
    "batch_addons": ["price", "subtotal"],
    "audit_logs": ["action_type", "entity_type"],
}

# UNIQUE / primary keys.
UNIQUE: dict[str, list[list[str]]] = {
    "users": [["user_id"], ["username"], ["email"]],
    "services": [["service_id"]],
    "category": [["category_id"], ["name"]],
    "addons": [["addon_id"]],
    "transactions": [["transaction_id"], ["display_id"]],
    "transaction_batches": [["batch_id"]],
    "batch_addons": [["batch_addon_id"]],
    "audit_logs": [["log_id"]],
}

# Foreign keys: (child table, child column, parent table, parent column, on delete).
FOREIGN_KEYS: list[tuple[str, str, str, str, str]] = [
    ("transactions", "created_by", "users", "user_id", "SET NULL"),
    ("transaction_batches", "transaction_id", "transactions", "transaction_id", "CASCADE"),
    ("transaction_batches", "service_id", "services", "service_id", "RESTRICT"),
    ("transaction_batches", "category_id", "category", "category_id", "RESTRICT"),
    ("batch_addons", "batch_id", "transaction_batches", "batch_id", "CASCADE"),
    ("batch_addons", "addon_id", "addons", "addon_id", "RESTRICT"),
    ("audit_logs", "user_id", "users", "user_id", "SET NULL"),
]

# Seed rows of the key/value configuration table (credentials left out).
CONFIG_SEED: list[tuple[str, str]] = [
    ("admin_email", "your-business@gmail.com"),
    ("pickup_ready_subject", "Order Ready for Pickup"),
    ("pickup_ready_body", "Your load is marked as complete and ready for pickup!"),
    ("kg_per_load", "7"),
]
CONFIG_KEYS = [k for k, _ in CONFIG_SEED]

# Defaults used when a configuration key is missing.
KG_PER_LOAD_DEFAULT = "7"
SUBJECT_DEFAULT = "Notification"
BODY_DEFAULT = ""

# Characters counted as "special" by the text rule profile.
SPECIAL_CHARS = "!@#$%^&*(),.?\":{}|<>"

CURRENCY = "₱"
