"""Schema constraints re-aimed as data-quality reports over whole tables.

Each check is one aggregate pass per table (conditional counts for every column
at once, then ``stack`` to rows), or a left-anti join for foreign keys. Duplicate
keys are found by a grouped count, which is partial on each executor.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washline.functions.formatting import is_blank
from washline.sources import schemas


def _stack(wide: DataFrame, table: str, names: list[str], value: str) -> DataFrame:
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    return wide.selectExpr(f"'{table}' AS table_name",
                           f"stack({len(names)}, {pairs}) AS (column_name, {value})")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def dq_nulls(tables: dict[str, DataFrame]) -> DataFrame:
    """NULL count of every NOT NULL column."""
    parts = []
    for t, cols in schemas.NOT_NULL.items():
        if t not in tables:
            continue
        wide = tables[t].agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols])
        parts.append(_stack(wide, t, cols, "null_count"))
    return _union(parts)


def dq_enum(tables: dict[str, DataFrame]) -> DataFrame:
    """Count of non-NULL values outside each enum column's domain."""
    parts = []
    by_table: dict[str, list[str]] = {}
    for (t, c) in schemas.ENUMS:
        if t in tables:
            by_table.setdefault(t, []).append(c)
    for t, cols in by_table.items():
        wide = tables[t].agg(*[
            F.count(F.when(F.col(c).isNotNull() & ~F.col(c).isin(*schemas.ENUMS[(t, c)]), 1)).alias(c)
            for c in cols])
        parts.append(_stack(wide, t, cols, "bad_count"))
    return _union(parts)


def _by_table(tables: dict[str, DataFrame], columns) -> dict[str, list[str]]:
    """The columns of each table that are there, so that a table is scanned once."""
    out: dict[str, list[str]] = {}
    for t, c in columns:
        if t in tables and c in tables[t].columns:
            out.setdefault(t, []).append(c)
    return out


def dq_length(tables: dict[str, DataFrame]) -> DataFrame:
    """Values longer than the column's VARCHAR limit."""
    parts = []
    for t, cols in _by_table(tables, schemas.LENGTHS).items():
        wide = tables[t].agg(*[F.count(F.when(F.length(c) > schemas.LENGTHS[(t, c)], 1)).alias(c) for c in cols])
        rows = ", ".join(f"'{c}', {schemas.LENGTHS[(t, c)]}, `{c}`" for c in cols)
        parts.append(wide.selectExpr(f"'{t}' AS table_name",
                                     f"stack({len(cols)}, {rows}) AS (column_name, max_len, violations)"))
    return _union(parts)


def dq_unique(tables: dict[str, DataFrame]) -> DataFrame:
    """Per declared key: how many key values repeat, and how many rows they cover.
    NULL keys are not duplicates (as in a UNIQUE index).

    A table with several keys is checked in one scan: a grouping-sets aggregate (one
    set per key) counts rows per key value, ``grouping_id`` tells the sets apart,
    and a second, one-row aggregate turns the counts into the report. A single key
    is a plain grouped count."""
    parts = []
    for t, keys in schemas.UNIQUE.items():
        if t not in tables:
            continue
        if len(keys) == 1:
            k = keys[0]
            df = tables[t].where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in k]))
            dup = df.groupBy(*k).count().where(F.col("count") > 1)
            parts.append(dup.agg(
                F.lit(t).alias("table_name"), F.lit(",".join(k)).alias("key_name"),
                F.count(F.lit(1)).alias("duplicate_keys"),
                F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("duplicate_rows")))
            continue
        cols = sorted({c for k in keys for c in k})
        # grouping_id bit i (from the left) is 1 when cols[i] is not in the set
        gids = [sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in k) for k in keys]
        counts = (tables[t].groupingSets([list(k) for k in keys], *cols)
                  .agg(F.count(F.lit(1)).alias("_n"), F.grouping_id().alias("_gid")))
        aggs = []
        for i, (k, gid) in enumerate(zip(keys, gids)):
            dup = ((F.col("_gid") == gid) & (F.col("_n") > 1)
                   & reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in k]))
            aggs += [F.count(F.when(dup, 1)).alias(f"k{i}"),
                     F.coalesce(F.sum(F.when(dup, F.col("_n"))), F.lit(0)).cast("long").alias(f"r{i}")]
        wide = counts.agg(*aggs)
        stack = ", ".join(f"'{','.join(k)}', k{i}, r{i}" for i, k in enumerate(keys))
        parts.append(wide.selectExpr(f"'{t}' AS table_name",
                                     f"stack({len(keys)}, {stack}) AS (key_name, duplicate_keys, duplicate_rows)"))
    return _union(parts)


def dq_fk_orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """Child rows whose non-NULL reference has no parent row (left-anti join)."""
    parts = []
    for child, fk, parent, pk, _ in schemas.FOREIGN_KEYS:
        if child not in tables or parent not in tables or fk not in tables[child].columns:
            continue
        refs = tables[child].select(F.col(fk).alias("_k")).where(F.col("_k").isNotNull())
        orphans = refs.join(tables[parent].select(F.col(pk).alias("_k")), "_k", "left_anti")
        parts.append(orphans.agg(F.lit(f"{child}.{fk}->{parent}.{pk}").alias("fk_name"),
                                 F.count(F.lit(1)).alias("orphan_count")))
    return _union(parts)


# Name columns checked for digits, and required text columns checked for blanks.
NAME_COLUMNS = [("transactions", "customer_name"), ("users", "full_name")]
REQUIRED_COLUMNS = [("transactions", "customer_name"), ("services", "service_name"),
                    ("addons", "addon_name"), ("category", "name"), ("users", "username"),
                    ("users", "full_name")]


def dq_name_digits(tables: dict[str, DataFrame]) -> DataFrame:
    return _union([
        _stack(tables[t].agg(*[F.count(F.when(F.col(c).rlike("[0-9]"), 1)).alias(c) for c in cols]),
               t, cols, "violations") for t, cols in _by_table(tables, NAME_COLUMNS).items()])


def dq_required(tables: dict[str, DataFrame]) -> DataFrame:
    return _union([
        _stack(tables[t].agg(*[F.count(F.when(is_blank(c), 1)).alias(c) for c in cols]), t, cols, "blank_count")
        for t, cols in _by_table(tables, REQUIRED_COLUMNS).items()])


def dq_pickup_date(tx: DataFrame) -> DataFrame:
    """Orders whose pickup date is before the day they were created."""
    day = F.date_trunc("day", F.col("created_at"))
    return tx.where(F.col("pickup_date") < day).select("transaction_id", "created_at", "pickup_date")


def display_id_collisions(ids: DataFrame) -> DataFrame:
    """Second-resolution display ids shared by more than one order."""
    return ids.groupBy("display_id").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.min("transaction_id").alias("first_id"), F.max("transaction_id").alias("last_id"),
    ).where(F.col("n_orders") > 1)


# Character classes of the text rule profile: the rule set of the password check
# (at least 8 characters, an upper-case letter, a lower-case letter, a digit and
# one of the special characters), applied to any text column.
def _special_class() -> str:
    esc = "".join("\\" + ch if ch in "\\^]-[" else ch for ch in schemas.SPECIAL_CHARS)
    return f"[{esc}]"


TEXT_RULES = {
    "fail_length": lambda c: F.length(c) < 8,
    "fail_upper": lambda c: ~c.rlike(r"\p{Lu}"),
    "fail_lower": lambda c: ~c.rlike(r"\p{Ll}"),
    "fail_digit": lambda c: ~c.rlike(r"\p{Nd}"),
    "fail_special": lambda c: ~c.rlike(_special_class()),
}


def text_rule_profile(df: DataFrame, text_col: str, group_cols: list[str]) -> DataFrame:
    """Per group: rows, rows failing each rule, rows failing any rule (whole texts)."""
    c = F.col(text_col)
    fails = {k: F.coalesce(f(c), F.lit(True)) for k, f in TEXT_RULES.items()}
    any_fail = reduce(lambda a, b: a | b, fails.values())
    return df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count(F.when(v, 1)).alias(k) for k, v in fails.items()],
        F.count(F.when(any_fail, 1)).alias("fail_any"))
