"""Deletes as a closure over all declared foreign keys.

A request deletes one row by its key. It takes along every row that refers to it through a CASCADE
key, then the rows that refer to those, and so on; it is refused as a whole when any row it would
delete is still referred to through a RESTRICT key (also from a row it would delete itself: RESTRICT
is checked at once). Requests come in the order of ``seq``, each on what the ones before it left, so
deleting the orders that used a service can free the service for a later request.

Nothing is done one request at a time. Which tables can restrict a request follows from the keys alone. A table
from which no chain of CASCADE keys comes to a row that a RESTRICT key refers to is *free*: its requests cannot be
refused, so the first for each row passes. Their closures need no roots, only the time at which each row
goes (``Times``), which is found for the rows that a result asks for: a table of lines is not dealt by its
own long keys where the key it refers by says the same. Several rows of one key go with the first of them; that only
concerns keys that come several times, which are told by hashes first.

The other requests are *held*. Their closure is found level by level with joins, with the roots of each row.
Whether such a request is refused depends on *when* the rows that restrict it go: the request
passes if each of them is covered by an accepted request before it. Rows that only free requests can take
have their time already, so all they say about a referred row is one number: when the last of them goes. Rounds decide all
held requests whose
answer follows from what is decided: a request passes where even the latest of its restricting rows
is gone by then, and is refused where one cannot be gone whatever the open requests become. The
earliest open request is always decided, and in practice one to three rounds decide all; the rounds
are as many as the longest chain of requests of which each waits for the one before.

A row that a third of all rows refer to is one row here: restricting rows are reduced to one number
per referred row (a partial aggregate) before they meet requests.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washline.functions.running import checkpointed, written
from washline.sources import schemas

NEVER = (1 << 63) - 1
ROOT = ["root_table", "root_key"]
ROW = ["table_name", "row_key"]


def primary_key(table: str) -> str:
    return schemas.UNIQUE[table][0][0]


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@dataclass
class Deletion:
    """What a list of delete requests comes to."""

    tables: Mapping[str, DataFrame]
    foreign_keys: Sequence[tuple[str, str, str, str, str]]
    outcomes: DataFrame  # seq, table_name, row_key, outcome: deleted, refused or missing
    times: Mapping[str, Sequence[DataFrame]]  # per table (row_key, seq) of the rows that go, a key any number of times
    free: Times | None = None  # of the times, those by requests of free tables

    @property
    def deleted(self) -> DataFrame:
        """table_name, row_key, deleted_seq of every row that goes."""
        return _union([self.gone(t).select(F.lit(t).alias("table_name"), "row_key", "deleted_seq") for t in self.times])

    def gone(self, table: str) -> DataFrame:
        """(row_key, deleted_seq) of the rows of ``table`` that go."""
        return _union(self.times[table]).groupBy("row_key").agg(F.min("seq").alias("deleted_seq"))

    def survivors(self, table: str) -> DataFrame:
        """The rows of ``table`` that stay, references to deleted rows through SET NULL keys emptied."""
        out = df = self.tables[table]
        key = df[primary_key(table)].cast("string")
        times = self.times[table]
        if self.free is not None and (ups := self.free.ups(table)):
            # most rows go with the row they refer to; of those left, only rows of a key that comes several times,
            # of a request or of a held closure are looked up by their own key
            for i, (fk, parent) in enumerate(ups):
                above = self.free.all(parent).select(F.col("row_key").alias(f"_above{i}"))
                above = above if self.free.ups(parent) else _by_hash(above)
                out = out.join(above, (df[fk].cast("string") == F.col(f"_above{i}")) & key.isNotNull(), "left_anti")
            times = [*self.free.own(table), *self.free.repeated(table), *times[1:]]
        keys = _union(times).select(F.col("row_key").alias("_gone"))
        out = out.join(keys, key == F.col("_gone"), "left_anti")
        for i, (child, fk, parent, _, action) in enumerate(self.foreign_keys):
            if child == table and action == "SET NULL" and parent in self.tables and fk in df.columns:
                lost = self.gone(parent).select(F.col("row_key").alias(f"_lost{i}"))
                out = (out.join(lost, F.col(fk).cast("string") == F.col(f"_lost{i}"), "left")
                       .withColumn(fk, F.when(F.col(f"_lost{i}").isNull(), F.col(fk))).drop(f"_lost{i}"))
        return out.select(*df.columns)


def _references(tables: Mapping[str, DataFrame], foreign_keys, action: str):
    """(parent table, child table, rows of row_key -> child_key) of every key with that action."""
    for child, fk, parent, _, on_delete in foreign_keys:
        if on_delete == action and child in tables and parent in tables and fk in tables[child].columns:
            rows = tables[child].where(F.col(fk).isNotNull()).select(
                F.col(fk).cast("string").alias("row_key"),
                F.col(primary_key(child)).cast("string").alias("child_key"))
            yield parent, child, rows


def _reach(tables: Mapping[str, DataFrame], foreign_keys) -> dict[str, set[str]]:
    """Per table the tables whose rows a delete in it can take along, itself included."""
    down: dict[str, set[str]] = {t: set() for t in tables}
    for parent, child, _ in _references(tables, foreign_keys, "CASCADE"):
        down[parent].add(child)
    out = {}
    for t in tables:
        seen, todo = set(), [t]
        while todo:
            if (at := todo.pop()) not in seen:
                seen.add(at)
                todo += down[at]
        out[t] = seen
    return out


def _free(tables: Mapping[str, DataFrame], foreign_keys) -> set[str]:
    """The tables whose requests no RESTRICT key can refuse, and whose CASCADE keys form no cycle."""
    reach = _reach(tables, foreign_keys)
    held = {parent for parent, _, _ in _references(tables, foreign_keys, "RESTRICT")}
    held |= {t for parent, t, _ in _references(tables, foreign_keys, "CASCADE") if parent in reach[t]}
    return {t for t in tables if not reach[t] & held}


def _of(requests: DataFrame, table: str, rows: DataFrame) -> DataFrame:
    """The requested rows of ``table`` that are there: row_key and the first request's seq."""
    first = requests.where(F.col("table_name") == table).groupBy("row_key").agg(F.min("seq").alias("seq"))
    return first.join(rows.select(F.col(primary_key(table)).cast("string").alias("row_key")), "row_key", "left_semi")


def _few(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """The stored ``df``, to be broadcast if it has no more than ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df


def _by_hash(times: DataFrame) -> DataFrame:
    """``times`` of requested rows, one per key, for a join that puts them into a hash table per partition: the rows that
    meet them, several times as many, are not sorted."""
    return times.hint("shuffle_hash")


def _earliest(times: DataFrame) -> DataFrame:
    return times.groupBy("row_key").agg(F.min("seq").alias("seq"))


class Times:
    """When each row goes by requests of free tables. ``first``: per free table its requested rows and the first request
    of each. ``lean``: tables without some of their columns, read where the others suffice."""

    def __init__(self, tables: Mapping[str, DataFrame], first: Mapping[str, DataFrame], foreign_keys,
                 lean: Mapping[str, DataFrame] | None = None):
        self.tables, self.foreign_keys, self.lean = tables, foreign_keys, lean or {}
        self.first = {t: written(df, f"delete-{t}") for t, df in first.items()}
        reach = _reach(tables, foreign_keys)
        self.reached = set().union(*[reach[t] for t in first])
        self._several: dict[str, DataFrame | None] = {}

    def rows(self, table: str, **columns: str) -> DataFrame:
        """Columns of ``table`` as text under the names given."""
        df = self.lean.get(table)
        if df is None or not set(columns.values()) <= set(df.columns):
            df = self.tables[table]
        return df.select(*[F.col(c).cast("string").alias(name) for name, c in columns.items()])

    def ups(self, table: str) -> list[tuple[str, str]]:
        """(column, parent) of the CASCADE keys with which rows of ``table`` go."""
        return [(fk, parent) for child, fk, parent, _, action in self.foreign_keys
                if child == table and action == "CASCADE" and parent in self.reached and fk in self.tables[table].columns]

    def own(self, table: str) -> list[DataFrame]:
        return [self.first[table]] if table in self.first else []

    def all(self, table: str) -> DataFrame:
        """(row_key, seq) of the rows of ``table`` that go; a key may come several times, the smallest seq counts."""
        parts = self.own(table)
        for fk, parent in self.ups(table):
            above = self.all(parent)
            above = (_earliest(above) if self.ups(parent) else _by_hash(above)).withColumnRenamed("row_key", "_key")
            parts.append(self.rows(table, row_key=primary_key(table), _up=fk).join(
                above, F.col("_up") == F.col("_key")).select("row_key", "seq"))
        return _union(parts)

    def at(self, table: str, keys: DataFrame) -> DataFrame:
        """(row_key, seq), each key once, of those of ``keys`` (row_key) that go, and maybe others."""
        if not (ups := self.ups(table)):
            return self.first[table]
        parts = self.own(table)
        for fk, parent in ups:
            rows = self.rows(table, row_key=primary_key(table), _up=fk).join(keys, "row_key", "left_semi")
            if self.ups(parent):
                rows = written(rows, "delete-at")
            above = self.at(parent, rows.select(F.col("_up").alias("row_key"))).withColumnRenamed("row_key", "_key")
            parts.append(rows.join(above, F.col("_up") == F.col("_key")).select("row_key", "seq"))
        return _earliest(_union(parts))

    def several(self, table: str) -> DataFrame | None:
        """Hashes (_mark) of the keys of ``table`` that come several times, None if there are none."""
        if table not in self._several:
            keys = self.rows(table, row_key=primary_key(table)).where(F.col("row_key").isNotNull())
            marks = written(keys.select(F.xxhash64("row_key").alias("_mark")).repartition("_mark").groupBy("_mark")
                            .agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("_mark"), "delete-several")
            self._several[table] = None if marks.isEmpty() else _few(marks)
        return self._several[table]

    def repeated(self, table: str) -> list[DataFrame]:
        """(row_key, seq) of the rows that go and whose key comes several times."""
        marks = self.several(table)
        if marks is None:
            return []
        return [self.all(table).join(marks, F.xxhash64("row_key") == F.col("_mark"), "left_semi")]

    def until(self, child: str, fk: str, asked: DataFrame) -> DataFrame:
        """Per row_key of ``asked`` that rows of ``child`` refer to by ``fk``, when the last of them goes (``_acc``)."""
        ups = self.ups(child)
        refs = self.rows(child, row_key=fk, child_key=primary_key(child),
                         **{f"_up{i}": up for i, (up, _) in enumerate(ups)}).join(asked, "row_key", "left_semi")
        marks = self.several(child) if ups else None
        seqs = []
        if marks is not None:
            same = F.xxhash64("child_key") == F.col("_mark")
            seqs.append(self._by_key(child, refs.join(marks, same, "left_semi")).select("row_key", "seq"))
            refs = refs.join(marks, same, "left_anti")
        if any(self.ups(parent) for _, parent in ups):
            refs = written(refs if child in self.first else refs.drop("child_key"), "delete-refs")
        found = []
        for i, (_, parent) in enumerate(ups):
            above = self.at(parent, refs.select(F.col(f"_up{i}").alias("row_key")))
            above = above if self.ups(parent) else _by_hash(above)
            refs = refs.join(above.select(F.col("row_key").alias("_key"), F.col("seq").alias(f"_seq{i}")),
                             F.col(f"_up{i}") == F.col("_key"), "left").drop("_key")
            found.append(F.col(f"_seq{i}"))
        for own in self.own(child):
            refs = refs.join(own.select(F.col("row_key").alias("_key"), F.col("seq").alias("_own")),
                             F.col("child_key") == F.col("_key"), "left").drop("_key")
            found.append(F.col("_own"))
        none = F.lit(None).cast("bigint")
        seqs.append(refs.select("row_key", F.least(none, none, *found).alias("seq")))
        return written(_union(seqs).groupBy("row_key").agg(F.max(F.coalesce("seq", F.lit(NEVER))).alias("_acc")),
                       "delete-until")

    def links(self, child: str, fk: str, asked: DataFrame) -> DataFrame:
        """The references (row_key, child_key, seq) by ``fk`` to ``asked``; seq NULL: the child stays."""
        refs = self.rows(child, row_key=fk, child_key=primary_key(child)).join(asked, "row_key", "left_semi")
        if child not in self.reached:
            return refs.withColumn("seq", F.lit(None).cast("bigint"))
        return self._by_key(child, refs)

    def _by_key(self, child: str, refs: DataFrame) -> DataFrame:
        """``refs`` (row_key, child_key) with the seq of the child, looked up by its key."""
        refs = written(refs.select("row_key", "child_key"), "delete-refs")
        times = self.at(child, refs.select(F.col("child_key").alias("row_key"))).withColumnRenamed("row_key", "_key")
        return refs.join(times, F.col("child_key") == F.col("_key"), "left").select("row_key", "child_key", "seq")


def closure(tables: Mapping[str, DataFrame], roots: DataFrame, foreign_keys=schemas.FOREIGN_KEYS) -> DataFrame:
    """Every row that goes with a root (root_table, root_key): the root itself and all rows below it
    through CASCADE keys, as (root_table, root_key, table_name, row_key). Keys may form cycles."""
    cascades = list(_references(tables, foreign_keys, "CASCADE"))
    level = checkpointed(roots.select(*ROOT, F.col("root_table").alias("table_name"),
                                      F.col("root_key").alias("row_key")))
    levels = [level]
    names = {r[0] for r in level.select("table_name").distinct().collect()}  # tables, not rows
    while names := {child for parent, child, _ in cascades if parent in names}:
        below = _union([
            level.where(F.col("table_name") == parent).join(rows, "row_key").select(
                *ROOT, F.lit(child).alias("table_name"), F.col("child_key").alias("row_key"))
            for parent, child, rows in cascades if child in names]).distinct()
        level = checkpointed(below.join(_union(levels), [*ROOT, *ROW], "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
    return _union(levels)


def _latest(links: DataFrame | None, settled: DataFrame, parents: DataFrame, children: DataFrame | None,
            roots: DataFrame) -> DataFrame:
    """Per root the time from which nothing restricts it, as decided (``by_now``) and at best
    (``at_best``), from the accepted and the earliest open request of every root. ``settled``: per referred row (``ROW``)
    the time ``_acc`` and ``_pos`` from which the rows that only free requests take do not restrict it."""
    free = settled
    if links is not None:
        timed = children.join(roots, ROOT)
        gone = timed.groupBy(F.col("table_name").alias("child_table"), F.col("row_key").alias("child_key")).agg(
            F.min("accepted_seq").alias("_acc"), F.min(F.coalesce("accepted_seq", "open_seq")).alias("_pos"))
        free = free.unionByName(links.join(gone, ["child_table", "child_key"], "left").select(
            *ROW, F.coalesce(F.least("_acc", "seq"), F.lit(NEVER)).alias("_acc"),
            F.coalesce(F.least("_pos", "seq"), F.lit(NEVER)).alias("_pos")))
    free = free.groupBy(*ROW).agg(F.max("_acc").alias("_acc"), F.max("_pos").alias("_pos"))
    return parents.join(free, ROW).groupBy(*ROOT).agg(F.max("_acc").alias("by_now"), F.max("_pos").alias("at_best"))


def _restricting(times: Times, rows: DataFrame, foreign_keys) -> tuple[DataFrame | None, DataFrame | None]:
    """What restricts the held closure ``rows``: (links, settled). ``links`` (table_name, row_key, child_table, child_key,
    seq) has the references by rows that held requests may take; ``settled`` all others, as one number per row."""
    tables = times.tables
    reach = _reach(tables, foreign_keys)
    held = set(tables) - _free(tables, foreign_keys)
    can = set().union(*[reach[t] for t in held])
    asked: dict[str, DataFrame] = {}
    links, settled = [], []
    for child, fk, parent, _, action in foreign_keys:
        if action != "RESTRICT" or parent not in can or child not in tables or fk not in tables[child].columns:
            continue
        if parent not in asked:
            asked[parent] = _few(checkpointed(rows.where(F.col("table_name") == parent).select("row_key").distinct()))
        if child in can:
            links.append(times.links(child, fk, asked[parent]).select(
                F.lit(parent).alias("table_name"), "row_key", F.lit(child).alias("child_table"), "child_key", "seq"))
        else:
            settled.append(times.until(child, fk, asked[parent]).select(
                F.lit(parent).alias("table_name"), "row_key", "_acc", F.col("_acc").alias("_pos")))
    return (checkpointed(_union(links)) if links else None, checkpointed(_union(settled)) if settled else None)


def delete_requests(tables: Mapping[str, DataFrame], requests: DataFrame, foreign_keys=schemas.FOREIGN_KEYS,
                    lean: Mapping[str, DataFrame] | None = None) -> Deletion:
    """Run delete ``requests`` (seq, table_name, row_key; seq unique, keys as text) in their order.

    ``lean``: for some tables the same rows with fewer columns, read where those suffice.

    A request for a row that is not there, was deleted before, or has a NULL key is ``missing``."""
    names = {r[0] for r in requests.where(F.col("table_name").isin(*tables)).select("table_name").distinct().collect()}  # tables, not rows
    unrefused = _free(tables, foreign_keys)
    first = {t: _of(requests, t, tables[t]) for t in sorted(names)}
    times = Times(tables, {t: first[t] for t in first if t in unrefused}, foreign_keys, lean)
    there = _union([first[t].select(F.lit(t).alias("root_table"), F.col("row_key").alias("root_key"))
                    for t in first if t not in unrefused] or [requests.select(
                        F.col("table_name").alias("root_table"), F.col("row_key").alias("root_key")).limit(0)])
    rows = closure(tables, there, foreign_keys)
    links, settled = _restricting(times, rows, foreign_keys)
    asked = requests.select("seq", F.col("table_name").alias("root_table"), F.col("row_key").alias("root_key"))
    state = asked.where(F.col("root_table").isin(*(names - unrefused))).join(
        there.withColumn("_there", F.lit(True)), ROOT, "left").select(
        "seq", *ROOT, F.when(F.col("_there").isNull(), "missing").alias("outcome"))
    state = checkpointed(state)
    held = links is not None or settled is not None
    if held:
        none = state.limit(0).select(F.col("root_table").alias("table_name"), F.col("root_key").alias("row_key"),
                                     F.lit(NEVER).alias("_acc"), F.lit(NEVER).alias("_pos"))
        settled = none if settled is None else settled
        restricted = settled.select(*ROW) if links is None else settled.select(*ROW).unionByName(links.select(*ROW))
        # of the closure, rounds need only the rows that are restricted and those that restrict
        parents = checkpointed(rows.join(restricted.distinct(), ROW, "left_semi"))
        children = None if links is None else checkpointed(rows.join(
            links.select(F.col("child_table").alias("table_name"), F.col("child_key").alias("row_key")).distinct(),
            ROW, "left_semi"))
    while not state.where(F.col("outcome").isNull()).isEmpty():
        roots = state.groupBy(*ROOT).agg(
            F.min(F.when(F.col("outcome") == "deleted", F.col("seq"))).alias("accepted_seq"),
            F.min(F.when(F.col("outcome").isNull(), F.col("seq"))).alias("open_seq"))
        if held:
            free = _latest(links, settled, parents, children, roots)
        else:
            free = roots.limit(0).select(*ROOT, F.lit(0).cast("bigint").alias("by_now"),
                                         F.lit(0).cast("bigint").alias("at_best"))
        judged = state.join(free, ROOT, "left").withColumn(
            "_refused", F.col("outcome").isNull() & F.coalesce(F.col("at_best") >= F.col("seq"), F.lit(False)))
        # of a row's requests the first that is not refused is next: it passes, or waits, and the rest with it
        first = judged.where(F.col("outcome").isNull() & ~F.col("_refused")).groupBy(*ROOT).agg(
            F.min("seq").alias("_first"),
            F.max(F.coalesce("by_now", F.lit(-NEVER))).alias("_free"))
        first = first.select(*ROOT, "_first", (F.col("_free") < F.col("_first")).alias("_passes"))
        state = checkpointed(judged.join(first, ROOT, "left").select(
            "seq", *ROOT,
            F.when(F.col("outcome").isNotNull(), F.col("outcome"))
             .when(F.col("_refused"), "refused")
             .when(F.col("_passes") & (F.col("seq") == F.col("_first")), "deleted")
             .when(F.col("_passes"), "missing").alias("outcome")))
    done = state.where(F.col("outcome") == "deleted").select(*ROOT, "seq")
    taken = checkpointed(rows.join(done, ROOT).groupBy(*ROW).agg(F.min("seq").alias("seq")))
    deletion = Deletion(tables, foreign_keys, state, {
        t: [*([times.all(t)] if t in times.reached else []),
            taken.where(F.col("table_name") == t).select("row_key", "seq")] for t in tables}, times)
    # a request whose row had gone with an earlier one found nothing
    parts = [asked.where(~F.coalesce(F.col("root_table").isin(*names), F.lit(False))).select("seq", *ROOT, F.lit("missing").alias("outcome"))]
    for t in sorted(names):
        mine = (state if t not in unrefused else asked.withColumn("outcome", F.lit("deleted"))).where(F.col("root_table") == t)
        late = F.col("deleted_seq") < F.col("seq")
        late = F.coalesce(late, F.lit(True)) if t in unrefused else (F.col("outcome") == "deleted") & late
        parts.append(mine.join(deletion.gone(t).withColumnRenamed("row_key", "root_key"), "root_key", "left").select(
            "seq", *ROOT, F.when(late, "missing").otherwise(F.col("outcome")).alias("outcome")))
    deletion.outcomes = _union(parts).select("seq", F.col("root_table").alias("table_name"),
                                             F.col("root_key").alias("row_key"), "outcome")
    return deletion
