"""Foreign keys as a graph: deletes carried down it in one plan, rows without parents, and checks of a batch by bucket."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import BUCKET, Buckets


class ForeignKey(NamedTuple):
    """child.column refers to parent.key; the child's rows go with their parents."""

    child: str
    column: str
    parent: str
    key: str


#: The domain's keys: three levels below an analysis.
KEYS = [
    ForeignKey("accounts", "analysis_id", "analyses", "analysis_id"),
    ForeignKey("account_snapshots", "account_id", "accounts", "account_id"),
    ForeignKey("posts", "account_id", "accounts", "account_id"),
    ForeignKey("post_categories", "post_id", "posts", "post_id"),
    ForeignKey("analysis_insights", "analysis_id", "analyses", "analysis_id"),
    ForeignKey("analysis_reports", "analysis_id", "analyses", "analysis_id"),
]


def order(keys: Sequence[ForeignKey]) -> list[str]:
    """Tables so that parents come before their children; a circle raises."""
    parents: dict[str, set[str]] = {}
    for k in keys:
        parents.setdefault(k.parent, set())
        parents.setdefault(k.child, set()).add(k.parent)
    out: list[str] = []
    while parents:
        free = sorted(t for t, own in parents.items() if not own - set(out))
        if not free:
            raise ValueError(f"keys run in a circle: {sorted(parents)}")
        out += free
        for t in free:
            del parents[t]
    return out


def delete(tables: dict[str, DataFrame], root: str, condition: str, keys: Sequence[ForeignKey] = KEYS) -> dict[str, DataFrame]:
    """What is left of each table when the rows of root where condition holds are deleted, and all below them.

    Each table's deleted rows are a semi-join of it with its parents' deleted keys only, so a level's size is that of what
    goes, not of what stays; null references stay.  A table with two parents loses what either of them takes along."""
    gone: dict[str, DataFrame] = {root: tables[root].where(condition)}
    left = {root: tables[root].where(f"not coalesce({condition}, false)")}
    for name in order(keys):
        if name not in tables or name == root:
            continue
        rows, lost = tables[name], []
        for k in keys:
            if k.child == name and k.parent in gone:
                taken = gone[k.parent].select(F.col(k.key).alias(k.column)).distinct()
                lost.append(rows.join(taken, k.column, "left_semi").select(*rows.columns))
                rows = rows.join(taken, k.column, "left_anti").select(*rows.columns)
        if lost:
            gone[name] = lost[0]
            for more in lost[1:]:  # what one parent has taken another one doesn't find any more
                gone[name] = gone[name].unionByName(more)
        left[name] = rows
    return left


def orphans(tables: dict[str, DataFrame], keys: Sequence[ForeignKey] = KEYS) -> DataFrame:
    """child, column, n: rows of each child whose reference isn't null and finds no parent, zeros too, in one plan."""
    parts = []
    for k in keys:
        if k.child in tables and k.parent in tables:
            alone = tables[k.child].where(F.col(k.column).isNotNull()).join(tables[k.parent].select(F.col(k.key).alias(k.column)), k.column, "left_anti")
            parts.append(alone.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k.child).alias("child"), F.lit(k.column).alias("column"), "n"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def without_parents(batch: DataFrame, column: str, parents: Buckets) -> DataFrame:
    """Rows of a batch whose reference isn't among the keys of a table in buckets, of which only those are read that the
    batch's references fall into; null references are no fault."""
    (key,) = parents.keys
    asked = batch.where(F.col(column).isNotNull())
    touched = [r[0] for r in parents.dealt(asked.select(F.col(column).alias(key))).select(BUCKET).distinct().collect()]  # at most parents.number
    return asked.join(parents.existing(touched).select(F.col(key).alias(column)), column, "left_anti")


def duplicates(batch: DataFrame, table: Buckets) -> DataFrame:
    """Keys that a batch holds twice, or that the table has already, by the batch's own buckets: keys, times, stored."""
    dealt = table.dealt(batch)
    touched = [r[0] for r in dealt.select(BUCKET).distinct().collect()]
    times = batch.groupBy(*table.keys).agg(F.count(F.lit(1)).alias("times"))
    there = table.existing(touched).select(*table.keys, F.lit(True).alias("stored"))
    found = times.join(there, table.keys, "left").withColumn("stored", F.coalesce("stored", F.lit(False)))
    return found.where("times > 1 or stored")
