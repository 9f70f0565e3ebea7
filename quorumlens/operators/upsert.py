"""Writes with conflict keys, as functions from (existing, new) to the next version of a table.

A batch that holds a key twice is reduced first (the last in `order` wins), where a database would refuse it.  The
result is one full outer join on the key; applying a batch twice is applying it once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_per_key(batch: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*[c.desc_nulls_last() for c in order]))
    return batch.withColumn("__n", number).where(F.col("__n") == 1).drop("__n")


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """New rows replace existing ones; columns in `keep` stay as they were where a row existed, and columns that new
    doesn't have stay too (partial update).  new must be unique on keys."""
    have = existing.withColumn("__old", F.lit(True)).alias("e")
    come = new.withColumn("__new", F.lit(True)).alias("n")
    joined = have.join(come, [F.col(f"e.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full")
    out = []
    for c in existing.columns:
        if c in keys:
            out.append(F.coalesce(f"n.{c}", f"e.{c}").alias(c))
        elif c not in new.columns:
            out.append(F.col(f"e.{c}"))
        elif c in keep:
            out.append(F.when(F.col("e.__old"), F.col(f"e.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
        else:
            out.append(F.when(F.col("n.__new"), F.col(f"n.{c}")).otherwise(F.col(f"e.{c}")).alias(c))
    return joined.select(*out)


def insert_missing(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows whose key isn't there join the existing ones; the others are ignored."""
    fresh = new.join(existing.select(*keys), list(keys), "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def merge_snapshots(existing: DataFrame, historical: DataFrame, live: DataFrame) -> DataFrame:
    """History overwrites its weeks; the live figure only fills a week that is missing."""
    keys = ["account_id", "week_start"]
    return insert_missing(upsert(existing, historical, keys), live, keys)


def violations(df: DataFrame, unique: Sequence[Sequence[str]] = (), required: Sequence[str] = (), allowed: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """rule, n: how many rows (for unique: keys) break each rule that is broken."""
    parts = []
    for keys in unique:
        broken = df.groupBy(*keys).count().where("count > 1")
        parts.append(broken.agg(F.count(F.lit(1)).alias("n")).withColumn("rule", F.lit(f"unique {', '.join(keys)}")))
    checks = [F.count_if(F.col(c).isNull()).alias(f"not null {c}") for c in required]
    checks += [F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(*values)).alias(f"check {c}") for c, values in (allowed or {}).items()]
    names = [f"not null {c}" for c in required] + [f"check {c}" for c in (allowed or {})]
    if checks:
        parts.append(df.agg(*checks).select(F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(f"`{n}`"))])).alias("rule", "n")))
    out = parts[0].select("rule", "n")
    for part in parts[1:]:
        out = out.unionByName(part.select("rule", "n"))
    return out.where("n > 0")


def orphans(child: DataFrame, parent: DataFrame, foreign: str, key: str) -> DataFrame:
    """Rows of child without a parent."""
    return child.join(parent.select(F.col(key).alias(foreign)), foreign, "left_anti")


def cascade(child: DataFrame, deleted: DataFrame, foreign: str, key: str) -> DataFrame:
    """child without the rows of deleted parents."""
    return child.join(deleted.select(F.col(key).alias(foreign)).distinct(), foreign, "left_anti")
