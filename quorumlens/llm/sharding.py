"""Sharding by rendezvous hashing of stable record keys over weighted shards (DataFrame functions only).

Each (key, shard) pair gets u in (0, 1) from XXH64; the record goes to the shard with the largest weight / -ln(u).
A new shard can only win records for itself, so growing from n to n + 1 shards moves about 1 / (n + 1) of the
records and none between old shards.

Places in a shard ("slots") come from two-level counting: records of a shard are dealt over BUCKETS ranges of a hash of
key and content, bucket counts are summed up (shards x BUCKETS rows at most, broadcast up to BROADCAST of them), and
rows are numbered within a bucket only.  No task ever holds a shard.  A key that holds a third of all rows is spread by
its rows' contents; rows that are equal altogether, whose order is no matter, are dealt out by number where a bucket
is crowded by them.

Defined results: a null key is hashed as the seed and so is stable too; null text has no bytes; repeated rows get
slots of their own; an empty table gives an empty result; extra input columns are ignored by `layout` and kept by
`assign`, whose own columns replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, stored, text_of

BUCKETS = 1024
#: Counts up to which they are broadcast; rows of a bucket from which one of CROWDED times the mean is dealt out.
BROADCAST, ROWS, CROWDED = 1_000_000, 100_000, 8


def _score(key: Column, shard: Column, weight: Column) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, shard), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    return weight / -F.log(u)


def _best(key: Column, weights: Sequence[float]) -> Column:
    """struct(score, minus shard) of the winning shard; equal scores go to the lower shard."""
    shards = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)])
    return F.array_max(F.transform(shards, lambda s: F.struct(_score(key, s["i"], s["w"]).alias("score"), (-s["i"]).alias("minus"))))


def assign(df: DataFrame, key: str, weights: Sequence[float], grown_weight: float | None = None) -> DataFrame:
    """df with shard int, and grown_shard int: the shard if one more of weight grown_weight joined (null if not asked for)."""
    best = df.withColumn("__best", _best(F.col(key), weights))
    n = len(weights)
    grown = F.lit(None).cast("int")
    if grown_weight is not None:
        grown = F.when(_score(F.col(key), F.lit(n), F.lit(float(grown_weight))) > F.col("__best.score"), F.lit(n)).otherwise(-F.col("__best.minus"))
    return best.withColumn("shard", (-F.col("__best.minus")).cast("int")).withColumn("grown_shard", grown.cast("int")).drop("__best")


def with_slots(df: DataFrame, shard: str, order: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """df with slot long: gapless from 0 within each shard, in order of (bucket, order); rows are dealt into buckets by a
    hash of all columns in order.

    df is evaluated twice: once pruned to these columns for the counts, once for the rows."""
    rows = df.withColumn("__bucket", F.pmod(F.xxhash64(*order, F.lit(7)), F.lit(buckets)).cast("int"))
    counts = kept(rows.groupBy(shard, "__bucket").agg(F.count(F.lit(1)).alias("__n")))
    most, mean, n = counts.agg(F.max("__n"), F.avg("__n"), F.count(F.lit(1))).first()
    if n and most > ROWS and most > CROWDED * mean:
        # numbered rows are written, as they may be numbered otherwise when they are computed again
        counts.unpersist()
        rows = stored(rows.withColumn("__copy", F.pmod(F.monotonically_increasing_id(), F.lit(buckets)).cast("int")))
        crowded = rows.groupBy(shard, "__bucket").agg(F.count(F.lit(1)).alias("__m")).where(F.col("__m") > ROWS).drop("__m")
        rows = rows.join(F.broadcast(crowded.withColumn("__hot", F.lit(True))) if n <= BROADCAST else crowded.withColumn("__hot", F.lit(True)), [shard, "__bucket"], "left")
        rows = rows.withColumn("__bucket", F.col("__bucket") * buckets + F.when(F.col("__hot"), F.col("__copy")).otherwise(F.lit(0))).drop("__copy", "__hot")
        counts = kept(rows.groupBy(shard, "__bucket").agg(F.count(F.lit(1)).alias("__n")))
        n = counts.count()
    before = Window.partitionBy(shard).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy(shard, "__bucket").orderBy(*order)
    placed = rows.withColumn("__row", F.row_number().over(within)).join(F.broadcast(starts) if n <= BROADCAST else starts, [shard, "__bucket"])
    return placed.withColumn("slot", (F.col("__start") + F.col("__row") - 1).cast("long")).drop("__bucket", "__row", "__start")


def layout(documents: DataFrame, weights: Sequence[float], grown_weight: float) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of documents."""
    text = text_of()
    rows = documents.select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    sharded = assign(rows, "doc_id", weights, grown_weight)
    slots = with_slots(sharded, "shard", ["doc_id", "text_crc32", "size"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(documents: DataFrame, weights: Sequence[float], path: str) -> None:
    """Whole documents as Parquet under path/shard=N; tasks write to all shards, so no shard passes through one task."""
    assign(documents, "doc_id", weights).drop("grown_shard").write.partitionBy("shard").parquet(path)
