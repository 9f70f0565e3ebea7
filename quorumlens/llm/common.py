"""Shared pieces of the training-data operators: text splitting, scratch tables, Arrow limits."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The six characters that separate words: space, tab, newline, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def text_of(col: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, LOWER)


def line_key(line: Column) -> Column:
    """A line without outer white space, A-Z in lower case."""
    return F.btrim(line, F.lit(SPACES))


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-space characters (long)."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def once(value: Column) -> Column:
    """value, evaluated where it stands.

    Filters, also those that Spark derives from explode, are pushed below a projection with its expressions put in
    place of its columns; inside a lambda such an expression is evaluated for every element.  One that reads the
    partition's number isn't moved."""
    return F.when(F.spark_partition_id() >= 0, value)


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.  Unset, it is a local folder, which only
    a local session may use."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/quorumlens/{uuid.uuid4().hex}"


def tasks(spark: SparkSession) -> int:
    """How many tasks a shuffle of this session has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df written to the shared scratch folder and read back: cuts lineage, survives lost executors, has a known size."""
    path = f"{scratch(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


FILE_ROWS = 50_000


def stored_few(df: DataFrame, most: int) -> DataFrame:
    """stored(), for a narrow table of at most `most` rows, in files of about FILE_ROWS rows, or fewer files if its
    shuffle has fewer tasks.  What multiplies rows should be dealt out again first, see tasks()."""
    return stored(df.coalesce(max(1, -(-most // FILE_ROWS))))


_KEPT: list[DataFrame] = []


def kept(df: DataFrame) -> DataFrame:
    """df in the executors' memory or on their disks, filled now, so that its size is known to the plans that use it.

    Its lineage stays: what a lost executor held is computed again.  For tables of a few steps from their input that
    several plans read; results of loops and of unstable order are stored() instead, as are those that would stack up:
    a plan's text, which Spark makes for each query, holds those of all tables kept below it.  Operators unpersist()
    what no later plan reads; what their results read stays until release()."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    df.count()
    _KEPT.append(df)
    return df


def release() -> None:
    """Unpersist all that kept() holds, and nothing else.  A result that reads one of these tables stays right, since
    they have their lineage, but computes it again: release when results are written."""
    while _KEPT:
        _KEPT.pop().unpersist()


def smallest_hashes(df: DataFrame, group: str, hash_col: str, most: int) -> DataFrame:
    """(group, hash) of about the `most` smallest distinct hashes of each group, never more.

    A threshold from the group's row count lets through about twice as many rows, which are reduced to distinct hashes
    before they are shuffled and ranked; so no task meets more than a small multiple of `most`.  (Where hashes repeat in
    most rows of a group, fewer than `most` may be left.)"""
    counts = kept(df.groupBy(F.col(group).alias("__group")).agg(F.count(F.lit(1)).alias("__n")))
    share = F.shiftrightunsigned(F.col(hash_col), 11).cast("double") * F.lit(2.0**-53)
    few = df.join(broadcast_few(counts), F.col(group) == F.col("__group")).where(share * F.col("__n") < F.lit(2.0 * most + 64)).select(group, hash_col).distinct()
    return few.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(F.shiftrightunsigned(hash_col, 1), hash_col))).where(F.col("__r") <= most).drop("__r")


def first_texts(rows: DataFrame, most_bytes: int) -> list:
    """Rows in order up to a total length of their `text`, so that the driver's share is bounded in bytes too."""
    out, total = [], 0
    for row in rows.toLocalIterator():
        total += 4 * len(row["text"])
        if total > most_bytes:
            break
        out.append(row)
    return out


def sample_texts(documents: DataFrame, sample: DataFrame, rows: int, most_chars: int, most_bytes: int) -> list:
    """The driver's rows (h, text, and what else sample has but doc_id) of the documents that sample (doc_id, h, ...; at most
    `rows` rows but for equal hashes) names, in order of h: those of at most most_chars characters, as many as most_bytes
    hold.  Lengths are fetched first, then only the texts that fit."""
    few = F.broadcast(stored_few(sample, rows))
    texts = documents.where(F.col("text").isNotNull() & (F.char_length("text") <= most_chars)).select("doc_id", "text")
    sizes = texts.select("doc_id", F.octet_length("text").alias("n")).join(few, "doc_id").groupBy("h").agg(F.sum("n").alias("n"))
    last, total = None, 0
    for row in sizes.orderBy("h").limit(rows).collect():
        total += row["n"]
        if total > most_bytes:
            break
        last = row["h"]
    if last is None:
        return []
    names = ["h", "text", *[c for c in sample.columns if c not in ("doc_id", "h")]]
    return sorted(texts.join(few.where(F.col("h") <= last), "doc_id").select(*names).collect(), key=lambda r: (r["h"], r["text"]))


BROADCAST_ROWS = 200_000


def broadcast_few(df: DataFrame, n: int | None = None) -> DataFrame:
    """df, a narrow table that is kept() or stored(), to be broadcast if it has BROADCAST_ROWS rows at most; a larger one
    is joined as Spark sees fit.  n: its number of rows or an upper bound, if that is known."""
    return F.broadcast(df) if (df.count() if n is None else n) <= BROADCAST_ROWS else df


def drop_stored(df: DataFrame) -> None:
    """Remove the files of a table that stored() wrote and that no later plan reads."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 500, size: int = 64 << 20) -> None:
    """Arrow batches of whole texts stay small, in rows and in bytes, so that a Python worker's memory depends on the longest
    text, not on how many long ones are side by side.  Plans read these settings when they run, so they stay set."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_python(df: DataFrame, source: str, fn: Callable[[list], list[pa.Array]], fields: list[T.StructField], drop: tuple = (), arrow: bool = False) -> DataFrame:
    """df without the columns `drop`, plus `fields`: what fn makes of each Arrow batch's `source` values (a list, or with
    `arrow` the Arrow array).

    The other columns pass through as Arrow buffers, so that no type or null changes on the way."""
    kept = [c for c in df.columns if c not in drop]
    schema = T.StructType([df.schema[c] for c in kept] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            values = batch.column(names.index(source))
            new = fn(values if arrow else values.to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(names.index(c)) for c in kept] + new, kept + [f.name for f in fields])

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def packed(df: DataFrame, *own: str) -> DataFrame:
    """The columns own and, as one column __row, all others, so that their names meet no other's."""
    return df.select(*own, F.struct(F.lit(0).alias("__"), *[F.col(f"`{c}`") for c in df.columns if c not in own]).alias("__row"))


def unpacked(column: str, *own: str) -> Column:
    """A column of the frame that was packed."""
    return F.col(column if column in own else f"__row.`{column}`").alias(column)
