"""Tables dealt out by hash of their key, of which a merge reads and writes only the buckets that its batch touches.

A table is a Parquet folder partitioned by bucket.  A merge finds the batch's buckets (at most as many numbers as there are
buckets), reads those by partition pruning, and replaces them by Spark's dynamic partition overwrite; files of other
buckets aren't opened, and keep their names.

The new contents are written beside the table first and put in place from there, so that a job that dies while it
replaces buckets loses nothing: the next merge, or recover(), puts them in place again.  Putting in place twice is doing it
once, as is merging a batch twice.  One writer at a time; readers see some buckets before others while a merge goes on.

A bucket is one file.  Choose their number so that one bucket fits a task, it can't be changed later: buckets_for() gives it
from the rows that are expected.  A merge's joins have as many partitions as it has buckets at least, and a bucket is a
partition of what is written, so that a task's share doesn't grow with the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .upsert import upsert

BUCKET = "__bucket"
#: Rows a bucket.
ROWS = 200_000
PARTITIONS = "spark.sql.shuffle.partitions"
#: The folder of new contents; readers pass over names that begin so.
MERGE = "_merge"


def buckets_for(rows: int, least: int = 8) -> int:
    """A number of buckets for so many rows."""
    return max(least, -(-rows // ROWS))


@contextmanager
def partitions(spark: SparkSession, least: int) -> Iterator[None]:
    """Shuffles that are planned and run in here have so many partitions at least."""
    before = spark.conf.get(PARTITIONS)
    spark.conf.set(PARTITIONS, str(max(int(before), least)))
    try:
        yield
    finally:
        spark.conf.set(PARTITIONS, before)


class Buckets:
    """The table at path, with columns of schema, unique on keys."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], number: int = 64):
        self.spark, self.path, self.keys, self.number = spark, path.rstrip("/"), list(keys), number
        self.schema = T.StructType([f for f in schema.fields if f.name != BUCKET])

    def _place(self, name: str = ""):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _exists(self, name: str = "") -> bool:
        store, place = self._place(name)
        return store.exists(place)

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(path)

    def dealt(self, rows: DataFrame) -> DataFrame:
        """rows with their bucket; keys are hashed as text, so that their types may differ from the table's."""
        own = F.pmod(F.xxhash64(*[F.col(k).cast(self.schema[k].dataType).cast("string") for k in self.keys]), F.lit(self.number))
        return rows.withColumn(BUCKET, own.cast("int"))

    def read(self) -> DataFrame:
        """All rows; an empty frame before the first merge."""
        self.recover()
        return (self._read(self.path) if self._exists() else self.spark.createDataFrame([], self.schema)).select(*self.schema.names)

    def merge(self, batch: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> list[int]:
        """Merge a batch that is unique on the keys; the buckets written.  combine(existing, new): the next rows, by default
        an upsert; it may change and add rows of the keys it is given, and leave none out."""
        with partitions(self.spark, self.number):
            return self._merge(batch, combine)

    def _merge(self, batch: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame] | None) -> list[int]:
        self.recover()
        batch = self.dealt(batch).persist(StorageLevel.DISK_ONLY)
        try:
            touched = sorted(r[0] for r in batch.select(BUCKET).distinct().collect())
            if not touched:
                return []
            new = batch.drop(BUCKET)
            have = self.existing(touched).drop(BUCKET) if self._exists() else self.spark.createDataFrame([], self.schema)
            out = combine(have, new) if combine else upsert(have, new, self.keys)
            out = self.dealt(out.select(*[F.col(c).cast(self.schema[c].dataType).alias(c) for c in self.schema.names]))
            out.repartitionById(self.number, BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/{MERGE}")
        finally:
            batch.unpersist()
        self.recover()
        return touched

    def existing(self, touched: Sequence[int]) -> DataFrame:
        """Rows of these buckets, with the bucket."""
        return self._read(self.path).where(F.col(BUCKET).isin(*touched))

    def recover(self) -> None:
        """Puts contents that a merge has completely written in place; what is incomplete is thrown away."""
        if self._exists(f"{MERGE}/_SUCCESS"):
            self._put_in_place()
        if self._exists(MERGE):
            store, place = self._place(MERGE)
            store.delete(place, True)

    def _put_in_place(self) -> None:
        rows = self._read(f"{self.path}/{MERGE}")
        rows.repartitionById(self.number, BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
