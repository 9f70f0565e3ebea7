"""Reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line without outer white space, A-Z lower-cased, held as two independent 64-bit hashes.  The
index is a log: each batch appends (key, change of its count) to the exact table, in order of shards, and new versions
of the filters that it touched.  Nothing else is rewritten until DELTAS batches have gathered and are summed up.

The filters decide what is read.  A batch counts its keys first (so a key in a third of all documents arrives as one
row) and asks the filter of each shard: keys that it denies are new for certain; only those that it may hold are looked
up, in the shards that gave such an answer.  A key that comes to life is added to its shard's filter, one whose count
reaches zero is taken out; a filter that is full is built anew from its shard's exact rows.  Documents have entries of
their own, so a batch that is inserted twice counts once, and deleting what was never inserted changes nothing.  Insert
then delete of the same documents gives the counts and answers of the index before.

`clean` asks a filter too: where frequent keys are few, each Arrow batch of texts asks a broadcast cuckoo filter of
them, and only lines that it may hold are searched in the exact list; texts don't move.  Where they are over FREQUENT,
documents meet them in a join.

Defined results: null or empty text is one empty line, which has no key and always stays; a document is a distinct
doc_id (null is one of them), repeated rows of it count once and are each cleaned; a document is to be deleted with the
texts that it was inserted with; an empty table gives an empty index and an empty result; extra columns are kept by
`clean` and are never read, but n_lines and n_dropped are replaced.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, kept, line_key, lower_ascii, small_batches, stored, text_of, word_count

SHARD_KEYS = 65_536
#: Batches after which the exact table is summed up; frequent keys up to which they are broadcast (16 bytes each).
DELTAS, FREQUENT = 16, 1_000_000
#: Keys that a task writes to the log.
FILE_KEYS = 8 * SHARD_KEYS
EXACT = "shard int, kind int, k1 long, k2 long, n long"
FILTERS = "shard int, version int, filter binary"
LINE, DOCUMENT = 0, 1
SLOTS = 4


class CuckooFilter:
    """Partial-key cuckoo filter: 16-bit tags, four slots a bucket, a power of two of buckets; tag 0 is an empty slot."""

    def __init__(self, buckets: int, cells: np.ndarray | None = None):
        self.mask = buckets - 1
        self.cells = np.zeros((buckets, SLOTS), np.uint16) if cells is None else cells

    @classmethod
    def of_size(cls, keys: int) -> CuckooFilter:
        return cls(1 << max(2, int(np.ceil(np.log2(max(1, keys) / (SLOTS * 0.85))))))

    @classmethod
    def from_bytes(cls, blob: bytes) -> CuckooFilter:
        cells = np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy()
        return cls(len(cells), cells)

    def to_bytes(self) -> bytes:
        return self.cells.tobytes()

    def _places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        tag = ((k2.astype(np.uint64) >> np.uint64(20)) & np.uint64(0xFFFF)).astype(np.int64)
        tag[tag == 0] = 1
        first = (k1.astype(np.uint64) & np.uint64(self.mask)).astype(np.int64)
        return tag, first, self._other(first, tag)

    def _other(self, bucket, tag):
        return (bucket ^ (tag * 0x5BD1E995)) & self.mask

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        tag, a, b = self._places(k1, k2)
        return (self.cells[a] == tag[:, None]).any(1) | (self.cells[b] == tag[:, None]).any(1)

    def _put(self, tag: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Enters as many tags as their buckets have room for; whether each was."""
        order = np.argsort(bucket, kind="stable")
        place = bucket[order]
        rank = np.arange(len(place)) - np.searchsorted(place, place)
        slots = np.argsort(self.cells[place] != 0, axis=1, kind="stable")  # free ones first
        fits = rank < (self.cells[place] == 0).sum(1)
        self.cells[place[fits], slots[fits, rank[fits]]] = tag[order[fits]]
        done = np.zeros(len(tag), bool)
        done[order[fits]] = True
        return done

    def add(self, k1: np.ndarray, k2: np.ndarray) -> bool:
        """False if it is too full; it is then to be built anew from the exact table."""
        tag, a, b = self._places(k1, k2)
        left = ~self._put(tag, a)
        tag, b = tag[left], b[left]
        left = ~self._put(tag, b)
        tag, b = tag[left], b[left]
        cells, rng = self.cells, np.random.default_rng(len(k1))
        for tag, bucket in zip(tag.tolist(), b.tolist(), strict=True):
            for _ in range(500):
                slot = int(rng.integers(SLOTS))
                tag, cells[bucket, slot] = int(cells[bucket, slot]), tag
                bucket = int(self._other(bucket, tag))
                free = np.flatnonzero(cells[bucket] == 0)
                if len(free):
                    cells[bucket, free[0]] = tag
                    break
            else:
                return False
        return True

    def remove(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Take out one tag for each key, all of which must have been added."""
        tag, a, b = self._places(k1, k2)
        pair = np.minimum(a, b) * 65_536 + tag  # keys of one pair and tag share its copies: one of them at a time
        while len(tag):
            _, at = np.unique(pair, return_index=True)
            t, here = tag[at], a[at]
            found = self.cells[here] == t[:, None]
            here = np.where(found.any(1), here, b[at])
            found = self.cells[here] == t[:, None]
            hit = found.any(1)
            self.cells[here[hit], found[hit].argmax(1)] = 0
            rest = np.ones(len(tag), bool)
            rest[at] = False
            tag, a, b, pair = tag[rest], a[rest], b[rest], pair[rest]

    @classmethod
    def built(cls, k1: np.ndarray, k2: np.ndarray) -> CuckooFilter:
        out = cls.of_size(len(k1))
        while not out.add(k1, k2):
            out = cls((out.mask + 1) * 2)
        return out


_SPACES = SPACES.encode()
_SECOND_SEED = xxhash.xxh64_intdigest(struct.pack("<i", 1), 42)


def key_hashes(key: bytes) -> tuple[int, int]:
    """xxhash64(key) and xxhash64(1, key) of a key's UTF-8, unsigned."""
    return xxhash.xxh64_intdigest(key, 42), xxhash.xxh64_intdigest(key, _SECOND_SEED)


def _document_hashes(doc_id: str = "doc_id") -> list[Column]:
    return [F.xxhash64(F.lit(2), doc_id).alias("k1"), F.xxhash64(F.lit(3), doc_id).alias("k2")]


def document_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2), once for each row of docs and key in it."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [line_keys(t) for t in batch.column(1).to_pylist()]
            hashes = {k: key_hashes(k) for own in found for k in own}
            owner = np.repeat(np.arange(len(found)), [len(own) for own in found])
            both = np.array([hashes[k] for own in found for k in own], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(both[:, 0]), pa.array(both[:, 1])], ["doc_id", "k1", "k2"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def line_keys(text: str | None) -> set[bytes]:
    """The keys of a text's lines; bytes.lower knows ASCII only, which is what is asked for."""
    return {k for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n") if (k := x.strip(_SPACES).lower())}


def _int64(df: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return df["k1"].to_numpy(np.int64), df["k2"].to_numpy(np.int64)


class LineIndex:
    """One version of the index; insert and delete return the next version and leave this one as it is.

    exact and filters are the folders of the log's parts, version their number.  The first insert sets the number of
    shards; a later one that would more than quadruple their size deals all keys out over more."""

    def __init__(self, spark: SparkSession, exact: tuple[str, ...] = (), filters: tuple[str, ...] = (), shards: int = 0, version: int = 0):
        self.spark, self.exact, self.filters, self.shards, self.version = spark, exact, filters, shards, version

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LineIndex:
        """The version saved at path."""
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        return cls(spark, (f"{path}/exact",), (f"{path}/filters",), about["shards"], about["version"])

    def save(self, path: str) -> None:
        self._sums().write.parquet(f"{path}/exact")
        self._latest().write.parquet(f"{path}/filters")
        self.spark.createDataFrame([(json.dumps({"shards": self.shards, "version": self.version}),)], "value string").write.text(f"{path}/about")

    def insert(self, docs: DataFrame) -> LineIndex:
        """Documents that are in the index already are left out."""
        return self._apply(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """Documents that aren't in the index are left out; the others must have the texts that were inserted."""
        return self._apply(docs, -1)

    def references(self) -> DataFrame:
        """(k1, k2, refs) of every key in some document."""
        return self._sums().where(F.col("kind") == LINE).select("k1", "k2", F.col("n").alias("refs"))

    def _sums(self) -> DataFrame:
        """The exact table: shard, kind, k1, k2, n > 0; keys are unique in each part of the log."""
        rows = self.spark.read.schema(EXACT).parquet(*self.exact) if self.exact else self.spark.createDataFrame([], EXACT)
        if len(self.exact) > 1:
            rows = rows.groupBy("shard", "kind", "k1", "k2").agg(F.sum("n").alias("n")).where("n <> 0")
        return rows

    def _latest(self) -> DataFrame:
        """The filters: shard, version, filter."""
        rows = self.spark.read.schema(FILTERS).parquet(*self.filters) if self.filters else self.spark.createDataFrame([], FILTERS)
        if len(self.filters) > 1:
            rows = rows.groupBy("shard").agg(F.max("version").alias("version"), F.max_by("filter", "version").alias("filter"))
        return rows

    def _known(self, keys: DataFrame) -> DataFrame | None:
        """(kind, k1, k2, refs) of those of keys (shard, kind, k1, k2) that are in the index; None for none.

        The filters are asked first; only what they may hold is joined with the exact table, of which Parquet's
        statistics skip the row groups of other shards."""
        if not self.filters:
            return None

        def ask(new: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            if not len(filters):
                return new[:0]
            return new[CuckooFilter.from_bytes(filters["filter"].iloc[0]).contains(*_int64(new))]

        maybe = kept(keys.groupBy("shard").cogroup(self._latest().groupBy("shard")).applyInPandas(ask, "shard int, kind int, k1 long, k2 long"))
        touched = [r[0] for r in maybe.select("shard").distinct().limit(1001).collect()]
        exact = self._sums()
        if len(touched) <= 1000:
            exact = exact.where(F.col("shard").isin(touched))
        found = kept(exact.join(maybe, ["shard", "kind", "k1", "k2"]).select("kind", "k1", "k2", F.col("n").alias("refs")))
        maybe.unpersist()
        return found

    def _sharded(self, keys: DataFrame) -> DataFrame:
        return keys.withColumn("shard", F.pmod(F.shiftright("k1", 24), F.lit(max(1, self.shards))).cast("int"))

    def _apply(self, docs: DataFrame, sign: int) -> LineIndex:
        ids = docs.select(*_document_hashes()).distinct()
        pairs = document_keys(docs).distinct()  # spread by document too, so that no key is hot
        present = self._known(self._sharded(ids.withColumn("kind", F.lit(DOCUMENT))).select("shard", "kind", "k1", "k2"))
        if present is None and sign < 0:
            return self
        if present is not None:
            how = "left_anti" if sign > 0 else "left_semi"
            own = present.select(F.col("k1").alias("d1"), F.col("k2").alias("d2"))
            ids = ids.join(own, (F.col("k1") == F.col("d1")) & (F.col("k2") == F.col("d2")), how)
            a, b = (F.xxhash64(F.lit(x), "doc_id") for x in (2, 3))
            pairs = pairs.join(own, (a == F.col("d1")) & (b == F.col("d2")), how)
        counts = pairs.groupBy("k1", "k2").agg((F.count(F.lit(1)) * sign).alias("n")).withColumn("kind", F.lit(LINE))
        changes = kept(counts.unionByName(ids.withColumn("n", F.lit(sign).cast("long")).withColumn("kind", F.lit(DOCUMENT))))
        n, base = changes.count(), self
        if not self.shards:
            base = LineIndex(self.spark, shards=max(1, -(-n // SHARD_KEYS)))
        elif (total := n + self._sums().count()) > 4 * SHARD_KEYS * self.shards:
            base = self.resharded(-(-total // SHARD_KEYS))
        elif len(self.exact) >= DELTAS:
            base = self.resharded(self.shards)
        after = base._with(changes, n)
        changes.unpersist()
        if present is not None:
            present.unpersist()
        return after

    def resharded(self, shards: int) -> LineIndex:
        """The same keys and counts in one part, over another number of shards."""
        rows = self._sums().drop("shard")
        return LineIndex(self.spark, shards=shards, version=self.version)._with(rows, rows.count())

    def _with(self, changes: DataFrame, total: int) -> LineIndex:
        """The next version, with the `total` changes (kind, k1, k2, n) added."""
        rows = self._sharded(changes)
        known = self._known(rows.select("shard", "kind", "k1", "k2"))
        files = max(1, min(self.shards, -(-total // FILE_KEYS)))
        by_shard = rows.select("shard", "kind", "k1", "k2", "n").repartition(files, "shard").sortWithinPartitions("shard")
        part = _folder(stored(by_shard, "exact"), "exact")
        refs = F.lit(0).cast("long")
        if known is not None:
            rows, refs = rows.join(known, ["kind", "k1", "k2"], "left"), F.coalesce("refs", F.lit(0))
        turned = rows.select("shard", "k1", "k2", (refs + F.col("n") > 0).alias("lives"), (refs > 0).alias("lived")).where("lives <> lived")
        version = self.version + 1

        def update(new: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            if not len(new):
                return pd.DataFrame({"shard": pd.Series(dtype="int32"), "version": pd.Series(dtype="int32"), "filter": pd.Series(dtype=object)})
            born, gone = new[new["lives"]], new[~new["lives"]]
            if len(filters):
                cuckoo = CuckooFilter.from_bytes(filters["filter"].iloc[0])
                cuckoo.remove(*_int64(gone))
                blob = cuckoo.to_bytes() if cuckoo.add(*_int64(born)) else None  # full: built below
            else:
                blob = CuckooFilter.built(*_int64(born)).to_bytes()
            return pd.DataFrame({"shard": [new["shard"].iloc[0]], "version": [version], "filter": [blob]})

        made = turned.repartition(files, "shard").groupBy("shard").cogroup(self._latest().repartition(files, "shard").groupBy("shard")).applyInPandas(update, FILTERS)
        made = stored(made, "filters")
        after = LineIndex(self.spark, (*self.exact, part), (*self.filters, _folder(made, "filters")), self.shards, version)
        full = [r[0] for r in made.where("filter is null").select("shard").collect()]  # a few numbers, of at most all shards
        if full:
            rows = after._sums().where(F.col("shard").isin(full)).select("shard", "k1", "k2")

            def build(keys: pd.DataFrame) -> pd.DataFrame:
                return pd.DataFrame({"shard": [keys["shard"].iloc[0]], "version": [version + 1], "filter": [CuckooFilter.built(*_int64(keys)).to_bytes()]})

            rebuilt = stored(rows.groupBy("shard").applyInPandas(build, FILTERS), "filters")
            after = LineIndex(self.spark, after.exact, (*after.filters, _folder(rebuilt, "filters")), self.shards, version + 1)
        if known is not None:
            known.unpersist()
        return after

    def clean(self, docs: DataFrame, min_docs: int, spare: bool = False) -> DataFrame:
        """docs without the lines whose key is in at least min_docs indexed documents, plus n_lines and n_dropped.

        With `spare`, a document that would lose over half of its words keeps the lines it carries: those of which it has
        the smallest doc_id.  So of a text whose every line is frequent one document stays whole."""
        frequent = kept(self.references().where(F.col("refs") >= min_docs).select("k1", "k2"))
        docs = docs.drop("n_lines", "n_dropped")
        return _clean_by_filter(docs, frequent, spare) if frequent.count() <= FREQUENT else _clean_by_join(docs, frequent, spare)


def _folder(written: DataFrame, name: str) -> str:
    """The folder that stored() wrote under that name."""
    file = written.inputFiles()[0]
    return file[: file.rindex(f"/{name}/") + len(name) + 1]


def _carriers(hits: DataFrame) -> DataFrame:
    """(k1, k2, __first: the smallest doc_id that has the key)."""
    return hits.groupBy("k1", "k2").agg(F.min("doc_id").alias("__first"))


class Frequent:
    """Frequent keys as a cuckoo filter and a sorted list, with the doc_id that carries each, or None."""

    def __init__(self, k1: np.ndarray, k2: np.ndarray, carriers: list | None):
        order = np.lexsort((k2, k1))
        self.k1, self.k2 = k1[order], k2[order]
        self.carriers = None if carriers is None else [carriers[i] for i in order]
        self.filter = CuckooFilter.built(k1.view(np.int64), k2.view(np.int64))

    def find(self, keys: list[bytes]) -> list[int]:
        """The place of each key in the list, -1 for none."""
        out = np.full(len(keys), -1)
        if len(keys) and len(self.k1):
            hashes = np.array([key_hashes(k) for k in keys], np.uint64)
            asked = np.flatnonzero(self.filter.contains(hashes[:, 0].view(np.int64), hashes[:, 1].view(np.int64)))
            a, b = hashes[asked, 0], hashes[asked, 1]
            first = np.searchsorted(self.k1, a)
            for step in range(4):  # keys that share their first hash are next to each other
                at = np.minimum(first + step, len(self.k1) - 1)
                hit = (self.k1[at] == a) & (self.k2[at] == b)
                out[asked[hit]] = at[hit]
        return out.tolist()

    def clean(self, texts: list, ids: list) -> tuple[list, list, list]:
        """Texts without lines of frequent keys, their numbers of lines, and of dropped ones."""
        cut = [(t or "").encode("utf-8", "surrogatepass").split(b"\n") for t in texts]
        keys = [[x.strip(_SPACES).lower() for x in lines] for lines in cut]
        distinct = list({k for own in keys for k in own if k})
        place = dict(zip(distinct, self.find(distinct), strict=True))
        place[b""] = -1
        out, n_lines, n_dropped = [], [], []
        for doc, lines, own in zip(ids, cut, keys, strict=True):
            at = [place[k] for k in own]
            left = [x for x, i in zip(lines, at, strict=True) if i < 0]
            if self.carriers is not None and len(left) < len(lines):
                carried = [i < 0 or self.carriers[i] == doc for i in at]
                if sum(carried) > len(left) and 2 * len(b"\n".join(left).split()) < len(b"\n".join(lines).split()):
                    left = [x for x, c in zip(lines, carried, strict=True) if c]
            out.append(b"\n".join(left))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(left))
        return out, n_lines, n_dropped


def _clean_by_filter(docs: DataFrame, frequent: DataFrame, spare: bool) -> DataFrame:
    """Texts stay where they are; at most FREQUENT keys are broadcast."""
    rows = frequent
    if spare:
        rows = _carriers(document_keys(docs).join(frequent, ["k1", "k2"]))
    table = rows.toArrow()
    frequent.unpersist()
    k1, k2 = (table.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("k1", "k2"))
    shared = docs.sparkSession.sparkContext.broadcast(Frequent(k1, k2, table.column("__first").to_pylist() if spare else None))
    names, extra = docs.columns, [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    schema = T.StructType([T.StructField("text", T.StringType()) if f.name == "text" else f for f in docs.schema] + extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda name: batch.column(names.index(name))
            texts, n_lines, n_dropped = shared.value.clean(column("text").to_pylist(), column("doc_id").to_pylist() if spare else [None] * len(batch))
            new = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([new if c == "text" else column(c) for c in names] + [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [f.name for f in schema])

    small_batches(docs.sparkSession)
    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, schema)


def _clean_by_join(docs: DataFrame, frequent: DataFrame, spare: bool) -> DataFrame:
    """Texts meet the frequent keys of their own document."""
    hits = document_keys(docs).join(frequent, ["k1", "k2"])
    sets = [F.collect_set("k1").alias("__a"), F.collect_set("k2").alias("__b")]
    if spare:
        hits = kept(hits)
        hits = hits.join(kept(_carriers(hits)), ["k1", "k2"]).withColumn("__own", F.col("doc_id").eqNullSafe(F.col("__first")))
        sets += [F.collect_set(F.when(F.col("__own"), F.col(k))).alias(name) for k, name in (("k1", "__c"), ("k2", "__d"))]
    drops = hits.groupBy(F.col("doc_id").alias("__id")).agg(*sets)
    joined = docs.join(drops, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    lines = joined.withColumn("__lines", F.split(text_of(), "\n", -1))

    def among(key: Column, a: str, b: str) -> Column:
        return F.array_contains(a, F.xxhash64(key)) & F.array_contains(b, F.xxhash64(F.lit(1), key))

    def stays(line: Column) -> Column:
        key = line_key(lower_ascii(line))
        return (key == "") | ~among(key, "__a", "__b")

    def carried(line: Column) -> Column:
        key = line_key(lower_ascii(line))
        return (key == "") | ~among(key, "__a", "__b") | among(key, "__c", "__d")

    out = lines.withColumn("__kept", F.when(F.col("__a").isNull(), F.col("__lines")).otherwise(F.filter("__lines", stays)))
    if spare:
        owns = F.size("__c") > 0  # null where nothing is dropped
        poor = F.when(owns, 2 * word_count(F.array_join("__kept", "\n")) < word_count(text_of()))
        out = out.withColumn("__kept", F.when(poor, F.filter("__lines", carried)).otherwise(F.col("__kept"))).drop("__c", "__d")
    out = out.withColumn("text", F.array_join("__kept", "\n"))
    out = out.withColumn("n_lines", F.size("__lines").cast("long")).withColumn("n_dropped", F.col("n_lines") - F.size("__kept"))
    return out.drop("__id", "__a", "__b", "__lines", "__kept")
