"""SimHash near-dedup by multi-index hashing.

A fingerprint is the bitwise majority of the XXH64 (seed 42) of a text's three-word shingles.  It is cut into two
32-bit segments; two fingerprints within two bits agree in one segment up to one bit.  Each fingerprint is entered in
both segment tables and probes them with a Hamming ball of radius one: its own value, and its value with one zero bit
set (of two values that differ in one bit, exactly one has the zero).  Matches are verified over all 64 bits.

Equal fingerprints are one node, however many documents carry them.  A segment value with over BUCKET fingerprints
would emit the square of their number; such buckets are taken out of the tables and every fingerprint that is in or
probes one is instead linked through its whole-fingerprint ball: two fingerprints are within two bits if and only if
their closed balls of radius one meet, and a meeting point has 65 members at most.  No link is lost and none is extra.

Components come from alternating large-star and small-star rounds.

Defined results: null, empty or blank text has fingerprint zero; repeated rows are linked as equal; doc_id may be of any
type with an order; null doc_ids take part but are no component_id unless a component has no other; an empty table gives
an empty result; extra columns are ignored by `near_duplicates` and kept by `one_of_each`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_few, drop_stored, kept, stored_few, tasks, text_of, with_python

SHINGLE = 3
BUCKET = 64


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each shingle in order; bytes.lower and bytes.split know ASCII only, which is what is asked for."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, 42) for s in shingles], np.uint64)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash."""
    return majority(shingle_hashes(text, size))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(documents: DataFrame, *others: Column) -> DataFrame:
    """(doc_id, the others, fp: the fingerprint as a signed long) of every row."""

    def run(texts: list) -> list[pa.Array]:
        return [pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))]

    rows = documents.select("doc_id", *others, text_of().alias("text"))
    return with_python(rows, "text", run, [T.StructField("fp", T.LongType())], drop=("text",))


def _segments(fp: Column) -> Column:
    parts = [F.shiftrightunsigned(fp, 32), fp.bitwiseAND(0xFFFFFFFF)]
    return F.array(*[F.struct(F.lit(i).alias("seg"), v.alias("value")) for i, v in enumerate(parts)])


def _unsets(value: Column, bits: int) -> Column:
    """value with one of its zero bits set, for each of them."""
    flips = F.array(*[F.lit(1 << b) for b in range(bits)])
    return F.transform(F.filter(flips, lambda f: value.bitwiseAND(f) == 0), lambda f: value.bitwiseOR(f))


def links(nodes: DataFrame) -> DataFrame:
    """(a, b), a < b: enough pairs of the distinct fingerprints nodes (fp) within two bits to connect all that are."""
    nodes = nodes.repartition(tasks(nodes.sparkSession), "fp")  # a node becomes 35 rows here, and 65 below
    entries = nodes.select("fp", F.explode(_segments(F.col("fp"))).alias("s")).select("fp", "s.seg", "s.value")
    heavy = kept(entries.groupBy("seg", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET).select("seg", "value"))
    table = entries.join(heavy, ["seg", "value"], "left_anti").withColumnRenamed("fp", "other")
    ball = entries.select("fp", "seg", F.explode(F.concat(F.array("value"), _unsets(F.col("value"), 32))).alias("value"), F.col("value").alias("own"))
    found = ball.join(table, ["seg", "value"]).where((F.col("own") != F.col("value")) | (F.col("fp") < F.col("other")))
    close = found.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= 2)
    pairs = close.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))
    crowd = ball.join(heavy, ["seg", "value"], "left_semi").select("fp").distinct().repartition(tasks(nodes.sparkSession), "fp")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)) for b in range(64)])
    points = crowd.select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("point"))
    met = points.groupBy("point").agg(F.sort_array(F.collect_set("fp")).alias("fps")).where(F.size("fps") > 1)
    stars = met.select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, 65)).alias("b"))
    found = kept(pairs.unionByName(stars).distinct())
    heavy.unpersist()
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of its component, for every node of edges (a, b) but the roots.

    Each half round is written out, which cuts its lineage."""

    def star(pairs: DataFrame, n: int, larger_only: bool) -> DataFrame:
        """Each node's chosen neighbours point to the smallest of the node and its neighbours."""
        low = kept(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))  # so that a hub's pairs can be split by the join
        moved = pairs.join(low, "u")
        out = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        if not larger_only:
            out = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        result = stored_few(out.where(F.col("a") != F.col("b")).distinct(), n)
        low.unpersist()
        return result

    def digest(table: DataFrame) -> tuple:
        return tuple(table.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())

    first = kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    edges.unpersist()
    now, was = first, None
    while (state := digest(now)) != was:
        was, before = state, now
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        wide = star(both, 2 * state[0], True)
        now = star(wide.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), 2 * state[0], False)
        before.unpersist() if before is first else drop_stored(before)
        drop_stored(wide)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_roots(rows: DataFrame, n: int) -> DataFrame:
    """(fp, first: its smallest doc_id, root) of the fingerprints of rows (doc_id, fp), n at most."""
    nodes = stored_few(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), n)
    roots = components(links(nodes.select("fp")))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp"))
    out = stored_few(placed.select("fp", "first", "root"), n)
    drop_stored(nodes)
    drop_stored(roots)
    return out


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    rows = kept(fingerprints(documents))
    n = rows.count()
    placed = near_roots(rows, n)
    ids = stored_few(placed.groupBy("root").agg(F.min("first").alias("component_id")), n)
    names = stored_few(placed.join(ids, "root").select("fp", "component_id"), n)
    drop_stored(placed)
    drop_stored(ids)
    return rows.join(names, "fp").select("doc_id", "fp", "component_id")


def survivors(documents: DataFrame, placed: DataFrame) -> DataFrame:
    """documents with one row of each component; placed is (doc_id, version: hash of the text, root) of every row.

    That is a row of the smallest doc_id (null last) and, among texts of that doc_id, of the smallest hash.  Documents meet
    only the rows that go, where they stand if these are few."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version")
    rows = kept(placed.groupBy("root", "doc_id", "version").agg(F.count(F.lit(1)).alias("rows")))
    # a component's first row is found by combining, and met by its own key: a component's size is no task's
    first = rows.groupBy("root").agg(F.min(place).alias("first")).select("root", F.col("first.doc_id").alias("__id"), F.col("first.version").alias("__version"))
    same = [rows["root"] == first["root"], rows["doc_id"].eqNullSafe(first["__id"]), rows["version"] == first["__version"]]
    repeated = rows.where("rows > 1").join(first, same, "left_semi").limit(1).count()
    gone = kept(rows.join(first, same, "left_anti").select(F.col("doc_id").alias("__id"), F.col("version").alias("__version")))
    rows.unpersist()
    version = F.xxhash64(text_of())
    chosen = documents.join(broadcast_few(gone), F.col("doc_id").eqNullSafe(F.col("__id")) & (version == F.col("__version")), "left_anti")
    if not repeated:
        return chosen
    return chosen.withColumn("__version", version).dropDuplicates(["doc_id", "__version"]).drop("__version")


def one_of_each(documents: DataFrame) -> DataFrame:
    """documents with one row of each component of linked fingerprints."""
    rows = kept(fingerprints(documents, F.xxhash64(text_of()).alias("version")))
    found = near_roots(rows, rows.count())
    return survivors(documents, rows.join(found, "fp").select("doc_id", "version", "root"))
