"""Documents of similar texts: Jaccard similarity of five-word shingles, found by SimHash and MinHash bands, checked exactly.

Two texts are linked if the sets of their shingles (XXH64, seed 42, of five words each, A-Z lower-cased; a shorter text
is one shingle) have a Jaccard similarity of 0.8 or more.  Fingerprints of 64 bits can't find these: at 0.8 two SimHashes
differ in 10 bits on average and in 18 now and then, which one of 3,000 pairs of unrelated texts does too.  So the first
candidates are op3's: pairs of fingerprints (of five-word shingles) within two bits, by multi-index hashing.  What these
connect is one component from the first round on.  The others are pairs that share one of BANDS bands of ROWS MinHashes: at
0.8 all but 3 in 100,000 do, above it fewer are missed.  Every link is verified on the whole sets.  Before sets move, pairs are screened by PARITY bits a set, each the
parity of the number of shingles that fall on it: two sets differ in at least as many shingles as these differ in bits,
so what is screened out can't be a link.

Equal sets are one node.  Candidates of a crowded band would be the square of its nodes: there one node after another
(first the one that meets most others) is compared with those not yet in its component.  Of what is still apart, all
pairs follow if they are few.  If not, shingles of over COMMON of these nodes are told from rare ones: a pair without a
rare shingle in common shares at most the common shingles of the lesser, so only pairs for which that is enough, and
pairs that meet in a rare shingle, can be similar.  No pair of a band is left out but those connected or so excluded.

Defined results: null, empty and blank texts are equal; an empty table gives an empty result; extra columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_few, drop_stored, kept, stored, stored_few, tasks, text_of, with_python
from .simhash import components, links, majority, shingle_hashes, survivors

SHINGLE, BANDS, ROWS, PARITY = 5, 20, 4, 512
#: Pairs a node, up to which all that are still apart are compared at once, as they are when a round connects too few
#: or after ROUNDS; nodes a shingle, over which it is common.
PAIRS, ROUNDS, COMMON = 8, 2, 16

_ODD = np.random.default_rng(5).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(shingle_hashes(text, SHINGLE))


def _set_and_print(text: str | None) -> tuple[np.ndarray, int]:
    """shingle_set(text), and the fingerprint of the shingles with repeats."""
    hashes = shingle_hashes(text, SHINGLE)
    return np.unique(hashes), majority(hashes)


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key of each band; an empty set has none."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    mixed = hashes ^ (hashes >> np.uint64(31))
    for at in range(0, len(mixed), 2048):
        part = mixed[at : at + 2048, None] * _ODD
        np.minimum(least, (part ^ (part >> np.uint64(32))).min(0), out=least)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64)


def parity(hashes: np.ndarray) -> np.ndarray:
    """PARITY bits: of each, whether an odd number of hashes fall on it."""
    odd = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % PARITY, minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _rows(documents: DataFrame) -> DataFrame:
    """(doc_id, version: hash of the text, node: hash of its set, n: size of it, fp: fingerprint, bits: parities of the set, bands) of
    every row."""

    def run(texts: list) -> list[pa.Array]:
        made = [_set_and_print(t) for t in texts]
        sets, prints = [s for s, _ in made], np.array([p for _, p in made], np.uint64).view(np.int64)
        nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
        keys = [bands(s) for s in sets]
        ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
        flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
        bits = pa.array(np.concatenate([np.zeros(0, np.int64), *map(parity, sets)]))
        bits = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * (PARITY // 64)), bits)
        return [pa.array(nodes), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints), bits, pa.ListArray.from_arrays(pa.array(ends), flat)]

    lists = T.ArrayType(T.LongType())
    fields = [T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("bits", lists), T.StructField("bands", lists)]
    rows = documents.select("doc_id", F.xxhash64(text_of()).alias("version"), text_of().alias("text"))
    return with_python(rows, "text", run, fields, drop=("text",))


def _sets(documents: DataFrame, places: DataFrame, n: int, repeated: bool) -> DataFrame:
    """(node, s: its shingle set) of the n places (node, doc_id, version); repeated: whether rows of documents are."""

    def run(texts: list) -> list[pa.Array]:
        sets = [shingle_set(t).view(np.int64) for t in texts]
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))]

    at = places.select("node", F.col("doc_id").alias("__id"), F.col("version").alias("__version"))
    texts = documents.select("doc_id", F.xxhash64(text_of()).alias("version"), text_of().alias("text"))
    found = texts.join(broadcast_few(at, n), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("version") == F.col("__version"))).select("node", "text")
    if repeated:
        found = found.dropDuplicates(["node"])
    return with_python(found, "text", run, [T.StructField("s", T.ArrayType(T.LongType()))], drop=("text",))


def _cut(df: DataFrame) -> tuple[DataFrame, int]:
    """df, computed by all tasks and then written in few files, so that plans of later rounds don't nest those before, and
    its number of rows.  Not kept(), which would count once more: the driver holds the plan of each job."""
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    n = held.count()
    out = stored_few(held, n)
    held.unpersist()
    return out, n


def _verified(pairs: DataFrame, sets: DataFrame, marks: DataFrame) -> DataFrame:
    """(a, b) of those pairs (a, b) whose Jaccard similarity is at least 0.8; marks: (node, n, bits)."""
    left, right = (marks.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}")) for x in "ab")
    differ = sum((F.bit_count(F.col("bitsa")[i].bitwiseXOR(F.col("bitsb")[i])) for i in range(PARITY // 64)), F.lit(0))
    # similar sets differ in a ninth of both sizes at most
    near, n = _cut(pairs.join(left, "a").join(right, "b").where(9 * differ <= F.col("na") + F.col("nb")).select("a", "b"))
    firsts = sets.join(broadcast_few(near, n), F.col("node") == F.col("a")).select("a", "b", F.col("s").alias("sa"))
    seconds = sets.join(broadcast_few(near.select("b").distinct(), n), F.col("node") == F.col("b"), "left_semi").select(F.col("node").alias("b"), F.col("s").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    return firsts.join(seconds, "b").where(9 * shared >= 4 * (F.size("sa") + F.size("sb"))).select("a", "b")


def _printed(nodes: DataFrame) -> tuple[DataFrame, int]:
    """(a, b), a < b, and their number: pairs of the nodes (node, fp) that connect all whose fingerprints are within two
    bits, by op3's multi-index hashing.  Of a fingerprint the smallest node stands for all."""
    prints, _ = _cut(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("c")))
    close = links(prints.select("fp"))
    one, two = (prints.select(F.col("fp").alias(x), F.col("first").alias(f"n{x}")) for x in "ab")
    apart = close.join(one, "a").join(two, "b").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))
    equal = nodes.select("fp", "node").join(prints.where("c > 1"), "fp").where(F.col("node") != F.col("first")).select(F.col("first").alias("a"), F.col("node").alias("b"))
    out = _cut(apart.unionByName(equal))
    close.unpersist()
    return out


def roots(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, root) of the nodes that are linked to another; rows are _rows(documents)."""
    nodes = rows.groupBy("node").agg(F.first("n").alias("n"), F.min("fp").alias("fp"), F.first("bits").alias("bits"), F.first("bands").alias("bands"), F.min(F.struct("doc_id", "version")).alias("at"))
    nodes, _ = _cut(nodes)
    entries = nodes.repartition(tasks(nodes.sparkSession), "node").select("node", "n", F.explode("bands").alias("band"))
    met, _ = _cut(entries.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1))
    entries = entries.join(met, "band")
    degree, _ = _cut(entries.groupBy("node").agg(F.sum("m").alias("degree")))
    entries, _ = _cut(entries.join(degree, "node").select("node", "n", "band", "degree"))
    printed, n_printed = _printed(nodes)
    own = degree.select("node").unionByName(printed.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    marked, total = _cut(nodes.join(own, "node", "left_semi").select("node", "n", "bits", "at"))
    marks, places = marked.select("node", "n", "bits"), marked.select("node", "at.doc_id", "at.version")
    repeated = rows.groupBy("doc_id", "version").count().where("count > 1").limit(1).count() > 0
    sets = stored(_sets(documents, places, total, repeated), "sets")
    near = 5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb")
    edges, found, before = None, None, float("inf")
    if n_printed:
        edges, n_edges = _cut(_verified(printed, sets, marks))
        found = components(edges) if n_edges else None
    for step in range(ROUNDS + 1):
        now = entries.withColumn("root", F.col("node"))
        if found is not None:
            now = entries.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
        now, _ = _cut(now)
        parts = now.groupBy("band", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("band").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("q"))
        apart, _ = _cut(parts.where(F.col("m") * F.col("m") > F.col("q")).select("band", ((F.col("m") * F.col("m") - F.col("q")) / 2).alias("pairs")))
        ahead = apart.agg(F.sum("pairs")).first()[0] or 0
        if not ahead:
            break
        last = ahead <= PAIRS * total or ahead > 0.7 * before or step == ROUNDS
        before = ahead
        left = now.join(apart, "band", "left_semi").select("band", F.col("node").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), "degree")
        right = left.select("band", F.col("a").alias("b"), F.col("na").alias("nb"), F.col("ra").alias("rb"))
        if not last:
            order = F.struct("degree", "a") if not step else F.struct(F.xxhash64("a", F.lit(step)), F.col("a"))
            left = left.groupBy("band").agg(F.max_by(F.struct("a", "na", "ra"), order).alias("x")).select("band", "x.*")
        apart_near = (F.col("ra") != F.col("rb")) & near
        if last and ahead > PAIRS * total:
            crowd, n_crowd = _cut(left.select(F.col("a").alias("node"), "ra").distinct())
            shingles = sets.join(broadcast_few(crowd.select("node"), n_crowd), "node", "left_semi").select(F.col("node").alias("a"), F.explode("s").alias("t"))
            shared, n_shared = _cut(shingles.groupBy("t").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1))
            common, few = shared.where(F.col("c") > COMMON).select("t"), shared.where(F.col("c") <= COMMON).select("t")
            # at most COMMON nodes have a rare shingle
            rare = shingles.join(broadcast_few(few, n_shared), "t", "left_semi").groupBy("t").agg(F.sort_array(F.collect_list("a")).alias("own"))
            pair = F.explode(F.flatten(F.transform("own", lambda x, i: F.transform(F.slice("own", i + 2, F.size("own")), lambda y: F.struct(x.alias("a"), y.alias("b"))))))
            meeting = rare.select(pair.alias("p")).select("p.a", "p.b").distinct()
            met_twice = marks.join(crowd, "node").select("node", "n", "ra")
            one, two = (met_twice.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("ra").alias(f"r{x}")) for x in "ab")
            meeting = meeting.join(one, "a").join(two, "b").where(apart_near).select("a", "b")
            n_common, _ = _cut(shingles.join(broadcast_few(common), "t", "left_semi").groupBy("a").agg(F.count(F.lit(1)).alias("ca")))
            left, _ = _cut(left.join(n_common, "a").where(5 * F.col("ca") >= 4 * F.col("na")).select("band", "a", "na", "ra", "ca"))
            right = left.select("band", F.col("a").alias("b"), F.col("na").alias("nb"), F.col("ra").alias("rb"), F.col("ca").alias("cb"))
            enough = 9 * F.least("ca", "cb") >= 4 * (F.col("na") + F.col("nb"))
            pairs = left.join(right, "band").where((F.col("a") < F.col("b")) & apart_near & enough).select("a", "b").unionByName(meeting)
        else:
            pairs = left.join(right, "band").where(apart_near)
        pairs, _ = _cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        new, _ = _cut(_verified(pairs, sets, marks))
        edges = new if edges is None else edges.unionByName(new)
        found = components(edges)
        if last:
            break
    return found if found is not None else entries.select("node", F.col("node").alias("root")).where("false")


def one_of_each(documents: DataFrame) -> DataFrame:
    """documents with one row of each component: that of the smallest doc_id (null last) and of its texts' smallest hash."""
    rows = kept(_rows(documents))
    linked = roots(documents, rows)
    placed = rows.join(linked, "node", "left").select("doc_id", "version", F.coalesce("root", "node").alias("root"))
    return survivors(documents, placed)
