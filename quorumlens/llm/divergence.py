"""Source divergence audit: how far the term distributions of a language's sources lie apart, in exact integers.

A language keeps the terms found in at least `min_docs` of its documents.  In a group (language, source) a kept term with
`count` occurrences has the smoothed share p = 1 + floor(10**9 * (count + SMOOTH) / (N + SMOOTH * V)), N being the group's
occurrences of kept terms and V their number.

Pairs: the value of two sources is the sum of |p - q| over all kept terms.  It is a function of two counts, so a joint
histogram of (count, count) is tallied per pair and the function is evaluated once per combination, times its
multiplicity.  Combinations with a zero aren't enumerated by term: a source's own histogram of counts, less what the joint
one holds, gives them, and what is left of V are the terms that neither source has.  So a term that k sources have costs
k * (k - 1) / 2 rows before they are tallied, whatever the number of its occurrences and documents.

Terms: those more frequent in a group than in its language, by the same difference, up to a rank.

Texts are read once.  Each partition counts a group's occurrences and documents by term, as bytes, and hands on what it has
when that is too much; these sums meet by (language, term), never by source, so that a source with a third of the rows is
no hot key, and both the occurrences of a group and the documents of the language follow without another shuffle.

Defined results: each row is a document, repeated rows too; null text, lang and source count as ''; a group without terms
still has its pairs, with value 0 if its language keeps no term; a language with one source has no pairs; ties go to the
smaller item in UTF-8 order; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_few, kept, small_batches, stored, text_of

#: Of UTF-8 bytes: A-Z to a-z, those of a term as they are, all others to a space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Terms that a partition counts before it hands them on.
HELD = 400_000
UNIT, SMOOTH = 1_000_000_000, 5


def _partial_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and rows, summed within a partition as far as they fit."""
    schema = "lang string, source string, term string, n long, docs long"

    def rows(found: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (occurrences, documents) in found.items():
            terms = pa.array(occurrences.keys(), pa.binary()).cast(pa.string())
            counts = [pa.array(c.values(), pa.int64()) for c in (occurrences, documents)]
            names = [pa.repeat(pa.scalar(x, pa.string()), len(terms)) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*names, terms, *counts], ["lang", "source", "term", "n", "docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = {}, 0
        for batch in batches:
            for lang, source, text in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                words = text.translate(TERM_BYTES).split()
                occurrences, documents = found.setdefault((lang, source), (Counter(), Counter()))
                held -= len(occurrences)
                occurrences.update(words)
                # in the order of the first counter: both meet a term first in the same text
                documents.update(iter(dict.fromkeys(words)))
                held += len(occurrences)
                if held > HELD:
                    yield from rows(found)
                    found, held = {}, 0
        yield from rows(found)

    small_batches(docs.sparkSession)
    return docs.select("lang", "source", text_of().cast("binary")).mapInArrow(count, schema)


def _share(count: Column, total: Column, terms: Column) -> Column:
    """p of the module's docstring; decimals hold what long can't."""
    above = F.lit(UNIT).cast("decimal(10,0)") * (count + SMOOTH).cast("decimal(20,0)")
    below = (total + SMOOTH * terms).cast("decimal(20,0)")
    return F.call_function("div", above, below) + 1


def _ranked(df: DataFrame, most: int | None = None) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = df.withColumn("rank", rank)
    return out if most is None else out.where(F.col("rank") <= most)


def term_counts(docs: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, n) of kept terms, and (lang, source, total, terms, own) of every group: occurrences of kept terms,
    the language's number of them, the group's number of them."""
    parts = _partial_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # a term has a row per source, so this window is as small as the number of sources
    known = parts.withColumn("docs", F.sum("docs").over(Window.partitionBy("lang", "term"))).where(F.col("docs") >= min_docs)
    counts = kept(known.select("lang", "source", "term", "n"))
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own"))
    terms = counts.groupBy("lang").agg(F.countDistinct("term").alias("terms"))
    groups = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(terms, "lang", "left")
    return counts, stored(groups.na.fill(0, ["total", "own", "terms"]))


def pair_values(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) of every two sources a < b of a language."""
    side = lambda s: counts.select("lang", "term", F.col("source").alias(s), F.col("n").alias(f"n{s}"))
    joint = side("a").join(side("b"), ["lang", "term"]).where(F.col("a") < F.col("b"))
    joint = joint.groupBy("lang", "a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("m"))
    zero = F.lit(0).cast("long")
    cell = lambda na, nb, m: F.struct(na.alias("na"), nb.alias("nb"), m.alias("m"))
    na, nb, m = F.col("na"), F.col("nb"), F.col("m")
    both = joint.select("lang", "a", "b", F.inline(F.array(cell(na, nb, m), cell(na, zero, -m), cell(zero, nb, -m), cell(zero, zero, m))))

    named = lambda s: groups.select("lang", F.col("source").alias(s), F.col("total").alias(f"t{s}"), F.col("own").alias(f"o{s}"), "terms")
    pairs = kept(named("a").join(named("b").drop("terms"), "lang").where(F.col("a") < F.col("b")))
    few = broadcast_few(pairs)
    own = counts.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("m"))
    ends = few.select("lang", "a", "b")
    left = own.withColumnRenamed("source", "a").join(ends, ["lang", "a"]).select("lang", "a", "b", F.col("n").alias("na"), zero.alias("nb"), "m")
    right = own.withColumnRenamed("source", "b").join(ends, ["lang", "b"]).select("lang", "a", "b", zero.alias("na"), F.col("n").alias("nb"), "m")
    rest = pairs.select("lang", "a", "b", zero.alias("na"), zero.alias("nb"), (F.col("terms") - F.col("oa") - F.col("ob")).alias("m"))

    cells = both.unionByName(left).unionByName(right).unionByName(rest)
    cells = cells.groupBy("lang", "a", "b", "na", "nb").agg(F.sum("m").alias("m")).where("m <> 0")
    f = F.abs(_share(na, F.col("ta"), F.col("terms")) - _share(nb, F.col("tb"), F.col("terms")))
    sums = cells.join(few, ["lang", "a", "b"]).groupBy("lang", "a", "b").agg(F.sum(f * m).alias("value"))
    return pairs.select("lang", "a", "b").join(sums, ["lang", "a", "b"], "left").na.fill(0, ["value"])


def term_values(counts: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value, rank): the `top` terms of each group that it has more often than its language."""
    in_lang = counts.withColumn("all", F.sum("n").over(Window.partitionBy("lang", "term")))
    whole = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    sized = stored(groups.join(whole, "lang").drop("own"))
    known = in_lang.join(broadcast_few(sized), ["lang", "source"])
    more = _share(F.col("n"), F.col("total"), F.col("terms")) - _share(F.col("all"), F.col("lang_total"), F.col("terms"))
    found = known.select("lang", "source", F.col("term").alias("item"), more.alias("value")).where(F.col("value") > 0)
    return _ranked(found, top)


def audit(documents: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` has every other source of the language, part `term` the first
    `top` terms."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = documents.select(blank("lang"), blank("source"), F.col("text"))
    counts, groups = term_counts(docs, min_docs)
    pairs = pair_values(counts, groups)
    sides = F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in ("ab", "ba")])
    pairs = _ranked(pairs.select("lang", F.inline(sides), "value"))
    terms = term_values(counts, groups, top)
    names = ("lang", "source", "part", "item", "value", "rank")
    return pairs.withColumn("part", F.lit("pair")).select(*names).unionByName(terms.withColumn("part", F.lit("term")).select(*names))
