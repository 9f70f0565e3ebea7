"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sizes are words.  Targets fill up by weight (water-filling): no source gets more than `most` times its size, and what
it can't take goes to the others by weight.  Within a source every document is taken once per complete epoch; the
rest of the target is a weighted sample without replacement: each document draws an exponential key -ln(u) / quality,
documents are taken in order of their keys until the word budget is full, and the one that crosses it is cut there.

A source may hold most of the corpus, so sources are never sorted whole: the logarithms of keys are dealt into BUCKETS
ranges, bucket sums are prefix-summed (BUCKETS rows a source), and the range in which the budget ends is dealt into
BUCKETS ranges again, as often as one holds over SORTED rows; only what is left is sorted by row.  This gives each
source's cut: the row in which its budget ends.  Every document is then taken or not by its place before or after it.

Defined results: null text has size 0; null source is a source of its own, last in order; repeated rows are documents
of their own (equal keys are ordered by doc_id, size; rows that agree in all three are numbered, by one task a source);
sources of size 0 get target 0; an empty table gives an empty result; extra columns are ignored by `mix_plan` and kept
by `mix`, whatever their names, but for those that begin with `__`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, kept, packed, stored, stored_few, text_of, unpacked, word_count

BUCKETS = 4096
#: Rows of one range that are sorted by one task, and how often ranges are dealt out again at most.
SORTED, LEVELS = 50_000, 4
#: Logarithms of keys are between these: -ln(u) is 2 ** -54 at least, and 37 / 0.05 at most.
LEAST, MOST = -38.0, 7.0
MARKS = "#*$%&|<>0123456789"


def quality(text: Column) -> Column:
    """Sampling weight of a document, 0.05 to 1: the share of characters that are neither marks nor digits."""
    n = F.char_length(text)
    return F.greatest(F.lit(0.05), F.when(n > 0, F.char_length(F.translate(text, MARKS, "")) / n).otherwise(F.lit(1.0)))


def draw(doc_id: Column, seed: int) -> Column:
    """u in (0, 1), a function of doc_id and seed alone (52 bits of an MD5, which SQL engines share)."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def ranked_sources(sizes: DataFrame, weights: Sequence[float]) -> DataFrame:
    """(source, source_size, weight): weights repeat over sources in code-point order, null last.

    Ranks come from a range sort and counts per range, so no task needs all sources."""
    ranged = sizes.repartitionByRange(F.col("source").isNull(), F.col("source")).sortWithinPartitions(F.col("source").isNull(), F.col("source"))
    # one row a source; written, as a range sort run again may number otherwise
    numbered = stored(ranged.withColumn("__id", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__id", 33)
    # one row per range, whose number spark.sql.shuffle.partitions bounds
    counts = numbered.groupBy(part.alias("p")).count().orderBy("p").collect()
    starts, total = {}, 0
    for row in counts:
        starts[row["p"]] = total
        total += row["count"]
    start = F.lit(0)
    if starts:
        start = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in starts.items() for x in pair]), part)
    rank = start + F.col("__id").bitwiseAND((1 << 33) - 1)
    return numbered.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))).drop("__id")


def with_targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """sources (source, source_size, weight) with target double; rounds of two sums each, until no target is above its cap."""
    cap = F.col("source_size") * F.lit(float(most))
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    level = 0.0
    while True:
        full = F.col("weight") * F.lit(level) >= cap
        capped, free = sources.agg(F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        raised = (total - capped) / free if free else level
        if raised <= level:
            break
        level = raised
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def keyed(documents: DataFrame, seed: int) -> DataFrame:
    """documents with __source, __size and __key (the smaller the sooner taken)."""
    text = text_of()
    key = -F.log(draw(F.col("doc_id"), seed)) / quality(text)
    return documents.withColumn("__source", F.col("source").cast("string")).withColumn("__size", word_count(text)).withColumn("__key", key)


def _bucket(low: Column, high: Column) -> Column:
    """The range of a key, of BUCKETS between the logarithms low and high; it never falls as keys rise."""
    share = (F.log("__key") - low) / (high - low) * F.lit(float(BUCKETS))
    return F.greatest(F.lit(0), F.least(F.lit(BUCKETS - 1), F.floor(share))).cast("int")


def _ends(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """plan (name, budget, low, high, before: words below low, ...) with low and high of the range in which the budget
    ends, before of it, and n, the rows in it; sources whose rows end sooner are left out.

    rows: __source, __size, __key of those between low and high."""
    inside = rows.join(plan.select("name", "low", "high"), F.col("__source").eqNullSafe(F.col("name")))
    sums = inside.groupBy("name", _bucket(F.col("low"), F.col("high")).alias("bucket")).agg(F.sum("__size").alias("words"), F.count(F.lit(1)).alias("n"))
    sums = sums.withColumnRenamed("name", "__name").join(plan.drop("n"), F.col("__name").eqNullSafe(F.col("name")))
    earlier = Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    reached = sums.withColumn("start", F.col("before") + F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    ended = reached.where((F.col("start") <= F.col("budget")) & (F.col("start") + F.col("words") > F.col("budget")))
    step = (F.col("high") - F.col("low")) / F.lit(float(BUCKETS))
    low, high = F.col("low") + F.col("bucket") * step, F.col("low") + (F.col("bucket") + 1) * step
    columns = [c for c in plan.columns if c not in ("low", "high", "before", "n")]
    # the ends of a range are computed otherwise than its number: a little wider, and filtered by the number
    return ended.select(*columns, F.col("low").alias("__low"), F.col("high").alias("__high"), "bucket", low.alias("low"), high.alias("high"), F.col("start").alias("before"), "n")


def cuts(rows: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """One row a source: name, source_size, target, epochs, budget, and of the row in which the budget ends cut_key, cut_id,
    cut_size, its part, and cut_first and cut_rows: the number among equal rows at which it ends, and theirs.  These are
    null where all rows are taken whole or the budget is none.

    rows: doc_id, __source, __size, __key of every document."""
    sizes = rows.groupBy(F.col("__source").alias("source")).agg(F.sum("__size").alias("source_size"))
    ranked = kept(ranked_sources(sizes, weights))
    n, sources = ranked.count(), with_targets(ranked, share, most)
    sources = sources.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    sources = sources.withColumn("budget", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    # a row a source, written: plans of later levels would hold those of all before
    sources = stored_few(sources.withColumnRenamed("source", "name"), n)
    ranked.unpersist()
    plan = sources.select("name", "budget", F.lit(LEAST).alias("low"), F.lit(MOST).alias("high"), F.lit(0).cast("long").alias("before"))
    level = rows
    for number in range(LEVELS):
        ends = stored_few(_ends(level, plan), n)
        inside = level.join(ends.select("name", "__low", "__high", "bucket"), F.col("__source").eqNullSafe(F.col("name")))
        level = inside.where(_bucket(F.col("__low"), F.col("__high")) == F.col("bucket")).select(*rows.columns)
        plan = ends.drop("__low", "__high", "bucket")
        if number + 1 < LEVELS and (plan.agg(F.max("n")).first()[0] or 0) <= SORTED:
            break
    # rows that agree are one, with a count
    same = level.groupBy("__source", "__key", "doc_id", "__size").agg(F.count(F.lit(1)).alias("copies"))
    order = Window.partitionBy("__source").orderBy("__key", "doc_id", "__size").rowsBetween(Window.unboundedPreceding, -1)
    summed = same.withColumn("__prior", F.coalesce(F.sum(F.col("__size") * F.col("copies")).over(order), F.lit(0)))
    found = summed.join(plan, F.col("__source").eqNullSafe(F.col("name"))).withColumn("left", F.col("budget") - F.col("before") - F.col("__prior"))
    found = found.where((F.col("left") >= 0) & (F.col("left") < F.col("__size") * F.col("copies")))
    whole = F.floor(F.col("left") / F.greatest(F.lit(1), F.col("__size")))
    found = found.select(F.col("name").alias("__name"), F.col("__key").alias("cut_key"), F.col("doc_id").alias("cut_id"), F.col("__size").alias("cut_size"), F.col("copies").alias("cut_rows"), whole.alias("cut_first"), (F.col("left") - whole * F.col("__size")).alias("part"))
    return stored_few(sources.join(found, F.col("name").eqNullSafe(F.col("__name")), "left").drop("__name"), n)


def _taken() -> Column:
    """Words of a row that the mix takes beyond epochs, the row joined with its source's plan."""
    before = (F.col("__key") < F.col("cut_key")) | ((F.col("__key") == F.col("cut_key")) & (
        (F.col("doc_id").isNull() & F.col("cut_id").isNotNull()) | F.coalesce(F.col("doc_id") < F.col("cut_id"), F.lit(False))
        | (F.col("doc_id").eqNullSafe(F.col("cut_id")) & (F.col("__size") < F.col("cut_size")))))
    at = F.when(F.col("__number") <= F.col("cut_first"), F.col("__size")).when(F.col("__number") == F.col("cut_first") + 1, F.col("part")).otherwise(F.lit(0))
    ends = F.when(before, F.col("__size")).when(_is_cut(), at).otherwise(F.lit(0))
    return F.when(F.col("cut_key").isNull(), F.when(F.col("budget") > 0, F.col("__size")).otherwise(F.lit(0))).otherwise(ends).cast("long")


def _is_cut() -> Column:
    return (F.col("__key") == F.col("cut_key")) & F.col("doc_id").eqNullSafe(F.col("cut_id")) & (F.col("__size") == F.col("cut_size"))


def _placed(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs of keyed() with epochs and taken of their source's plan."""
    placed = docs.join(plan, F.col("__source").eqNullSafe(F.col("name")))
    if not plan.where("cut_rows > 1").limit(1).count():
        return placed.withColumn("__number", F.lit(1)).withColumn("__taken", _taken())
    equal = F.coalesce(_is_cut() & (F.col("cut_rows") > 1), F.lit(False))
    number = F.row_number().over(Window.partitionBy("__source").orderBy("__key"))
    return placed.where(~equal).withColumn("__number", F.lit(1)).unionByName(placed.where(equal).withColumn("__number", number)).withColumn("__taken", _taken())


def mix_plan(documents: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 11) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words the mix takes, repeats counted) of every row."""
    rows = kept(keyed(documents.select("doc_id", "source", "text"), seed).select("doc_id", "__source", "__size", "__key"))
    out = _placed(rows, cuts(rows, weights, share, most))
    taken = F.col("epochs") * F.col("__size") + F.col("__taken")
    return out.select("doc_id", F.col("__source").alias("source"), F.col("__size").alias("size"), "source_size", "target", taken.cast("long").alias("taken"))


def mix(documents: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 11) -> DataFrame:
    """The mixed documents themselves: a row per epoch, and one with the first words where the budget ends in it.

    Texts aren't shuffled, and read twice: for the plan and for the result."""
    columns = documents.columns
    rows = kept(keyed(documents.select("doc_id", "source", "text"), seed).select("doc_id", "__source", "__size", "__key"))
    plan = cuts(rows, weights, share, most).drop("source_size", "target")
    rows.unpersist()
    # the other columns travel as one, so that their names can't meet the plan's
    own = ("doc_id", "source", "text")
    placed = _placed(keyed(packed(documents, *own), seed), plan)
    none = F.array().cast("array<bigint>")
    copies = F.when(F.col("epochs") > 0, F.array_repeat(F.col("__size"), F.col("epochs").cast("int"))).otherwise(none)
    each = placed.withColumn("__take", F.explode(F.concat(copies, F.when(F.col("__taken") > 0, F.array(F.col("__taken"))).otherwise(none))))
    cut = F.when(F.col("__take") < F.col("__size"), first_words(text_of(), F.col("__take"))).otherwise(F.col("text"))
    return each.select(*[cut.alias(c) if c == "text" else unpacked(c, *own) for c in columns])


def first_words(text: Column, n: Column) -> Column:
    """The first n words with the white space between them."""
    starts = F.split(F.ltrim(text, F.lit(SPACES)), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])", -1)
    return F.rtrim(F.array_join(F.slice(starts, F.lit(1), n.cast("int")), ""), F.lit(SPACES))
