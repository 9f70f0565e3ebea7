"""Quality rules with cross-document line frequency (DataFrame functions only).

Base rules look at one text: words, symbols, repeated lines, words inside repeated five-word windows.  The verdict
then looks across documents: lines are normalised (outer white space off, A-Z lower-cased) and hashed together with
their host (`source`), distinct documents are counted per host and line, lines in more than `max_docs` documents of
the host are removed, and a document is rejected when fewer than `min_left` of its words are left.

A document lists each of its lines once, counts are summed in two steps (by line and document, then by line), and
lines above the limit are gathered before documents meet them, so a line in a third of all documents is never one
task's work: the join either broadcasts the small table or splits hot keys.

Defined results: null or empty text has no words and fails the base rules; null source is a host of its own; a
document is a distinct doc_id for counting (null is one), and every row gets a verdict; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD, kept, line_key, lower_ascii, once, text_of, word_count

SYMBOLS = "#*$%&|<>"
WINDOW = 5


def window_hashes(words: Column, size: int = WINDOW) -> Column:
    """XXH64 of every run of `size` words, in order."""
    last = F.size(words) - size
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.xxhash64(*[F.get(words, i + (k - 1)) for k in range(size)]))).otherwise(F.array().cast("array<bigint>"))


def repeated_words(pairs: str, size: int = WINDOW) -> Column:
    """Words inside windows whose hash occurs twice or more, first occurrences included.

    pairs names a column of sorted structs (h: hash, i: position): equal windows are side by side.  Covered words are
    summed in order of position, each counted once.  A column, not an expression: lambdas evaluate theirs each time."""
    hash_at = lambda i: F.get(F.col(pairs), i)["h"]
    twin = F.transform(pairs, lambda p, i: F.when(p["h"].eqNullSafe(hash_at(i + 1)) | p["h"].eqNullSafe(hash_at(i - 1)), p["i"]).otherwise(F.lit(-1)))
    places = F.sort_array(F.filter(twin, lambda i: i >= 0))
    start = F.struct(F.lit(-size).alias("at"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(places, start, lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(size), i - a["at"])).alias("n")), lambda a: a["n"])


def base_rules(documents: DataFrame) -> DataFrame:
    """doc_id, source, version (hash of source and text), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of every row."""
    bare = F.translate(F.col("t"), SPACES, "")
    lines = F.filter(F.split("t", "\n", -1), lambda s: F.btrim(s, F.lit(SPACES)) != "")
    rows = documents.select("doc_id", F.col("source").cast("string").alias("source"), text_of().alias("t"))
    rows = rows.withColumn("version", F.xxhash64("source", "t"))
    rows = rows.withColumn("words", F.regexp_extract_all("t", F.lit(WORD), 0)).withColumn("bare", bare).withColumn("lines", lines)
    rows = rows.withColumn("hashes", window_hashes(F.col("words")))
    pairs = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("pairs", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), pairs))
    n_repeat = F.when(F.col("pairs").isNull(), F.lit(0).cast("long")).otherwise(repeated_words("pairs"))
    rows = rows.select(
        "doc_id", "source", "version",
        F.size("words").cast("long").alias("n_words"),
        F.char_length("bare").cast("long").alias("word_chars"),
        (F.char_length("bare") - F.char_length(F.translate("bare", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        n_repeat.alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def host_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, version: hash of the row's source and text, at, line: hash of host and normalised line, n: its words)."""
    source = F.col("source").cast("string")
    keys = F.transform(F.split(lower_ascii(text_of()), "\n", -1), line_key)
    lines = documents.select("doc_id", F.xxhash64(source, text_of()).alias("version"), F.coalesce(F.xxhash64(source), F.lit(0)).alias("host"), source.isNull().alias("none"), once(keys).alias("ks"))
    lines = lines.select("doc_id", "version", "host", "none", F.posexplode("ks").alias("at", "k"))
    return lines.where(F.col("k") != "").select("doc_id", "version", "at", F.xxhash64("host", "none", "k").alias("line"), word_count(F.col("k")).alias("n"))


def frequent_lines(documents: DataFrame, max_docs: int) -> DataFrame:
    """(line) of those in more than max_docs distinct documents of a host."""
    pairs = host_lines(documents).select("line", "doc_id").distinct()
    return kept(pairs.groupBy("line").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > max_docs).select("line"))


def verdicts(documents: DataFrame, max_docs: int = 10, min_left: float = 0.3) -> DataFrame:
    """The columns of base_rules, n_line_words (words in removed lines) and kept.

    Removed words are summed by (doc_id, version), so repeated rows get the verdict that one of them would."""
    frequent = frequent_lines(documents, max_docs)
    hits = host_lines(documents).join(frequent, "line").select("doc_id", "version", "at", "n").distinct()
    removed = hits.groupBy(F.col("doc_id").alias("__id"), F.col("version").alias("__version")).agg(F.sum("n").alias("removed"))
    removed = kept(removed)
    base = base_rules(documents)
    joined = base.join(removed, base["doc_id"].eqNullSafe(removed["__id"]) & (base["version"] == removed["__version"]), "left")
    gone = F.least(F.col("n_words"), F.coalesce("removed", F.lit(0)))
    left = F.col("n_words") - gone
    return joined.select(*[c for c in base.columns if c != "version"], gone.alias("n_line_words"), (~F.col("base_failed") & (left >= F.lit(min_left) * F.col("n_words"))).alias("kept"))
