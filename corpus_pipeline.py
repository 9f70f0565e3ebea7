"""Corpus pipeline: five stages over documents by the operators in quorumlens.llm.  The third links texts by op3's
fingerprints and multi-index hashing, each link checked on the word sets; as fingerprints of 64 bits can't tell a similarity
of 0.8, MinHash bands add the links that these miss (near_copies), and components are those of op3.

A stage reads all that the one before it kept, which is written; it begins by releasing the tables that earlier stages
held in memory.  Rows may repeat and any column may be null; an empty table stays empty with its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlens.llm import langid, line_dedup, mixing, near_copies, sentencepiece
from quorumlens.llm.common import release, stored, table, text_of
from quorumlens.llm.queries import PIECES


def _sized(docs: DataFrame, like: DataFrame) -> DataFrame:
    """docs with n_chars of the text as it is now, in the columns of like."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*like.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and those whose best language is improbable, go."""
    return langid.keep_identified(docs, langid.train(docs), min_score=0.4)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten or more different texts go, and so does a document of which no word is left.

    Copies of a text count once, so they are left to near_dedup whole; of near copies, whose lines are frequent for no
    other reason, the first keeps what it carries."""
    release()
    index = line_dedup.LineIndex(spark).insert(docs.withColumn("doc_id", F.xxhash64(text_of())))
    cleaned = index.clean(docs, min_docs=10, spare=True)
    return _sized(cleaned.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word Jaccard >= 0.8 stays: the one with the smallest doc_id."""
    release()
    return near_copies.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """150 % of all words, by source weights; a row for each time that a document is taken."""
    release()
    return _sized(mixing.mix(docs, weights=(5, 2, 1), share=1.5, most=2.0), docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_pieces and ids of every row."""
    release()
    encoded = sentencepiece.encode(docs.select("doc_id", "lang", "source", "text"), sentencepiece.load(spark, PIECES))
    return encoded.select("doc_id", "lang", "source", F.coalesce(F.size("ids"), F.lit(0)).alias("n_pieces"), "ids")


STAGES = [
    ("language_id", language_id),
    ("dedup_lines", dedup_lines),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode_pieces", encode_pieces),
]

#: Trained classification, 64-bit fingerprints and segmentation have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
