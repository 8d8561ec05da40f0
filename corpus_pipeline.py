"""The corpus pipeline: from raw documents to piece ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept. All but the last return the columns of documents.

Defined results: documents of null or empty text or under 50 words go in the
first stage; rows with a null doc_id are neither deduplicated nor compared with
the benchmark and stay; repeated rows of one doc_id stay or go together; of
near copies the smallest doc_id stays; texts of any length are read whole;
further columns of documents pass through all stages but the last, which drops
them; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courierlens.llm import decontamination, line_dedup, ngram_jaccard, quality_rules, sentencepiece_codec
from courierlens.llm.tables import remove, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 of the quality ledger keeps."""
    return quality_rules.kept(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that equal or resemble an earlier line; emptied documents go."""
    out = line_dedup.deduplicated(docs)
    return out.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else c for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one of the smallest id."""
    return ngram_jaccard.representatives(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every document, and whether they decode to its text."""
    rows = sentencepiece_codec.encode(docs, check="round_trip")
    return rows.select("doc_id", "lang", "source", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), "ids", "round_trip")


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", benchmark),
    ("sentencepiece", pieces),
]

#: SQL can express neither the similarity stages at this size nor the piece codes; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read back; the table that the last stage reads stays."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            remove(before)  # no later stage reads it
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
