"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.

Null and empty texts pass every stage and are packed as an end token each. The near-duplicate
and leak stages know documents by a 64-bit hash of their text, so rows with a null doc_id and
several texts of one doc_id are documents of their own there. Equal rows: all lines of the second go in the line
stage, and the near-duplicate stage keeps one of what is then left of each text with a word.
Extra columns of docs are left out by the first stage, whatever their names. An empty table
stays empty. Texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkalogue.llm import decontaminate, line_dedup, ngram_join, packing, tokens, toxicity
from sparkalogue.llm.common import table, write_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier rejects go."""
    return toxicity.score(docs, table(spark, sf_dir, "labels")).where("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line resembles go; a document whose text goes entirely stays, with no text."""
    cleaned = line_dedup.dedup(docs)
    return cleaned.select("doc_id", "text", "lang", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a hash of each text as its key: whether a text is a near copy or a leak is a matter of the text alone."""
    return docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, of equal texts that with the smallest doc_id; documents without a word are like no other."""
    rows = _keyed(docs)
    classes = ngram_join.join(rows.select(F.col("key").alias("doc_id"), "text"))
    kept = classes.where("doc_id = class_id").select(F.col("doc_id").alias("key")).distinct()
    wordy = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    # a second hash tells apart texts of one key, so that none is lost
    copies = rows.where(wordy).join(kept, "key", "left_semi").groupBy("key", F.xxhash64("text", F.lit(1)))
    first = F.min_by(F.struct(*COLUMNS), F.struct(F.col("doc_id").isNull(), "doc_id"))
    return copies.agg(first.alias("d")).select("d.*").unionByName(rows.where(~wordy).select(*COLUMNS))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    rows = _keyed(docs)
    leaks = decontaminate.matches(rows.select(F.col("key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return rows.join(leaks.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokens.default_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: Trained models and tokenizer ids have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
