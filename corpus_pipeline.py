"""From raw documents to token digests, in stages that each hand their rows on as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm import bpe, language_id, line_dedup, mixing, near_dedup
from clausewright.llm.staging import staged


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no letters, or a narrow margin) go; the others stay as they are.

    Learns from the labelled three quarters of the documents at hand.
    """
    learned = language_id.learn(docs.where(language_id.remainder(4) != 2).select("doc_id", "text", "lang"))
    return language_id.accepted(docs, learned)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go from the texts; n_chars follows. All rows stay."""
    cleaned = line_dedup.drop_recurring_lines(docs)
    return cleaned.withColumn("n_chars", F.when(F.col("lines_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id. Rows without a doc_id stay."""
    gone = near_dedup.near_duplicates(docs, shingle=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, written in the order of the mixture: part files and the rows in them follow its slots."""
    return mixing.mix(docs).repartitionByRange("mix_slot", "mix_place").sortWithinPartitions("mix_slot", "mix_place").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens and the text they give back, as digests, with its place in the mixture: mix_file and mix_row, by which
    the rows of the stage before were written in the order of its slots. ``docs`` must be read from files."""
    placed = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("mix_file"), F.col("_metadata.row_index").alias("mix_row"))
    return bpe.digests(bpe.encode_documents(placed, carried=("mix_file", "mix_row")))


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Compression, min-hashing and BPE can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
