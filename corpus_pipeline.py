"""Corpus preparation in five stages, each written as Parquet and read again by the next.

Documents that the quality rules reject go; lines of recurring templates are
taken out; of near copies one document stays; documents with benchmark passages
go; what is left is packed into training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from oddsweave.llm import bin_completion, compression_bands, simhash_popcount, string_tiling, template_lines
from oddsweave.llm._shared import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words, repeats and compression are in bounds; null and empty texts have no words and go."""
    return compression_bands.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of templates that recur; null texts stay null, empty ones empty."""
    return template_lines.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; null and empty texts are copies of each other, repeated rows copies too.

    Near copies are what the grid of popcounts links by fingerprints, and texts
    that share 0.8 of their shingles, which lie beyond the grid's radius.
    """
    return simhash_popcount.keep_similar(docs, distance=simhash_popcount.DISTANCE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; an empty benchmark takes none out."""
    return string_tiling.keep(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of tokens; null texts count as empty, an empty table gives no rows."""
    return bin_completion.pack(docs).withColumnRenamed("row_id", "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can express neither zstandard nor tokenizers; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
