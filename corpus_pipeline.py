"""A training-data pipeline over the documents table, in five stages.

Every stage takes any table with doc_id, text, lang and source (the masking stage sets n_chars if there is one) and
treats the cases alike: null texts count as empty and fail the quality rules; null languages and sources are kinds of
their own; null ids stay apart from others; repeated rows are one document for near-dedup, of which one stays, and are
kept as they are elsewhere; of a group of near-equal documents the smallest id stays, ties by row key; an empty table
gives an empty table; other columns pass through, whatever their names, but for the last stage's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.llm import mixing, perplexity, secrets, simhash, wfst
from noteloom.llm.common import documents, stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or leave the perplexity band of their language go."""
    return perplexity.keep_passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-equal fingerprints stays."""
    return simhash.deduplicate(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live secrets are masked; examples that many owners copy stay."""
    return secrets.redact(docs, F.concat_ws("/", "source", "lang"), F.col("source"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, those of sources that gain weight as often as the mixture draws them."""
    return mixing.mix_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every draw."""
    return wfst.encode_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("source mixing", source_mixing),
    ("sentencepiece encoding", sentencepiece),
]
#: The perplexity model, XXH64 and piece encoding have no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
