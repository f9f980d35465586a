"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import edits, fim, idfiles, mixing, negatives, ogg, perplexity, quality, reshard, secrets, simhash, suffix, wfst
from .common import documents


def holders() -> tuple[Column, Column]:
    """Repository and owner: a source's part in one language, and the source."""
    return F.concat_ws("/", "source", "lang"), F.col("source")


def op1_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_digest(documents(spark, sf_dir))


def op3_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.judge(documents(spark, sf_dir))


def op4_sentencepiece_wfst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wfst.encode_documents(documents(spark, sf_dir), keep_ids=False)


def op5_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(documents(spark, sf_dir), *holders())


def op6_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.count_edited(documents(spark, sf_dir), edits.revision())


def op7_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeat_digest(documents(spark, sf_dir))


def op9_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op10_flow_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshard.reshard_documents(documents(spark, sf_dir))


def op11_fim_skip_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.transformation_digest(documents(spark, sf_dir))


def op12_zstd_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfiles.output_digest(documents(spark, sf_dir))


def op13_four_russians_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_discriminant, op2_ogg_media, op3_perplexity_rules, op4_sentencepiece_wfst, op5_secret_ownership,
        op6_edit_token_counts, op7_simhash_neardup, op8_suffix_dedup, op9_temperature_mixing, op10_flow_reshard,
        op11_fim_skip_list, op12_zstd_id_files, op13_four_russians_negatives,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op5_secret_ownership": secrets.oracle("source || '/' || lang", "source"), "op11_fim_skip_list": fim.ORACLE, "op13_four_russians_negatives": negatives.ORACLE,
}
