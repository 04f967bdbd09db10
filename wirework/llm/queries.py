"""The registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (bitslice, bpe, fim, mixing, ngram_join, onebit, quality, sharding, suffix_dedup, toxicity, unigram,
               url_filter, warc)
from .common import table


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_report(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(table(spark, sf_dir, "pages"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslice.top_k_report(table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_report(table(spark, sf_dir, "documents"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_report(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return onebit.mining_report(table(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fim_report(table(spark, sf_dir, "documents"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_report(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op6_ngram_join": op6_ngram_join,
    "op5_toxicity": op5_toxicity,
    "op9_top_k": op9_top_k,
    "op7_bpe": op7_bpe,
    "op4_token_counts": op4_token_counts,
    "op2_warc": op2_warc,
    "op8_sharding": op8_sharding,
    "op3_quality": op3_quality,
    "op10_mixing": op10_mixing,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_url_filter": op13_url_filter,
}

ORACLE: dict[str, str] = {
    "op6_ngram_join": ngram_join.JOIN_SQL,
    "op9_top_k": bitslice.TOP_K_SQL,
    "op2_warc": warc.WARC_SQL,
    "op3_quality": quality.QUALITY_SQL,
    "op10_mixing": mixing.MIXING_SQL,
    "op11_hard_negatives": onebit.MINING_SQL,
    "op12_fill_in_middle": fim.FIM_SQL,
    "op13_url_filter": url_filter.URL_SQL,
}
