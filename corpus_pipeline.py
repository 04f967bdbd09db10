"""From raw documents to training tokens: five stages, each run on all that the one
before it kept.  Every stage but the last returns the columns of its input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wirework.llm import bpe, mixing, ngram_join, quality, suffix_dedup
from wirework.llm.common import materialize, table, written_order


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules (3): documents that fail a base rule or a certified cutoff go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (6): of each group of near copies the smallest id stays."""
    return ngram_join.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup (1): 50-byte strings stay in the document of the smallest id."""
    return suffix_dedup.remove_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights (10): a row per copy taken, in training order."""
    return mixing.curriculum(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding (7): ids, their digest and that of the decoded text.
    Sorted by (part, row) the rows are in training order: see ``common.written_order``."""
    return bpe.training_tokens(written_order(docs), public_tokenizers.path("byte_bpe_50k.json"), order=("part", "row"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing", mix),
    ("BPE", tokens),
]

#: Statements can't express the last stage; tests compare it with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
