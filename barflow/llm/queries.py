"""The queries this subpackage registers: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import chat_query
from .common import table
from .decontaminate import decontaminate_query
from .divergence import divergence_query
from .mixing import mixing_query
from .near_dedup import near_dedup_query
from .quality_crf import quality_query
from .quality_rules import quality_rules_query
from .repair import repair_query
from .substring_dedup import substring_dedup_query
from .token_counts import token_count_query
from .token_shards import token_shard_query
from .toxicity import toxicity_query
from .unigram import unigram_query


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on the driver; operators send its bytes on."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules_query(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_query(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shard_query(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup_query(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count_query(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup_query(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_query(spark, table(spark, sf_dir, "conversations"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_query(table(spark, sf_dir, "documents"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_query(table(spark, sf_dir, "documents"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_query(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_quality_crf, op2_quality_rules, op3_toxicity, op4_sentencepiece, op5_token_shards, op6_near_dedup, op7_token_counts, op8_decontaminate,
        op9_substring_dedup, op10_chat_format, op11_divergence, op12_mixing, op13_repair,
    )}
