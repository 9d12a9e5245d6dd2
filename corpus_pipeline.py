"""A training corpus in five stages: rules, near-duplicates, repeats, benchmark, tokens.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns
the documents it keeps, with the columns of ``documents`` (the last: the encoded corpus).
``run`` applies them to the whole ``documents`` table, each stage's output written as
Parquet and read again, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barflow.llm.common import materialize, table
from barflow.llm.decontaminate import remove_documents
from barflow.llm.near_dedup import keep_one
from barflow.llm.quality_rules import keep_documents
from barflow.llm.queries import tokenizer_path
from barflow.llm.substring_dedup import remove_repeats
from barflow.llm.unigram import encode_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    return keep_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies (five-word shingles, similarity 0.8)."""
    return keep_one(docs, k=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without stretches of 20 words and more that occur earlier."""
    return remove_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return remove_documents(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens: the corpus as unigram pieces."""
    return encode_documents(docs.select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model")).select(
        "doc_id", "ids", "n_tokens"
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("sentencepiece", sentencepiece),
]

#: The last stage's segmentation is not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
