"""The corpus pipeline: quality rules, near-dedup, decontamination, secret scans, byte-level BPE.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next stage's docs.
All but the last return the columns of documents.

Defined cases: an empty table gives an empty result; a null text has no words and is rejected by the first stage, but stages that get one keep
it; rows with a null doc_id pass near-dedup and decontamination, and rows that share a doc_id stay or go together there; columns that
documents have besides are kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.bpe import encode_documents
from corpusloom.llm.common import stored
from corpusloom.llm.decontaminate import decontaminate
from corpusloom.llm.minhash import near_dedup
from corpusloom.llm.quality import quality_filter
from corpusloom.llm.secrets import redact_secrets

#: The default of near-duplicate stages: shingles of five words, Jaccard similarity of 0.8 or more.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_filter(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id."""
    return near_dedup(docs, SHINGLE_WORDS, SIMILARITY_PERCENT)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, as it stands or with other numbers, names or units."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short_inside=True)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced."""
    return redact_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the ids of their text, which are decoded again; an id list that does not give its text back is an error."""
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, check=True)


STAGES = [("quality_rules", quality), ("near_dedup", dedup), ("decontamination", clean_of_benchmark), ("secret_scan", without_secrets), ("bpe", encode)]

#: Secret spans come from a trained model, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
