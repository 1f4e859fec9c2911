"""From raw documents to token ids: quality, near duplicates, benchmark leaks, secrets, encoding.

``run`` applies the stages to ``documents``; each stage's result is written as Parquet and read again as the input of the
next.  Every stage works on all rows that the one before it kept and, but for the last, returns the columns of
``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewell.llm import bpe, decontaminate, jaccard, quality, secrets
from tapewell.session import checkpointed

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier doesn't reject; repeated rows, null ids and empty texts are judged like others."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.classify(docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id"), F.col("text")), labels)
    return scored.where("predicted = 1").select("row.*")


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents tied by a Jaccard similarity of 0.8 or more over five-word shingles, the one with the smallest id;
    rows with null ids and empty texts all stay, a repeated id stays once."""
    return jaccard.keep_one(docs, n=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage that holds a test item; null and empty texts stay."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with live-looking credentials that few owners have replaced; examples that many have stay."""
    return secrets.redact(docs, repository="doc_id", owner="source")


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids (little-endian unsigned 32-bit) of every row; null texts have no ids."""
    out = bpe.encode(docs.select("doc_id", "lang", "source", "text"), TOKENIZER)
    return out.select("doc_id", "lang", "source", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", keep_one_of_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("secret_scans", redact_secrets),
    ("bpe_encoding", encode_tokens),
]

# A trained classifier and set components have no SQL form; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
