"""The corpus pipeline: from raw documents to token ids.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns
a DataFrame that is written as Parquet and read again as the next stage's ``docs``.
All but the last return the columns of ``documents``. Null and empty texts pass
through every stage like other rows; rows that repeat an id are one document to
the near-duplicate stage and stay or go together; an empty table stays empty;
further columns are carried along unchanged.
"""

from __future__ import annotations

import uuid
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import bpe, decontaminate, neardup, quality, secrets
from tidegrid.llm.common import table
from tidegrid.session import ready, shared_dir


def prepared(stage):
    """A stage that may also be called by itself: session settings first."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(ready(spark), docs, sf_dir)

    return run_stage


@prepared
def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@prepared
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id."""
    return neardup.keep_one(docs)


@prepared
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out."""
    return recounted(decontaminate.remove_spans(docs, table(spark, sf_dir, "benchmark")))


@prepared
def secret_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return recounted(secrets.redact(docs))


@prepared
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.round_trip(docs, path, with_ids=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


def recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [
    ("quality classifier", quality_filter),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scan", secret_removal),
    ("bpe encoding", encoding),
]

#: SQL cannot express the stages; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    ready(spark)
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
