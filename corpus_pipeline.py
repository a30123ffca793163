"""The corpus pipeline: language ID, near-duplicates, decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All stages but the last return the
columns of docs. A stage drops or changes only what its operator decided on. Rows
without a doc_id and rows that repeat one are numbered, and each is judged by itself.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliodor.llm import bpe, decontam, langid, neardup, pii
from heliodor.llm.common import bounded, delete, numbered, shared_dir

#: Words of a shingle in the near-duplicate stage.
SHINGLE_WORDS = 5
#: SQL expresses neither the first nor the last stage.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is rejected: no letter, or a narrow margin."""
    return langid.predict(docs, langid.fit(docs), keep=docs.columns, accepted=True)


def _rows(docs: DataFrame) -> DataFrame:
    """docs with a unique `__row`: doc_id, where rows don't lack or repeat it."""
    rows = numbered(docs, "__row")
    return docs.withColumn("__row", F.col("doc_id")) if rows is None else rows


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group."""
    rows = _rows(docs)
    found = neardup.near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text"), SHINGLE_WORDS)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("__row"))
    return rows.join(bounded(gone), "__row", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    rows = _rows(docs)
    found = decontam.contamination(rows.select(F.col("__row").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.join(bounded(found.where("contaminated").select(F.col("doc_id").alias("__row"))), "__row", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace each span of personal data by its kind in brackets; n_chars follows the text."""
    return pii.mask(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of each document."""
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [("language ID", language), ("near-duplicates", near_duplicates), ("decontamination", decontaminate), ("personal data", personal_data), ("byte-level BPE", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each from what the one before it wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/heliodor-pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:  # nothing reads the stage before any more
            delete(spark, f"{folder}/{k - 1}")
    return docs
