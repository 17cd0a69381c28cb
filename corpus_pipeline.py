"""From raw documents to token ids: quality, near copies, secrets, mixture, pieces.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns the columns of documents; the
last returns ids and the text decoded from them. run() writes each stage to the shared folder and reads it for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import mixing, perplexity, pieces, secrets, simhash
from tidemark.llm.shared import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney classifier rejects go."""
    return perplexity.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles are similar (Jaccard 0.8 or more, and chains of such pairs) the one with the smallest doc_id stays: SimHash by multi-index hashing, then the sets themselves."""
    return simhash.drop_near_copies(docs)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are replaced in the text; all documents stay."""
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat as the mixture takes them; those it doesn't take go."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids of each document and the text decoded from them (a row for each repeat)."""
    return pieces.encode_documents(docs, pieces.model_path())


STAGES = [("quality", quality), ("near_copies", near_copies), ("secrets", redacted), ("mixture", mixture), ("pieces", token_ids)]

#: hashes of the libraries at hand are not in SQL; tests hold each stage against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
