"""A training-data pipeline over ``documents``: five stages, each a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratatext.llm import bpe, decontaminate, lines, minhash, quality
from stratatext.llm.common import save

#: SQL cannot express the learned rules, so the stages are tested against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned rules reject go.

    Null, empty and short texts fail the base.  Labels that are missing, null or of one
    class alone leave the base rules; repeated rows are judged each.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five or more documents share stay in one of them.

    Every document stays; ``n_chars``, if there is one, counts what is left of the text.
    A null text becomes an empty one; rows of one doc_id count as one document.
    """
    out = lines.without_shared_lines(docs).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest doc_id.

    Texts without words and rows with a null doc_id stay; rows that repeat a doc_id
    stay or go together.
    """
    return minhash.keep_one(docs)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.

    Empty documents and items, and null texts, contain and match nothing; without items
    every document stays.
    """
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of the text they decode to.

    Empty and null texts have no ids; repeated rows are answered each.
    """
    import public_tokenizers

    return bpe.encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", leak_stage),
    ("bpe", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; no documents give no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = save(stage(spark, docs, sf_dir), name)
    return docs
