"""The quote table: idempotent append and reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.ingest import new_rows
from ..operators.quotes import validate


def read_quotes(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored quotes, or null when nothing was written yet."""
    from .jsonl import _exists

    return spark.read.parquet(path) if _exists(spark, path) else None


def append_quotes(records: DataFrame, path: str, editions: list, order: list[str], hash_mode: str = "content") -> tuple[DataFrame, DataFrame]:
    """Validate, drop known and repeated rows, append the rest partitioned by edition.

    Returns (inserted, rejected).  Appending the same records again inserts
    nothing.
    """
    spark = records.sparkSession
    good, bad = validate(records, editions, hash_mode)
    table = read_quotes(spark, path)
    fresh = new_rows(good, table, order)
    fresh.write.mode("append").partitionBy("edition_id").parquet(path)
    return fresh, bad
