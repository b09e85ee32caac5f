"""Tables that grow by batches: known keys in folders, a ledger, upserts of touched folders.

Ingest needs to know whether an id or a hash is there, not the rows.  So the keys lie in
a narrow table of their own, in folders by batch and by a hash of the key; a batch opens
the folders of its own keys alone.  A batch reads the batches before it and writes under
its own number, so one that is replayed, whole or after a crash, makes what it made
before.  Readers see the batches that the ledger lists, which is written last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import new_rows
from ..session import stored
from .jsonl import _exists

#: Folders of the key table and of an upserted table.
BUCKETS = 64


def bucket(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def ledger(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that are complete."""
    if not _exists(spark, f"{path}/ledger"):
        return []
    return sorted(r["number"] for r in spark.read.schema("number long, rows long").parquet(f"{path}/ledger").select("number").distinct().collect())


def read_batches(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """Rows of all complete batches, or null before the first."""
    done = ledger(spark, path)
    if not done:
        return None
    folders = [f"{path}/rows/batch={n}" for n in done]
    reader = spark.read.option("basePath", f"{path}/rows")
    return (reader.schema(schema) if schema is not None else reader).parquet(*folders).drop("batch")


def known_keys(spark: SparkSession, path: str, incoming: DataFrame, before: int, id_col: str, hash_col: str) -> DataFrame:
    """(kind, key) of complete batches before ``before``, from the folders of the incoming keys."""
    done = [n for n in ledger(spark, path) if n < before]
    schema = "kind string, key string, batch long, bucket int"
    if not done:
        return spark.createDataFrame([], "kind string, key string")
    keys = incoming.select(F.explode(F.array(bucket(F.col(id_col)), bucket(F.col(hash_col)))).alias("b"))
    touched = [r["b"] for r in keys.distinct().collect()]  # at most BUCKETS numbers
    table = spark.read.schema(schema).option("basePath", f"{path}/keys").parquet(f"{path}/keys")
    return table.where(F.col("batch").isin(done) & F.col("bucket").isin(touched or [-1])).select("kind", "key")


def append_batch(rows: DataFrame, path: str, number: int, order: list[str], id_col: str = "quote_id", hash_col: str = "content_hash") -> DataFrame:
    """Insert the new rows of a batch (by hash, then by id, see :func:`new_rows`); the rows inserted.

    ``number`` names the batch: later batches have larger ones, a replay has the same.
    """
    spark = rows.sparkSession
    incoming = stored(rows, "incoming")
    known = known_keys(spark, path, incoming, number, id_col, hash_col)
    out = incoming
    for kind, column in (("hash", hash_col), ("id", id_col)):
        out = out.join(known.where(F.col("kind") == kind).select(F.col("key").alias(column)), column, "left_anti")
    fresh = new_rows(out, None, order, id_col, hash_col).select(*rows.columns)
    fresh.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
    held = spark.read.schema(fresh.schema).parquet(f"{path}/rows/batch={number}")
    keys = held.select(F.explode(F.array(
        F.struct(F.lit("id").alias("kind"), F.col(id_col).cast("string").alias("key")), F.struct(F.lit("hash").alias("kind"), F.col(hash_col).cast("string").alias("key")))).alias("k")).select("k.*")
    keys.withColumn("bucket", bucket(F.col("key"))).repartition("bucket").sortWithinPartitions("bucket", "key").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/keys/batch={number}")
    done = held.agg(F.lit(number).cast("long").alias("number"), F.count(F.lit(1)).alias("rows"))
    done.coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/entry={number}")
    return held


def upsert_partitions(incoming: DataFrame, path: str, key: str = "id", version: str | None = None, buckets: int = BUCKETS) -> list[int]:
    """Merge rows into a table in folders by key hash; only touched folders are read and rewritten.

    The incoming row wins per key; of several incoming rows of a key the one of highest
    ``version``.  Returns the touched folders.
    """
    from ..operators.vectors import upsert

    spark = incoming.sparkSession
    new = stored(incoming.withColumn("bucket", bucket(F.col(key), buckets)), "upsert")
    touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # at most ``buckets`` numbers
    now = new.limit(0)
    if _exists(spark, path):
        now = spark.read.schema(new.schema).parquet(path).where(F.col("bucket").isin(touched or [-1]))
    merged = stored(upsert(now, new, key, version), "upserted")  # read before the folders are rewritten
    out = merged.repartition("bucket").sortWithinPartitions("bucket", key).write.mode("overwrite")
    out.option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return touched
