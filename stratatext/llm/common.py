"""Shared pieces of the operators: tables in the shared folder, files, hashes, text units."""

from __future__ import annotations

import sys
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratatext.session import shared_folder, shuffles_dropped

#: White space of the word contracts: space, tab, line feed, vertical tab, form feed, return.
SPACE_CLASS = r"[\x20\x09-\x0D]"

#: Odd 64-bit multipliers of the mixing steps below (fixed values, any odd numbers do).
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)


def per_process(key, make):
    """``make()``, kept for all later tasks of this worker process.

    The package's functions travel by value, so their module's variables are new in
    each task; a module of this process holds what is to last.
    """
    held = sys.modules.setdefault("_stratatext_process", types.ModuleType("_stratatext_process")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` compactly to the shared folder; the table read back, and its path."""
    path = new_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables that :func:`save` or :func:`new_path` made."""
    jvm = spark._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def file_system(path: str):
    """(file system, path inside it) of a shared-folder path, inside a task."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with null texts as empty ones; other columns are left out."""
    return docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias(text))


def arrow_rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    """A record batch from row tuples."""
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def small(batches, rows: int = 512, size: int = 4 << 20):
    """Arrow batches cut to at most ``rows`` rows and about ``size`` bytes of text (column 1)."""
    for batch in batches:
        begin = 0
        while begin < batch.num_rows:
            n = min(rows, batch.num_rows - begin)
            while n > 1 and batch.column(1).slice(begin, n).nbytes > size:
                n //= 2
            yield batch.slice(begin, n)
            begin += n


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_A
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_B
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word bytes to a 64-bit hash; forgets everything when it holds ``limit`` words."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as UTF-8 (bytes split and lower ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` neighbouring words; none if there are fewer words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, size):
        out = mix(out + np.uint64(i)) + hashes[i : i + n]
    return mix(out)
