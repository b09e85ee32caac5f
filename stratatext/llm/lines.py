"""Dropping lines that many documents share, but for one copy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratatext.llm.common import bind, save
from stratatext.llm.seen import filter_bits, maybe_repeated, twice_seen

#: Fixed values of the rule: code points of a key, documents that must share it.
MIN_CHARS = 40
MIN_DOCS = 5
#: Characters per expected long line, to size the filters.
CHARS_PER_LINE = 100


def line_keys(text: str, min_chars: int) -> list[tuple[int, bytes]]:
    """(line number, key) of the lines whose key has ``min_chars`` code points or more.

    Stripping and lowering bytes touch ASCII alone, as the rule asks.
    """
    out = []
    for i, line in enumerate(text.encode().split(b"\n")):
        if len(line) >= min_chars:
            key = line.strip(b" \t\n\x0b\x0c\r").lower()
            if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                out.append((i, key))
    return out


def _hashes(keys) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))


def shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, drops): numbers of the lines to drop, for documents that lose any.

    A first pass fills the filters, a second lets only suspected repeats out, as
    128-bit digests of their keys; documents are counted per digest exactly.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0

    def hashes_of(batch: pa.RecordBatch) -> np.ndarray:
        found = [_hashes({k for _, k in line_keys(t.as_py(), min_chars)}) for t in batch.column(1)]
        return np.concatenate(found) if found else np.empty(0, np.uint64)

    seen = twice_seen(rows, hashes_of, filter_bits(size // CHARS_PER_LINE))
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("at", pa.list_(pa.int32()))])

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, at = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                by: dict[bytes, list[int]] = {}
                for i, key in line_keys(text.as_py(), min_chars):
                    by.setdefault(key, []).append(i)
                for key, ok in zip(by, maybe_repeated(seen.value, _hashes(by)), strict=True) if by else ():
                    if ok:
                        ids.append(doc)
                        keys.append(hashlib.blake2b(key, digest_size=16).digest())
                        at.append(by[key])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(at, pa.list_(pa.int32()))], schema=schema)

    found, _ = save(rows.mapInArrow(suspects, "doc_id long, key binary, at array<int>"), "line-suspects")
    seen.destroy()
    counted = found.groupBy("key").agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= min_docs)
    shared, _ = save(counted.select("key", "last"), "lines-shared")  # a table, so that hot keys can be split in the join
    hit = found.join(shared, "key").where("doc_id <> last")
    return hit.groupBy("doc_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("at")))).alias("drops"))


def without_shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``text`` lacking the dropped lines, and ``_n_lines, _n_dropped``.

    The kept copy is all of a key's lines in the largest doc_id that has it.  Null and
    empty texts have one empty line; a null doc_id keeps all its lines and takes no
    part; of a repeated doc_id all rows count as one document, and a line number
    dropped in one is dropped in each.  Other columns stay; where they
    have the name of an added one, that gets more underscores.  No documents give no rows.
    """
    out = _marked(docs, min_chars, min_docs)
    own = [F.col("kept").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return out.select(*own, F.col("n_lines").alias(_unused("_n_lines", docs)), F.col("n_dropped").alias(_unused("_n_dropped", docs)))


def _unused(name: str, docs: DataFrame) -> str:
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = "_" + name
    return name


def _marked(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """``row`` (a document's columns), ``n_lines, n_dropped, kept`` (its text without the dropped lines)."""
    drops, _ = save(shared_lines(docs, min_chars, min_docs).withColumnRenamed("doc_id", "of"), "line-drops")
    text = F.coalesce(F.col("text"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("id"), text.alias("whole"), F.split(text, "\n").alias("lines"))
    joined = rows.join(drops, F.col("id") == F.col("of"), "left")
    none = F.col("drops").isNull()
    kept = F.when(none, F.col("whole")).otherwise(F.array_join(_without(F.col("lines"), F.col("drops")), "\n"))
    dropped = F.when(none, F.lit(0)).otherwise(F.size(F.filter("drops", lambda d: d < F.size("lines")))).cast("long")
    return joined.select("row", F.size("lines").cast("long").alias("n_lines"), dropped.alias("n_dropped"), kept.alias("kept"))


def _without(lines: Column, drops: Column) -> Column:
    """``lines`` but for the ascending numbers in ``drops``, as the runs between them."""
    ends = F.concat(F.filter(drops, lambda d: d < F.size(lines)), F.array(F.size(lines)))
    before = lambda e, k: F.when(k > 0, F.get(e, k - 1) + 1).otherwise(F.lit(0))
    return bind(ends, lambda e: F.flatten(F.transform(e, lambda end, k: F.slice(lines, before(e, k) + 1, end - before(e, k)))))


def line_table(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of each document."""
    out = _marked(docs.select("doc_id", "text"), min_chars, min_docs)
    return out.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
