"""Two Bloom filters over a whole corpus: hashes seen once, and hashes seen twice.

Every task marks its hashes in filters of its own: a place met a second time enters
the second filter.  Tasks pass on places, not filters, cut into ranges and packed as
sorted gaps; each range is merged in one stream, in which a place that comes again
moves to the second filter too.  Only that second filter, of a bounded number of bits,
goes to all tasks.  It never misses a repeat; what it lets through by mistake is for an
exact step to sort out.  Past the bound it lets more through: that costs shuffle, not
results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratatext.llm.common import mix

#: Bits per expected hash, and the bounds of a filter (2^29 bits are 64 MB).
BITS_PER_HASH = 8
LEAST_BITS, MOST_BITS = 20, 29
#: A merged range of the filter covers so many bits.
RANGE_BITS = 20


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def filter_bits(expected: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, int(BITS_PER_HASH * max(1, expected) - 1).bit_length()))


def twice_seen(rows: DataFrame, hashes_of: Callable[[pa.RecordBatch], np.ndarray], bits: int, times: int = 2) -> Broadcast:
    """The second filter (the first if ``times`` is 1) as packed bits, given to all tasks.

    ``hashes_of`` gives the hashes of a batch of ``rows``, each once per unit whose
    repeats count (a document's own repeats are to be left out by it).
    """
    schema = pa.schema([("block", pa.int32()), ("again", pa.bool_()), ("gaps", pa.binary())])
    span = 1 << min(RANGE_BITS, bits)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            place, times = np.unique(np.concatenate(held), return_counts=True)
            for again in (False, True):
                some = place[(times > 1) == again]
                cut = np.searchsorted(some, np.arange(0, (1 << bits) + 1, span))
                rows_ = [(k, again, np.diff(some[a:b], prepend=k * span).astype("<u4").tobytes()) for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a]
                if rows_:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows_, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            held.append(places(hashes_of(batch), bits))
            n += len(held[-1])
            if n > 4_000_000:
                yield from out()
                held, n = [], 0
        if n:
            yield from out()

    merged = pa.schema([("block", pa.int32()), ("bits", pa.binary())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = -1, None, None
        wanted = lambda: twice if times > 1 else once

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(wanted()).tobytes()])], schema=merged)

        for batch in batches:
            for block, again, gaps in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != now:
                    if now >= 0 and wanted().any():
                        yield row()
                    now, once, twice = block, np.zeros(span, bool), np.zeros(span, bool)
                at = np.cumsum(np.frombuffer(gaps, "<u4").astype(np.int64))
                twice[at if again else at[once[at]]] = True
                once[at] = True
        if now >= 0 and wanted().any():
            yield row()

    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked = rows.mapInArrow(mark, "block int, again boolean, gaps binary").repartition(parts, "block").sortWithinPartitions("block")
    whole = np.zeros(max(1, (1 << bits) // 8), np.uint8)  # the bound on what reaches the driver
    for r in marked.mapInArrow(merge, "block int, bits binary").toLocalIterator():
        whole[r["block"] * (span // 8) : (r["block"] + 1) * (span // 8)] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return spark.sparkContext.broadcast((bits, whole))


def maybe_repeated(seen: tuple[int, np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """Which hashes the second filter holds."""
    bits, whole = seen
    at = places(hashes, bits)
    return (whole[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


#: Times :data:`BITS_PER_HASH` that a filter of ids takes: 1 in 64 of the other ids pass.
ID_FACTOR = 8


def id_filter(ids: DataFrame) -> Broadcast:
    """The first filter of the ids (long) in the first column, given to all tasks."""
    ids = ids.select(F.col(ids.columns[0]).alias("id")).where("id is not null")
    return twice_seen(ids, lambda batch: mixed_ids(batch.column(0)), filter_bits(ids.count() * ID_FACTOR), times=1)


def mixed_ids(ids: pa.Array) -> np.ndarray:
    return mix(np.asarray(ids, np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def maybe_among(ids: Column, seen: Broadcast) -> Column:
    """Whether an :func:`id_filter` holds the id: true for all that went into it and a few others, false for null.

    Rows that it holds back need no join, so their texts are not shuffled.
    """

    @F.arrow_udf("boolean")
    def held(some: pa.Array) -> pa.Array:
        return pa.array(maybe_repeated(seen.value, mixed_ids(some)))

    return ids.isNotNull() & held(F.coalesce(ids.cast("long"), F.lit(0).cast("long")))
