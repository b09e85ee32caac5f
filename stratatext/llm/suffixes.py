"""Bytes of repeated strings, from sampled suffixes.

The difference-cover way to a suffix array sorts the suffixes at sampled places first
and ranks the others by the few bytes up to the next sampled one.  Its cover is chosen
so that any two suffixes meet sampled places at one common distance.  Here only equal
strings of ``LENGTH`` bytes must do so, which a cover chosen by content gives with far
fewer places: of each string's grams, the place of the smallest hash (the first one).
Every start of a string belongs to one sampled place, its anchor, at a distance that
is the same wherever the string stands.

1. Anchors whose gram occurs once in the corpus go (:mod:`seen`).
2. An anchor's tuple is the name of its gram and the name of the context that its
   starts span.  Equal tuples are counted: all starts of a context met twice repeat.
3. Where one gram has several contexts, some met once, what is left is merged: the
   starts of each different context are named by their own strings, and equal names
   compared.

Names are 128-bit hashes.  Equal neighbours are found by grouping, so a name that
holds a large part of all rows is counted before it is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratatext.llm.common import drop, mix, save, texts
from stratatext.llm.seen import filter_bits, maybe_repeated, twice_seen

LENGTH = 200
GRAM = 64
#: Starts looked at together; a long text is walked in pieces of this many.
PIECE = 1 << 22
PLACE_BITS = np.uint64(23)
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, made once per worker."""

    def __init__(self, base: int, n: int):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        self.up = np.multiply.accumulate(steps)
        steps[1:] = pow(base, -1, 1 << 64)
        self.down = np.multiply.accumulate(steps)
        self.letters = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))


def window_hashes(data: np.ndarray, size: int, powers: Powers) -> np.ndarray:
    """Hash of each run of ``size`` bytes, from prefix sums of a polynomial."""
    n = len(data) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(powers.letters[data] * powers.up[: len(data)], out=sums[1:])
    return mix((sums[size:] - sums[:n]) * powers.down[:n])


def powers_of(which: int) -> Powers:
    from stratatext.llm.common import per_process

    return per_process(("powers", which), lambda: Powers(BASES[which], PIECE + 2 * LENGTH))


def sliding_minimum(x: np.ndarray, size: int) -> np.ndarray:
    span = 1
    while 2 * span <= size:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (size - span)], x[size - span :]) if size > span else x


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(piece's place, first starts, last starts, anchors, gram hashes), places within the piece."""
    mask = (np.uint64(1) << PLACE_BITS) - np.uint64(1)
    for begin in range(0, len(data) - length + 1, PIECE):
        piece = data[begin : begin + PIECE + length - 1]
        hashes = window_hashes(piece, gram, powers_of(0))
        packed = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
        at = (sliding_minimum(packed, length - gram + 1) & mask).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        last = np.concatenate([first[1:] - 1, [len(at) - 1]])
        yield begin, first, last, at[first], mix(hashes[at[first]])  # minima are all small: spread them again


def repeated_starts(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, first, last``: runs of starts whose string stands elsewhere too."""
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def gram_hashes(batch: pa.RecordBatch) -> np.ndarray:
        found = [h for t in batch.column(1) for *_, h in anchors(np.frombuffer(t.as_buffer(), np.uint8), length, gram)]
        return np.concatenate(found) if found else np.empty(0, np.uint64)

    seen = twice_seen(rows, gram_hashes, filter_bits(2 * size // (length - gram)))
    schema = pa.schema([("gram", pa.int64()), ("name", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int64()), ("more", pa.int32())])

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                for begin, first, last, at, hashes in anchors(data, length, gram):
                    for k in np.flatnonzero(maybe_repeated(seen.value, hashes)).tolist():
                        a, more = begin + int(first[k]), int(last[k]) - int(first[k])
                        name = hashlib.blake2b(data[a : a + more + length], digest_size=8, salt=(int(at[k]) - int(first[k])).to_bytes(4, "big")).digest()
                        out.append((int(hashes[k].view(np.int64)), int.from_bytes(name, "big", signed=True), doc, a, more))
                    if len(out) > 20_000:
                        yield rows_batch(out, schema)
                        out = []
            yield rows_batch(out, schema)

    found, found_path = save(rows.mapInArrow(sampled, "gram long, name long, doc_id long, first long, more int"), "anchors")
    lead = F.min(F.struct("doc_id", "first", "more")).alias("lead")
    named, named_path = save(found.groupBy("gram", "name").agg(F.count(F.lit(1)).alias("n"), lead), "contexts")
    open_, open_path = save(named.groupBy("gram").agg(F.count(F.lit(1)).alias("contexts"), F.min("n").alias("least")).where("contexts > 1 and least = 1").select("gram"), "open-grams")
    again, again_path = save(named.where("n > 1").select("gram", "name"), "repeated-contexts")
    whole = found.join(again, ["gram", "name"]).select("doc_id", "first", (F.col("first") + F.col("more")).alias("last"))
    leads, leads_path = save(named.join(open_, "gram").select("lead.*", "n"), "leads")

    # The leads' contexts, by another walk over the texts that a filter of their places spares from a shuffle.
    place = lambda doc, first: mix(mix(doc.astype(np.uint64) + np.uint64(1)) + first.astype(np.uint64))
    wanted = twice_seen(leads.select("doc_id", "first"), lambda b: place(np.asarray(b.column(0)), np.asarray(b.column(1))), filter_bits(leads.count()), times=1)
    context_schema = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("context", pa.binary())])

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                for begin, first, last, _, hashes in anchors(data, length, gram):
                    ok = maybe_repeated(wanted.value, place(np.full(len(first), doc), begin + first)) & maybe_repeated(seen.value, hashes)
                    out += [(doc, begin + int(first[k]), data[begin + first[k] : begin + last[k] + length].tobytes()) for k in np.flatnonzero(ok).tolist()]
                if len(out) > 20_000:
                    yield rows_batch(out, context_schema)
                    out = []
            yield rows_batch(out, context_schema)

    edge, edge_path = save(rows.mapInArrow(contexts, "doc_id long, first long, context binary").join(leads, ["doc_id", "first"]).select("doc_id", "first", "n", "context"), "edges")
    seen.destroy()
    wanted.destroy()

    def strings(context: bytes) -> np.ndarray:
        return window_hashes(np.frombuffer(context, np.uint8), length, powers_of(0))

    def all_strings(batch: pa.RecordBatch) -> np.ndarray:
        return np.concatenate([np.repeat(strings(c), min(2, n)) for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)] or [np.empty(0, np.uint64)])

    # Starts of contexts met once that stand elsewhere, and starts of the others that meet one of those.
    many = edge.agg(F.sum(F.length("context") - (length - 1))).first()[0] or 0
    twice = twice_seen(edge.select("n", "context"), all_strings, filter_bits(many))
    lone = twice_seen(edge.where("n = 1").select("n", "context"), all_strings, filter_bits(many), times=1)
    start_schema = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple] = []
            for doc, first, n, context in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = strings(context)
                ok = np.flatnonzero(maybe_repeated(twice.value if n == 1 else lone.value, x))
                if len(ok):
                    y = window_hashes(np.frombuffer(context, np.uint8), length, powers_of(1))
                    parts.append((x[ok].view(np.int64), y[ok].view(np.int64), np.full(len(ok), doc), first + ok, np.full(len(ok), min(n, 2))))
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=start_schema)

    single, single_path = save(edge.mapInArrow(starts, "x long, y long, doc_id long, start long, n long"), "starts")
    twice.destroy()
    lone.destroy()
    equal, equal_path = save(single.groupBy("x", "y").agg(F.sum("n").alias("n")).where("n > 1").select("x", "y"), "repeated-starts")
    merged = single.where("n = 1").join(equal, ["x", "y"]).select("doc_id", F.col("start").alias("first"), F.col("start").alias("last"))
    out, _ = save(whole.union(merged), "repeats")
    drop(spark, found_path, named_path, open_path, again_path, leads_path, edge_path, single_path, equal_path)
    return out


def rows_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def byte_table(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each whole text.

    A byte goes if a string of ``length`` bytes over it stands anywhere else in the
    table, overlapping or in the same document too.  Null and empty texts have no
    bytes.  Rows with a null doc_id or a repeated one are told apart by a row number
    given beforehand.  Other columns are ignored.
    """
    numbered, _ = save(texts(docs).withColumn("row", F.monotonically_increasing_id()), "rows")
    runs = repeated_starts(numbered.select(F.col("row").alias("doc_id"), "text"), length, gram)
    by_doc = runs.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("runs")).withColumnRenamed("doc_id", "_row")
    joined = numbered.join(by_doc, numbered["row"] == by_doc["_row"], "left").select("doc_id", "text", "runs")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, met in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                if not met.is_valid:
                    out.append((doc, len(data), 0, 0, hashlib.sha256(data.tobytes()).hexdigest()))
                    continue
                met = met.values.flatten()
                edge = np.zeros(len(data) + 1, np.int32)
                np.add.at(edge, np.asarray(met[0]), 1)
                np.add.at(edge, np.asarray(met[1]) + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((doc, len(data), int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            yield rows_batch(out, schema)

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
