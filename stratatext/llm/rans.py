"""Token-id archives coded by a static range asymmetric numeral system.

One frequency table, counted over the whole corpus, is shared by all files.  A
block holds whole documents and is coded alone: its ids are dealt over ``LANES``
interleaved coder states, so that numpy advances all lanes at once.  A file is

    magic | block ... | index | n_blocks (8) | index offset (8) | magic

A block is: header (n_docs, n_ids, first id's place in the corpus, n_words, crc32 of
the ids, crc32 of the table), doc_ids (8 each), lengths (8 each), lane states (8
each), code words (4 each).  The index holds each block's (offset, length, first id,
n_ids): checkpoints from which any block is decoded without the others.  A wrong
checksum raises.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratatext.llm.common import drop, file_system, new_path, per_process, save, small, texts
from stratatext.llm.units import Units

MAGIC = b"STRANS01"
LANES = 1024
#: A block is closed once it holds this many ids; documents are never cut.
BLOCK_IDS = 1 << 18
#: Blocks a file holds at most.
FILE_BLOCKS = 64
HEAD = "<QQQQIIQ"
LOW = np.uint64(1 << 31)


class Table:
    """Frequencies of all symbols, summing to ``1 << bits``, none of them zero."""

    def __init__(self, counts: np.ndarray):
        self.bits = max(12, int(len(counts) - 1).bit_length() + 2)
        total, scale = max(1, int(counts.sum())), (1 << self.bits) - len(counts)
        freq = 1 + counts.astype(np.int64) * scale // total if total < 1 << 40 else 1 + (counts / total * scale).astype(np.int64)
        freq[int(np.argmax(freq))] += (1 << self.bits) - int(freq.sum())
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(counts), dtype=np.uint32), freq)
        self.crc = zlib.crc32(self.freq.astype("<u4").tobytes())


def encode(ids: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray]:
    """(lane states, code words) of ids; ``decode`` reads them forwards."""
    states, steps = np.full(LANES, LOW, np.uint64), []
    up, word, bits = np.uint64(63 - table.bits), np.uint64(32), np.uint64(table.bits)
    freq, start = table.freq[ids], table.start[ids]
    for at in range((len(ids) - 1) // LANES * LANES if len(ids) else -1, -1, -LANES):
        f, x = freq[at : at + LANES], states[: min(LANES, len(ids) - at)]
        full = x >= (f << up)
        steps.append(x[full].astype(np.uint32))
        x = np.where(full, x >> word, x)
        q = x // f
        states[: len(x)] = (q << bits) + (x - q * f) + start[at : at + LANES]
    return states, np.concatenate(steps[::-1]) if steps else np.empty(0, np.uint32)


def decode(n: int, states: np.ndarray, words: np.ndarray, table: Table) -> np.ndarray:
    states, at_word = states.copy(), 0
    out = np.empty(n, np.uint32)
    bits, mask, word = np.uint64(table.bits), np.uint64((1 << table.bits) - 1), np.uint64(32)
    for at in range(0, n, LANES):
        x = states[: min(LANES, n - at)]
        slot = x & mask
        s = table.symbol[slot]
        out[at : at + len(x)] = s
        x = table.freq[s] * (x >> bits) + slot - table.start[s]
        low = np.flatnonzero(x < LOW)
        x[low] = (x[low] << word) | words[at_word : at_word + len(low)]
        at_word += len(low)
        states[: len(x)] = x
    if at_word != len(words) or not (states == LOW).all():
        raise ValueError("damaged block: the coder did not end in its first state")
    return out


def pack(doc_ids: bytes, lengths: bytes, ids: np.ndarray, first: int, table: Table) -> bytes:
    states, words = encode(ids, table)
    head = struct.pack(HEAD, len(doc_ids) // 8, len(ids), first, len(words), zlib.crc32(ids.astype("<u4").tobytes()), table.crc, 0)
    return head + doc_ids + lengths + states.astype("<u8").tobytes() + words.astype("<u4").tobytes()


def unpack(block: bytes, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(doc_ids, lengths, ids, place of the first id) of a block; raises if it is damaged."""
    n_docs, n, first, n_words, crc, table_crc, _ = struct.unpack_from(HEAD, block)
    if table_crc != table.crc:
        raise ValueError("the block was written with another frequency table")
    at = struct.calcsize(HEAD)
    doc_ids = np.frombuffer(block, "<i8", n_docs, at)
    lengths = np.frombuffer(block, "<i8", n_docs, at + 8 * n_docs)
    at += 16 * n_docs
    states = np.frombuffer(block, "<u8", LANES, at).astype(np.uint64)
    ids = decode(n, states, np.frombuffer(block, "<u4", n_words, at + 8 * LANES).astype(np.uint64), table)
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("damaged block: checksum")
    return doc_ids, lengths, ids, first


class Writer:
    """Writes one archive file block by block, under a name of its own for each attempt."""

    def __init__(self, folder: str, first: int):
        fs, root = file_system(folder)
        self.name = f"{first:020d}-{uuid.uuid4().hex}.ids"
        fs.create_dir(root, recursive=True)
        self.out, self.index, self.at = fs.open_output_stream(f"{root}/{self.name}"), [], len(MAGIC)
        self.out.write(MAGIC)

    def add(self, block: bytes, first: int, n: int) -> None:
        self.out.write(block)
        self.index.append((self.at, len(block), first, n))
        self.at += len(block)

    def close(self) -> tuple[str, int]:
        index = np.array(self.index, "<u8").tobytes()
        self.out.write(index + struct.pack("<QQ", len(self.index), self.at) + MAGIC)
        self.out.close()
        return self.name, len(self.index)


def read_index(path: str) -> np.ndarray:
    """(offset, length, first id, n_ids) of each block of a file."""
    fs, name = file_system(path)
    with fs.open_input_file(name) as f:
        size = f.size()
        n, at, magic = struct.unpack("<QQ8s", f.read_at(24, size - 24))
        if magic != MAGIC or f.read_at(8, 0) != MAGIC:
            raise ValueError(f"not an archive: {path}")
        return np.frombuffer(f.read_at(32 * n, at), "<u8").reshape(n, 4)


BLOCKS = "part int, place long, n_docs int, n_ids long, doc_ids binary, lengths binary, ids binary"
FILES = "file string, n_blocks long, first long"
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def token_blocks(docs: DataFrame, encoder: Callable, end_id: int, kind: str) -> DataFrame:
    """Blocks of whole documents in ascending doc_id order, ids packed as ``kind``.

    ``part`` ascends with doc_id; ``place`` counts the ids before the block in its part.
    """
    schema = pa.schema([("part", pa.int32()), ("place", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.binary()), ("lengths", pa.binary()), ("ids", pa.binary())])
    end = np.array([end_id], kind).tobytes()
    width = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = encoder()
        part, place, n, keys, lengths, data = TaskContext.get().partitionId(), 0, 0, [], [], []

        def block() -> pa.RecordBatch:
            row = (part, place, len(keys), n, np.array(keys, "<i8").tobytes(), np.array(lengths, "<i8").tobytes(), b"".join(data))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in small(batches):
            for key, ids in zip(batch.column(0).to_pylist(), encode_all(batch.column(1).to_pylist()), strict=True):
                keys.append(NULL_ID if key is None else key)
                lengths.append(len(ids) // width + 1)
                data += (ids, end)
                n += lengths[-1]
                if n >= BLOCK_IDS:
                    yield block()
                    place, n, keys, lengths, data = place + n, 0, [], [], []
        if keys:
            yield block()

    ordered = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, BLOCKS)


#: The letters of a space and a line feed in a byte-level vocabulary.
SPACE_LETTERS = "\u0120\u010a"

#: Stands for a null doc_id inside the files.
NULL_ID = -(1 << 63)


def symbol_counts(blocks: DataFrame, size: int, kind: str) -> np.ndarray:
    """Occurrences of each of ``size`` symbols over all blocks; at most ``size`` rows reach the driver."""
    schema = pa.schema([("id", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                counts += np.bincount(np.frombuffer(ids.as_buffer(), kind), minlength=size)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(counts[seen])], schema=schema)

    rows = blocks.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(size, np.int64)
    for r in rows.toLocalIterator():
        counts[r["id"]] = r["n"]
    return counts


def write_archives(blocks: DataFrame, table: Table, kind: str, folder: str) -> DataFrame:
    """Code the blocks into files of ``folder``; one row per file whose task succeeded.

    A file holds consecutive blocks and is named after its first id's place in the
    corpus, so names in order give the ids in order.
    """
    parts = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    base, total = {}, 0
    for part in sorted(parts):
        base[part], total = total, total + parts[part]
    shared = blocks.sparkSession.sparkContext.broadcast((table, base))
    schema = pa.schema([("file", pa.string()), ("n_blocks", pa.int64()), ("first", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, starts = shared.value
        done, out, due = [], None, -1
        for batch in batches:
            for row in range(batch.num_rows):
                part, place, _, n, keys, lengths, ids = (c[row].as_py() for c in batch.columns)
                first = starts[part] + place
                if out is not None and (first != due or len(out.index) >= FILE_BLOCKS):
                    done.append((*out.close(), begin))
                    out = None
                if out is None:
                    out, begin = Writer(folder, first), first
                out.add(pack(keys, lengths, np.frombuffer(ids, kind), first, freq), first, n)
                due = first + n
        if out is not None:
            done.append((*out.close(), begin))
        columns = list(zip(*done, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return blocks.mapInArrow(run, FILES)


def read_archives(files: DataFrame, table: Table, folder: str) -> DataFrame:
    """One row per document, decoded from the files: ``doc_id, start, n_tokens, ids_crc32``."""
    shared = files.sparkSession.sparkContext.broadcast(table)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for batch in batches:
            for name, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                offset, length = row
                with fs.open_input_file(f"{root}/{name}") as f:
                    keys, lengths, ids, first = unpack(f.read_at(length, offset), shared.value)
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[e - n : e].astype("<u4").tobytes()) for e, n in zip(ends, lengths, strict=True)]
                keys = pa.array([None if k == NULL_ID else k for k in keys.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([keys, pa.array(first + ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64())], schema=schema)

    return block_index(files, folder).mapInArrow(run, DOCS)


def block_index(files: DataFrame, folder: str) -> DataFrame:
    """``file, at [offset, length], first, n_ids`` of every block, spread for parallel decoding."""
    schema = pa.schema([("file", pa.string()), ("at", pa.list_(pa.int64())), ("first", pa.int64()), ("n_ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                index = read_index(os.path.join(folder, name)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(index)), pa.array(index[:, :2].tolist(), schema.field("at").type), pa.array(index[:, 2]), pa.array(index[:, 3])], schema=schema)

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("file").mapInArrow(run, "file string, at array<long>, first long, n_ids long").repartition(parts, "file", "first")


def round_trip(docs: DataFrame, encoder: Callable, size: int, end_id: int) -> DataFrame:
    """Write all documents' ids as archives and read them back, one row per document.

    ``encoder()`` makes, inside a task, a function from a list of texts to a list of
    packed ids below ``size``.  Null texts count as empty (the end id alone); null
    doc_ids come first and return as null; repeated doc_ids keep a row each, ordered
    by text; other columns are ignored; no documents give no rows.
    """
    spark = docs.sparkSession
    kind = id_kind(size)
    blocks, blocks_path = save(token_blocks(docs, encoder, end_id, kind), "id-blocks")
    table, folder = Table(symbol_counts(blocks, size, kind)), new_path(spark, "id-archive")
    files, _ = save(write_archives(blocks, table, kind, folder), "id-files")
    drop(spark, blocks_path)
    return read_archives(files, table, folder)


def id_kind(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def library_encoder(path: str) -> Callable:
    """Maker of an encoder by the tokenizers library.

    Text units that recur are encoded once per worker (:class:`Units`); units new to
    it go to the library, as do, whole, texts that hold a special item.
    """

    return lambda: per_process(("library encoder", path), lambda: _Library(path)).encode_all



class _Library:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        size = self.tokenizer.get_vocab_size()
        self.kind = id_kind(size)
        #: Tokens that open a unit: a space or line feed comes first.
        opens = {i for item, i in self.tokenizer.get_vocab().items() if item[0] in SPACE_LETTERS}
        self.opens = np.isin(np.arange(size), list(opens))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.units = Units(self._units, self._text)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def _text(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def _units(self, units: list[str]) -> list[bytes]:
        ids = self._ids("".join(units))
        width, data = ids.itemsize, ids.tobytes()
        bounds = [*(np.flatnonzero(self.opens[ids]) * width).tolist(), len(data)]
        return [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def encode_all(self, some: list[str]) -> list[bytes]:
        marked = [i for i, t in enumerate(some) if any(x in t for x in self.special)]
        out = self.units.texts(["" if i in set(marked) else t for i, t in enumerate(some)] if marked else some)
        for i in marked:
            out[i] = self._text(some[i])
        return out
