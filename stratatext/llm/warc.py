"""WARC archives: written by Spark's text writer, indexed, and read back by byte ranges.

A record ends in two empty lines, so a text file whose line separator is CRLF CRLF and
whose lines are header, empty line and block is a WARC file as it stands.  Reading
goes index first: one pass over the headers gives offset, length, URL and digest of
each record; the wanted records, sorted by file and offset, are then fetched by few
reads, each over records that lie close together.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratatext.llm.common import file_system, new_path, save

#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
#: Header field for the place of a page in its table.
PAGE, REFERS, BYTES = "X-Page-Id", "X-Refers-To-Page-Id", "X-Payload-Length"
#: Records closer than this are read together, up to this much at a time.
GAP, READ = 64 << 10, 8 << 20
#: Bytes looked at for a header; longer ones are read on.
PEEK = 4 << 10


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def digests(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, payload_bytes, payload_digest``; null html is empty."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("strong", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [t.as_py().encode() for t in batch.column(2)]
            more = [pa.array([len(x) for x in data], pa.int64()), pa.array([sha1_base32(x) for x in data], pa.string()), pa.array([hashlib.sha256(x).digest() for x in data], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], schema=schema)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, html string, payload_bytes long, payload_digest string, strong binary")


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> None:
    """Write a record per page; equal payloads become revisits of the smallest page_id.

    Payloads under ``least_bytes`` are always stored.  Rows that repeat a page_id and
    its payload are all responses; a page without page_id is one unless a page with
    one has the payload.
    """
    full = digests(pages)
    keys, _ = save(full.select("strong", "page_id", "payload_bytes"), "page-keys")
    first, _ = save(keys.where(F.col("payload_bytes") >= least_bytes).groupBy("strong").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "payloads")
    lead = first.withColumnRenamed("strong", "_strong")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    uuid_of = lambda page: F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat(F.lit("page-"), page.cast("string")).cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    block = F.when(again, F.lit("")).otherwise(F.col("html"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    head = F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", uuid_of(page)),
        line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        line("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(again, F.concat(line("WARC-Refers-To", uuid_of(F.col("first"))), line(REFERS, F.col("first")), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line(PAGE, page),
        line(BYTES, F.col("payload_bytes")),
        line("Content-Length", F.when(again, F.lit(0)).otherwise(F.col("payload_bytes"))),
        F.lit("\r\n"),
    )
    out = full.join(lead, (F.col("strong") == F.col("_strong")) & (F.col("payload_bytes") >= least_bytes), "left")
    out.select(F.concat(head, block).alias("value")).write.option("lineSep", END).text(folder)


def fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8").split("\r\n")[1:]:
        name, _, value = line.partition(": ")
        out[name.lower()] = value
    return out


def index_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: ``file, offset, length, body, url, digest, type, page_id``.

    Reads headers and steps over blocks; ``body`` is the length of the block.
    """
    files = spark.read.format("binaryFile").load(folder).select("path").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("body", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("type", pa.string()), ("page_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = file_system(path)
                rows = []
                with fs.open_input_file(name) as f:
                    at, size = 0, f.size()
                    begin, window = 0, b""
                    while at < size:
                        step = PEEK
                        while (cut := window.find(b"\r\n\r\n", at - begin) if begin <= at < begin + len(window) else -1) < 0:
                            if at + step > size + 2 * PEEK:
                                raise ValueError(f"no record header at {at} of {path}")
                            begin, window, step = at, f.read_at(max(step, 256 << 10), at), 2 * max(step, 256 << 10)
                        head = window[at - begin : cut]
                        got = fields(head)
                        body = int(got["content-length"])
                        length = len(head) + 4 + body + 4
                        page = got[PAGE.lower()]
                        rows.append((path, at, length, body, got["warc-target-uri"], got["warc-payload-digest"].removeprefix("sha1:"), got["warc-type"], int(page) if page else None))
                        at += length
                        if len(rows) == 5000:
                            yield batch_of(rows, schema)
                            rows = []
                if rows:
                    yield batch_of(rows, schema)

    return files.mapInArrow(run, "file string, offset long, length long, body long, url string, digest string, type string, page_id long")


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def read_records(index: DataFrame) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to, html`` of index rows.

    Rows are dealt out by file and offset range and sorted, so neighbours share reads.
    A stored payload whose digest differs from its header raises.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("html", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for path, begin, end, some in ranges(wanted):
                fs, name = file_system(path)
                with fs.open_input_file(name) as f:
                    data = f.read_at(end - begin, begin)
                yield batch_of([record(data[o - begin : o - begin + n]) for o, n in some], schema)

    dealt = index.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset").select("file", "offset", "length")
    return dealt.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")


def ranges(wanted: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(file, begin, end, records) of the reads for sorted (file, offset, length)."""
    path, begin, end, some = None, 0, 0, []
    for file, offset, length in wanted:
        if some and (file != path or offset > end + GAP or offset + length - begin > READ):
            yield path, begin, end, some
            some = []
        if not some:
            path, begin = file, offset
        end = offset + length
        some.append((offset, length))
    if some:
        yield path, begin, end, some


def record(data: bytes) -> tuple:
    head, _, rest = data.partition(b"\r\n\r\n")
    got = fields(head)
    body, kind = rest[: int(got["content-length"])], got["warc-type"]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError(f"record {got['warc-record-id']} doesn't end where its header says")
    digest, page, refers = got["warc-payload-digest"].removeprefix("sha1:"), got[PAGE.lower()], got.get(REFERS.lower())
    if kind == "response" and (sha1_base32(body) != digest or len(body) != int(got[BYTES.lower()])):
        raise ValueError(f"record {got['warc-record-id']} is damaged")
    return (int(page) if page else None, got["warc-target-uri"], int(got[BYTES.lower()]), digest, kind, int(refers) if refers else None, None if kind == "revisit" else body.decode())


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages as archives, index them and read every record back.

    Null html is an empty payload, a null url an empty one, a null page_id comes back
    as null; repeated rows have a record each; no pages give no rows; other columns
    are left out.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    write_archives(pages, folder)
    index, _ = save(index_archives(spark, folder), "warc-index")
    return read_records(index)
