"""Near-duplicate documents by MinHash with tensored banding.

A table key usually takes as many fresh minhashes as it is long.  Here two
collections of ``COLLECTION`` short keys are drawn, each of ``HALF`` minhashes, and
every pair (one of each) is a table: ``COLLECTION`` squared tables from
``2 * COLLECTION * HALF`` minhashes.  A pair of documents is missed by all tables only
if one whole collection fails: at a similarity of 0.8 about 1e-5 of the pairs.

Equal sets are one class.  Neighbours in the buckets of a few tables are confirmed on
their full sets first; what they unite needs no further confirmation.  Then the buckets
of all tables that still hold several components are sought.  Each has an anchor, its
largest component; the classes of all buckets of one anchor form a group, in which
every class outside the anchor meets all others, on full sets, in blocks of bounded
size: a block's sets are sent once and indexed by shingle, the classes that ask it pass
by in a stream.  So no table of pairs is written, and a class that shares buckets with
thousands of near copies costs one row a block.  Buckets that hold one class alone are
left out beforehand by :mod:`seen`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratatext.llm.common import WordHashes, drop, mix, per_process, save, shingles, texts, words_of
from stratatext.llm.seen import filter_bits, id_filter, maybe_among, maybe_repeated, mixed_ids, twice_seen
from stratatext.session import broadcast_if_small

HALF = 3
COLLECTION = 16
#: Tables whose neighbours are tried first: one from each of four pairs of short keys.
FIRST = np.arange(4) * (COLLECTION + 1)
#: Shingles of a block of sets, about 8 bytes each.
BLOCK = 500_000
SEED = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct shingles, ascending; the whole sequence is one if there are fewer words."""
    if not len(words):
        return words
    return np.unique(shingles(words, size) if len(words) >= size else shingles(words, len(words)))


def short_keys(values: np.ndarray) -> np.ndarray:
    """The 2 * COLLECTION short keys of a set."""
    n = 2 * COLLECTION * HALF
    low = np.full(n, np.iinfo(np.uint64).max)
    turns = mix(np.arange(1, n + 1, dtype=np.uint64) * SEED)
    odd = mix(turns) | np.uint64(1)
    for at in range(0, len(values), 1024):
        some = values[None, at : at + 1024] ^ turns[:, None]
        some *= odd[:, None]  # a bijection of hashes that are mixed already
        np.minimum(low, some.min(axis=1), out=low)
    keys = np.zeros(2 * COLLECTION, np.uint64)
    for part in low.reshape(2 * COLLECTION, HALF).T:
        keys = mix(keys * SEED + part)
    return keys


def signatures(rows: DataFrame, size: int) -> DataFrame:
    """``doc_id, n_shingles, set_key, short`` of each text; the set's key is 128 bits."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("short", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        known = per_process("word hashes", WordHashes)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = shingle_set(known.of(words_of(text.as_py())), size)
                key = hashlib.blake2b(values.tobytes(), digest_size=16).digest()
                out.append((doc, len(values), key, short_keys(values).tobytes() if len(values) else None))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, short binary")


def buckets(short: pa.Array, tables: np.ndarray) -> np.ndarray:
    """A row per class, a column per table: the keys of the tables' pairs of short keys."""
    keys = np.frombuffer(b"".join(short.to_pylist()), np.uint64).reshape(-1, 2, COLLECTION)
    x, y = np.divmod(tables, COLLECTION)
    return mix(keys[:, 0, x] * SEED + mix(keys[:, 1, y] + tables.astype(np.uint64) + np.uint64(1)))


def first_rows(classes: DataFrame, n_classes: int) -> tuple[DataFrame, str]:
    """A written table ``bucket, turn, id, n`` of the first tables' buckets that seem to hold several classes.

    ``turn`` orders a bucket's classes, differently in each table.
    """
    bits = filter_bits(n_classes * len(FIRST))
    seen = twice_seen(classes.select("short"), lambda batch: buckets(batch.column(0), FIRST).ravel(), bits)
    schema = pa.schema([("bucket", pa.int64()), ("turn", pa.int64()), ("id", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = buckets(batch.column(2), FIRST)
            row, table = np.nonzero(maybe_repeated(seen.value, keys.ravel()).reshape(keys.shape))
            ids, sizes = np.asarray(batch.column(0), np.int64)[row], np.asarray(batch.column(1), np.int64)[row]
            turn = mix(ids.astype(np.uint64) * SEED + table.astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[row, table].view(np.int64), turn.view(np.int64), ids, sizes)], schema=schema)

    rows = save(classes.select("id", "n", "short").mapInArrow(run, "bucket long, turn long, id long, n long"), "table-rows")
    seen.destroy()
    return rows


def neighbours(rows: DataFrame) -> DataFrame:
    """(a, b) of classes next to each other in a bucket, of sizes that allow a link.

    Ranges of (bucket, turn) cut a large bucket anywhere; the pair at a cut is left to
    the later, complete step.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            bucket, ids, n = (np.asarray(batch.column(k), np.int64) for k in range(3))
            if last is not None:
                bucket, ids, n = (np.concatenate([[x], y]) for x, y in zip(last, (bucket, ids, n), strict=True))
            if len(ids):
                last = bucket[-1], ids[-1], n[-1]
            x, y, p, q = ids[:-1], ids[1:], n[:-1], n[1:]
            ok = (bucket[:-1] == bucket[1:]) & (x != y) & (100 * np.minimum(p, q) >= 80 * np.maximum(p, q))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)[ok]), pa.array(np.maximum(x, y)[ok])], schema=schema)

    ordered = rows.repartitionByRange("bucket", "turn").sortWithinPartitions("bucket", "turn").select("bucket", "id", "n")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def once_a_component(short: pa.Array, comp: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) over all tables; of a batch's classes of one component, one a bucket."""
    tables = np.arange(COLLECTION**2)
    keys = buckets(short, tables)
    row = np.repeat(np.arange(len(keys)), len(tables))
    keys, again = keys.ravel(), several[row]
    if again.any():
        inside = np.nonzero(again)[0]
        _, one = np.unique(mix(keys[inside] + mix(comp[row[inside]].astype(np.uint64) * SEED)), return_index=True)
        again[inside[one]] = False
        keys, row = keys[~again], row[~again]
    return keys, row


def groups(placed: DataFrame, n_classes: int) -> tuple[DataFrame, str]:
    """A written table ``anchor, id, n, comp`` of the classes in buckets that hold several components.

    ``placed`` has ``id, n, comp, size, short``.  A bucket's anchor is its largest
    component (of equal ones the smallest); only (bucket, component) rows are shuffled to
    find it, so that a large component is a few rows a bucket.
    """
    spark = placed.sparkSession

    def spans(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        return (batch.slice(at, 4096) for at in range(0, batch.num_rows, 4096))

    def one_each(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return once_a_component(batch.column(2), np.asarray(batch.column(0), np.int64), np.asarray(batch.column(1), np.int64) > 1)

    narrow = placed.select("comp", "size", "short")
    bits = filter_bits(n_classes * COLLECTION**2 // 2)
    seen = twice_seen(narrow, lambda batch: np.concatenate([one_each(b)[0] for b in spans(batch)] or [np.empty(0, np.uint64)]), bits)
    schema = pa.schema([("bucket", pa.int64()), ("comp", pa.int64()), ("size", pa.int64())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in spans(batch):
                keys, row = one_each(some)
                ok = maybe_repeated(seen.value, keys)
                comp, size = (np.asarray(some.column(k), np.int64)[row[ok]] for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[ok].view(np.int64), comp, size)], schema=schema)

    met = narrow.mapInArrow(meet, "bucket long, comp long, size long").groupBy("bucket")
    met = met.agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.max(F.struct("size", (-F.col("comp")).alias("c"))).alias("best"))
    mixed, mixed_path = save(met.where("x <> y").select("bucket", (-F.col("best.c")).alias("anchor")), "mixed-buckets")
    seen.destroy()
    wanted = twice_seen(mixed.select("bucket"), lambda batch: np.asarray(batch.column(0), np.int64).view(np.uint64), filter_bits(mixed.count() * 2), times=1)
    found = pa.schema([("bucket", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("comp", pa.int64())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in spans(batch):
                keys = buckets(some.column(3), np.arange(COLLECTION**2))
                row, table = np.nonzero(maybe_repeated(wanted.value, keys.ravel()).reshape(keys.shape))
                ids, n, comp = (np.asarray(some.column(k), np.int64)[row] for k in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[row, table].view(np.int64), ids, n, comp)], schema=found)

    rows = placed.select("id", "n", "comp", "short").mapInArrow(ask, "bucket long, id long, n long, comp long")
    out = save(rows.join(mixed, "bucket").select("anchor", "id", "n", "comp").distinct(), "groups")
    wanted.destroy()
    drop(spark, mixed_path)
    return out


def cells(group: DataFrame) -> DataFrame:
    """``anchor, own, block, asks, id, comp``: the sets of each block, and the classes that ask it.

    Classes of the anchor and the others are cut into blocks of about ``BLOCK``
    shingles; the others ask every block of either kind.
    """
    own = F.col("comp") == F.col("anchor")
    parts = F.ceil(F.sum("n") / BLOCK).cast("int")
    sizes = group.groupBy("anchor", own.alias("own")).agg(parts.alias("parts")).where("parts > 1")
    sizes = sizes.groupBy("anchor").agg(F.max(F.when(F.col("own"), F.col("parts"))).alias("ours"), F.max(F.when(~F.col("own"), F.col("parts"))).alias("theirs"))
    rows = group.join(broadcast_if_small(sizes), "anchor", "left").withColumn("own", own)
    ours, theirs = (F.coalesce(c, F.lit(1)) for c in ("ours", "theirs"))
    block = F.pmod(F.xxhash64("id"), F.when(F.col("own"), ours).otherwise(theirs)).cast("int")
    held = rows.select("anchor", "own", block.alias("block"), F.lit(False).alias("asks"), "id", "comp")
    asking = rows.where("not own").select("anchor", F.explode(F.array(F.lit(True), F.lit(False))).alias("own"), "id", "comp", ours.alias("ours"), theirs.alias("theirs"))
    every = F.explode(F.sequence(F.lit(0), F.when(F.col("own"), F.col("ours")).otherwise(F.col("theirs")) - 1))
    return held.unionByName(asking.select("anchor", "own", every.alias("block"), F.lit(True).alias("asks"), "id", "comp"))


class Block:
    """Sets of a block, indexed by shingle."""

    def __init__(self, comps: list[int], sets: list[np.ndarray]):
        self.comps, self.n = np.array(comps, np.int64), np.array([len(s) for s in sets], np.int64)
        values = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        order = np.argsort(values, kind="stable")
        self.values, self.who = values[order], np.repeat(np.arange(len(sets)), self.n)[order]

    def linked(self, values: np.ndarray) -> np.ndarray:
        """Components of the sets that have a similarity of 0.8 or more with this one."""
        low, high = np.searchsorted(self.values, values, "left"), np.searchsorted(self.values, values, "right")
        many = high - low
        at = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        both = np.bincount(self.who[at], minlength=len(self.n))
        return np.unique(self.comps[100 * both >= 80 * (self.n + len(values) - both)])


def across(group: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """(a, b) of different components with a link between classes of one group."""
    sets, sets_path = save(sets_of(rows, group.select("id").distinct(), size), "sets")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, comps, held, block = None, [], [], None
        for batch in batches:
            out = set()
            keys = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
            for k, (key, asks, comp) in enumerate(zip(keys, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                if key != now:
                    now, comps, held, block = key, [], [], None
                values = np.frombuffer(batch.column(5)[k].as_buffer(), np.uint64)
                if not asks:
                    comps.append(comp)
                    held.append(values.copy())  # lets the batch go
                    continue
                if block is None:
                    block, held = Block(comps, held), []
                out.update((min(comp, c), max(comp, c)) for c in block.linked(values).tolist() if c != comp)
            columns = list(zip(*sorted(out), strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], schema=schema)

    filled = cells(group).join(sets.withColumnRenamed("doc_id", "id"), "id").select("anchor", "own", "block", "asks", "comp", "values")
    ordered = filled.repartition("anchor", "own", "block").sortWithinPartitions("anchor", "own", "block", "asks")
    out, _ = save(ordered.mapInArrow(run, "a long, b long").distinct(), "links")
    drop(rows.sparkSession, sets_path)
    return out


def confirmed(pairs: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) whose full sets have a similarity of 0.8 or more."""
    pairs, pairs_path = save(pairs, "pairs")
    wanted = pairs.selectExpr("a as id").union(pairs.selectExpr("b as id")).distinct()
    sets, sets_path = save(sets_of(rows, wanted, size), "sets")
    left = sets.select(F.col("doc_id").alias("a"), F.col("values").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("values").alias("y"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = []
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint64) for c in (2, 3))
                both = len(x) + len(y) - len(np.union1d(x, y))
                if 100 * both >= 80 * (len(x) + len(y) - both):
                    good.append((a[k], b[k]))
            columns = list(zip(*good, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], schema=schema)

    out, _ = save(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")
    drop(rows.sparkSession, pairs_path, sets_path)
    return out


def sets_of(rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``doc_id, values``: the shingle sets of the rows whose doc_id is an ``id`` of ``wanted``.

    A few other rows have theirs made as well: a filter picks the rows where they are
    read, since a join would shuffle the texts of all.
    """
    seen = id_filter(wanted)
    schema = pa.schema([("doc_id", pa.int64()), ("values", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = per_process("word hashes", WordHashes)
        for batch in batches:
            batch = batch.filter(pa.array(maybe_repeated(seen.value, mixed_ids(batch.column(0)))))
            values = [shingle_set(known.of(words_of(t.as_py())), size).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.binary())], schema=schema)

    return rows.mapInArrow(run, "doc_id long, values binary")


def components(links: DataFrame) -> DataFrame:
    """``id, comp`` for ids that have a link: the smallest id reachable.

    Every node hooks onto its smallest neighbour, hooks are followed twice, and the
    links between what remains are kept, until there are none.  Steps are written
    tables; the smallest id of a component is the one that remains.
    """
    spark = links.sparkSession
    edges, path = save(links.where("a <> b").distinct(), "edges")
    roots, roots_path = save(edges.selectExpr("a as id").union(edges.selectExpr("b as id")).distinct().withColumn("comp", F.col("id")), "roots")
    while not edges.isEmpty():
        both = edges.union(edges.selectExpr("b as a", "a as b"))
        hook, hook_path = save(both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a as x", "least(a, m) as y"), "hooks")
        far = hook.selectExpr("x as y", "y as z")
        hook2, hook2_path = save(hook.join(far, "y").selectExpr("x", "z"), "hooks")
        new_roots, new_roots_path = save(roots.join(hook2, roots["comp"] == hook2["x"], "left").selectExpr("id", "coalesce(z, comp) as comp"), "roots")
        one = edges.join(hook2, edges["a"] == hook2["x"]).selectExpr("z as a", "b")
        two = one.join(hook2, one["b"] == hook2["x"]).selectExpr("a", "z as b").where("a <> b")
        new, new_path_ = save(two.selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct(), "edges")
        drop(spark, path, roots_path, hook_path, hook2_path)
        edges, path, roots, roots_path = new, new_path_, new_roots, new_roots_path
    return roots


def near_duplicates(docs: DataFrame, size: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each document.

    Documents are linked at a Jaccard similarity of 0.8 or more of their distinct
    ``size``-word shingles; ``component_id`` is the smallest doc_id reachable.  Null,
    empty and wordless texts have no shingles and no links.  Rows that repeat a doc_id
    are each answered; different texts under one doc_id share the smallest component
    of their sets' classes.  A null doc_id has a null component, no links, and is kept.
    """
    spark = docs.sparkSession
    rows = texts(docs)
    signed, _ = save(signatures(rows, size), "signatures")
    valid = signed.where("doc_id is not null and n_shingles > 0")
    best = F.min(F.struct(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "short"))
    classes, _ = save(valid.groupBy("set_key").agg(best.alias("c")).select("set_key", "c.*"), "classes")
    n_classes = classes.count()
    named = rows.where("doc_id is not null")
    tables, tables_path = first_rows(classes, n_classes)
    comps = components(confirmed(neighbours(tables), named, size))
    sizes = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    comps, comps_path = save(comps.join(sizes, "comp"), "first-components")
    placed = classes.join(comps, "id", "left").select("id", "n", F.coalesce("comp", "id").alias("comp"), F.coalesce("size", F.lit(1)).cast("long").alias("size"), "short")
    placed, placed_path = save(placed.sortWithinPartitions("comp", "id"), "placed-classes")
    group, group_path = groups(placed, n_classes)
    joined = components(across(group, named, size)).select(F.col("id").alias("first"), F.col("comp").alias("last"))
    same = valid.select("set_key", "doc_id").join(classes.select("set_key", "id"), "set_key").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    member = same.groupBy("b").agg(F.min("a").alias("id")).withColumnRenamed("b", "doc").join(comps.select("id", "comp"), "id", "left")
    member = member.withColumn("first", F.coalesce("comp", "id")).join(joined, "first", "left")
    comp, _ = save(member.select("doc", F.coalesce("last", "first").alias("component_id")), "components")
    drop(spark, tables_path, comps_path, placed_path, group_path)
    out = signed.join(comp, signed["doc_id"] == comp["doc"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5) -> DataFrame:
    """``docs`` without the documents whose group keeps another one; columns stay."""
    gone, _ = save(near_duplicates(docs, size).where("not kept").select(F.col("doc_id").alias("_doc")).distinct(), "near-copies")
    # Only texts that may have to go meet the list in a join.
    maybe = maybe_among(F.col("doc_id").cast("long"), id_filter(gone))
    doubtful = docs.where(maybe)
    return docs.where(~maybe).union(doubtful.join(gone, doubtful["doc_id"].cast("long") == gone["_doc"], "left_anti"))
