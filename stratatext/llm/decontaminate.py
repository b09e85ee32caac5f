"""Benchmark items in training documents, found by spaced seeds.

A mask selects the token places of a seed.  Within a share of edits (tokens changed,
put in or left out), some run of an item is left whole; how long it is at least depends
on the item's length alone, and gives the item's mask.  Documents' seeds pass a filter
of the items' seeds, meet them in a join, and give diagonals (item, place in the
document); around them, item and document are compared by edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratatext.llm.common import mix, save, small, texts
from stratatext.llm.seen import filter_bits, maybe_repeated, twice_seen

SHARE = 0.8
#: Equal tokens in a row that count whatever their share of the item.
RUN = 25
#: ASCII marks that a token loses at both ends.
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def tokens(text: str) -> list[bytes]:
    """Words with A-Z lower-cased and ASCII marks stripped at both ends; bare marks vanish."""
    return [t for w in text.encode().lower().split() if (t := w.strip(MARKS))]


def all_token_hashes(texts_: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the :func:`tokens` of all texts end to end, number of tokens of each text).

    Arrow cuts and numbers the words; marks are stripped and hashes taken once a distinct word.
    """
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts_))
    coded = words.flatten().dictionary_encode()
    distinct = pc.utf8_trim(coded.dictionary, characters=MARKS.decode()).to_numpy(zero_copy_only=False)
    hashes = pd.util.hash_array(distinct, categorize=False)
    is_token = distinct != ""
    word = coded.indices.to_numpy()
    kept = is_token[word]
    text = np.repeat(np.arange(len(texts_)), pc.list_value_length(words).to_numpy())
    return hashes[word[kept]], np.bincount(text[kept], minlength=len(texts_))


def token_hashes(text: str) -> np.ndarray:
    return all_token_hashes(pa.array([text]))[0]


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The seed at each place where the mask fits."""
    n = len(hashes) - len(mask) + 1
    out = np.full(max(0, n), len(mask), np.uint64)
    if n > 0:
        for i, on in enumerate(mask):
            if on == "1":
                out = mix(out + np.uint64(i + 1)) ^ hashes[i : i + n]
    return mix(out + np.uint64(mask.count("1") << 8 | len(mask)))


def edits(n: int, share: float) -> int:
    """Edits that an item of ``n`` tokens may have."""
    return next(e for e in range(n, -1, -1) if n - e >= share * n)


def whole_run(n: int, share: float) -> int:
    """Tokens in a row that any such edits leave somewhere, or that a run has."""
    e = edits(n, share)
    return min(RUN, -(-(n - e) // (e + 1)))


def seed_rows(rows: DataFrame, key: str, masks: tuple[str, ...], seen=None, share: float = SHARE) -> DataFrame:
    """(seed, key, at) of each text of (key, text); with a filter, only what it holds,
    without, only for the mask of the text's length."""
    schema = pa.schema([("seed", pa.int64()), (key, pa.int64()), ("at", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            # The texts are laid end to end, so that each mask is one pass over all of them.
            keys = np.asarray(batch.column(0), np.int64)
            whole, size = all_token_hashes(batch.column(1))
            end = np.cumsum(size)
            own = np.array([whole_run(n, share) if n else 0 for n in size.tolist()]) if not seen else None
            found: list[tuple] = []
            for mask in masks:
                s = seeds(whole, mask)
                at = np.flatnonzero(maybe_repeated(seen.value, s)) if seen else np.arange(len(s))
                text = np.searchsorted(end, at, side="right")
                ok = at + len(mask) <= end[text]  # none over a seam
                if not seen:
                    ok &= own[text] == len(mask)
                at, text = at[ok], text[ok]
                found.append((s[at].view(np.int64), keys[text], (at - end[text] + size[text]).astype(np.int32)))
            columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, f"seed long, {key} long, at int")


def nearest(item: list[int], part: list[int]) -> tuple[int, int]:
    """(edits, end) of the stretch of ``part`` nearest to ``item``, the first one of
    equals: the rows of the distance table as bits of whole numbers."""
    n = len(item)
    full, top = (1 << n) - 1, 1 << (n - 1)
    where: dict[int, int] = {}
    for i, t in enumerate(item):
        where[t] = where.get(t, 0) | 1 << i
    up, down, score, best = full, 0, n, (n, 0)
    for j, t in enumerate(part):
        eq = where.get(t, 0)
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        more, less = down | (full & ~(h | up)), up & h
        score += bool(more & top) - bool(less & top)
        more, less = (more << 1) & full, (less << 1) & full
        up, down = less | (full & ~(v | more)), more & v
        if score < best[0]:
            best = score, j + 1
    return best


def aligned(item: list[int], part: list[int]) -> tuple[int, int]:
    """(equal tokens, start) of the nearest stretch that ends where ``part`` ends."""
    # Each cell: (edits, -equal tokens, -start).
    row = [(0, 0, -j) for j in range(len(part) + 1)]
    for t in item:
        left = row[0][0] + 1, 0, 0
        new = [left]
        for j, u in enumerate(part):
            d, up = row[j], row[j + 1]
            same = (d[0], d[1] - 1, d[2]) if t == u else (d[0] + 1, d[1], d[2])
            left = min(same, (up[0] + 1, up[1], up[2]), (left[0] + 1, left[1], left[2]))
            new.append(left)
        row = new
    return -row[-1][1], -row[-1][2]


def overlap(hashes: np.ndarray, item: np.ndarray, at: list[int], share: float) -> tuple[int, int] | None:
    """(equal tokens, first document token) of the item's best overlap near diagonals ``at``."""
    n, e = len(item), edits(len(item), share)
    spans: list[list[int]] = []
    for d in sorted(at):
        a, b = max(0, d - e), min(len(hashes), d + n + e)
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    mine, best = item.tolist(), (e + 1, 0)
    for a, b in spans:
        k, end = nearest(mine, hashes[a:b].tolist())
        best = min(best, (k, a + end))
    if best[0] <= e:
        a = max(0, best[1] - n - e)
        equal, start = aligned(mine, hashes[a : best[1]].tolist())
        return equal, a + start
    longest = (0, 0)
    for d in at:
        a, b = max(0, d), min(len(hashes), d + n)
        if b - a >= RUN:
            same = np.concatenate([[False], hashes[a:b] == item[a - d : b - d], [False]])
            turns = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
            longest = max([longest, *((int(y - x), -int(a + x)) for x, y in turns)])
    return (longest[0], -longest[1]) if longest[0] >= RUN else None


def overlaps(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """``doc_id, item_id, n_tokens, n_equal, at``: items that a document contains.

    An item counts where a stretch of the document differs from it in so few tokens
    changed, put in or left out that at least ``share`` of the item is left in order, or
    where :data:`RUN` of its tokens stand there in a row.  The best stretch is given: its
    first token is ``at``, and ``n_equal`` of the item's tokens are in it.  Items without tokens
    and null ids or texts match nothing; repeated rows count once; other columns are
    ignored.
    """
    spark = docs.sparkSession
    rows = texts(docs).where("doc_id is not null")
    tests, _ = save(texts(items, "item_id").where("item_id is not null").distinct(), "items")
    masks = item_masks(tests, share)
    own, _ = save(seed_rows(tests, "item_id", masks, share=share).withColumnRenamed("at", "item_at"), "item-seeds")
    seen = twice_seen(own.select("seed"), lambda b: np.asarray(b.column(0), np.int64).view(np.uint64), filter_bits(own.count()), times=1)
    hits = seed_rows(rows, "doc_id", masks, seen)
    met = hits.join(own, "seed").selectExpr("doc_id", "item_id", "at - item_at as at").distinct()
    met, _ = save(met, "diagonals")
    seen.destroy()
    pairs = met.groupBy("doc_id", "item_id").agg(F.collect_set("at").alias("at"))
    by_doc = pairs.join(tests.select("item_id", F.col("text").alias("item")), "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "at", "item")).alias("met"))
    held = rows.join(met.select("doc_id").distinct(), "doc_id", "left_semi")
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_tokens", pa.int64()), ("n_equal", pa.int64()), ("at", pa.int64())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[tuple[int, int], tuple] = {}
            items_: dict[str, np.ndarray] = {}  # each item of the batch is cut once
            for doc, text, met_ in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                hashes = token_hashes(text.as_py())
                for m in met_.as_py():
                    if m["item"] not in items_:
                        items_[m["item"]] = token_hashes(m["item"])
                    item = items_[m["item"]]
                    got = overlap(hashes, item, m["at"], share) if len(item) else None
                    if got:
                        key = doc, m["item_id"]
                        out[key] = max(out.get(key, (0, 0, 0)), (got[0], -got[1], len(item)))
            rows_ = [(d, i, size, n, -at) for (d, i), (n, at, size) in out.items()]
            columns = list(zip(*rows_, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], schema=schema)

    found = held.join(by_doc, "doc_id").select("doc_id", "text", "met").mapInArrow(verify, "doc_id long, item_id long, n_tokens long, n_equal long, at long")
    best = F.max(F.struct("n_equal", (-F.col("at")).alias("back"), "n_tokens")).alias("b")  # rows that repeat a doc_id
    return found.groupBy("doc_id", "item_id").agg(best).selectExpr("doc_id", "item_id", "b.n_tokens as n_tokens", "b.n_equal as n_equal", "-b.back as at")


def item_masks(tests: DataFrame, share: float) -> tuple[str, ...]:
    """The masks of the items' lengths; places are never ignored, since edits spread
    evenly leave no seed of a longer span whole."""
    schema = pa.schema([("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = {whole_run(n, share) for t in batch.column(1) if (n := len(tokens(t.as_py())))}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(sizes), pa.int32())], schema=schema)

    return tuple("1" * r["n"] for r in tests.mapInArrow(run, "n int").distinct().orderBy("n").collect())


def without_leaks(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """``docs`` without the documents that contain a benchmark item; columns stay."""
    leaks, _ = save(overlaps(docs, items, share).select(F.col("doc_id").alias("_doc")).distinct(), "leaks")
    return docs.join(leaks, docs["doc_id"].cast("long") == leaks["_doc"], "left_anti")
