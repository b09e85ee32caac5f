"""Spelling variants: words one edit apart, by dynamic programming over sorted lists.

Words are counted over all texts first; only the vocabulary goes on.  Two words one edit
apart agree on everything before their first difference and on everything after the
edit, so they meet in a block of words with equal beginnings or equal ends: a block is
named by the length m of the shorter word, a window of places for the first difference,
and the letters outside it.  A word enters the blocks of m = its length and m = one
less, twice each (difference in the first half, or behind it), and each pair meets in
exactly one block.  A block with too many words is split the same way, window by
half window, down to a single place.

In a block the words are a sorted list.  Each word is matched against the whole list by
the edit matrix, of which only the diagonal and its two neighbours matter for one edit.
A run of the list with a common beginning is one node that carries one matrix row: rows
are extended letter by letter where the common beginning of neighbours grows, and a run
whose row is above one edit everywhere is skipped with all its words.  All words of many
blocks go through together, one letter at a time.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratatext.llm.common import arrow_rows, drop, save, small, texts

#: Letters of a run: A-Z, a-z and Latin-1 from U+00C0 on (fixed by the contract).
RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: One run in this many (by hash) loses a letter; 0 leaves all as they are.
DAMAGE = 97
MIN_LENGTH, MIN_COUNT = 5, 3
#: A form is at least so many times as frequent as its variant.
FACTOR = 2
#: Words of a block beyond which it is split.
BLOCK_WORDS = 1000
#: Matrix rows held at once, and letters of a batch of lists.
NODES, CELLS = 1 << 20, 1 << 23
#: Distinct words that a task counts before it hands them on.
COUNTED = 400_000


def run_counts(text: str) -> Counter:
    """Runs of one text, A-Z lower-cased, with their counts; a long text is walked, not listed."""
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    return Counter(RUN.findall(lowered) if len(lowered) < 1 << 22 else (m.group() for m in RUN.finditer(lowered)))


def vocabulary(docs: DataFrame, damage: int = DAMAGE, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): words of at least ``min_length`` letters met at least ``min_count`` times."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            words = [w for w in held if len(w) >= min_length]
            for k in range(0, len(words), 50_000):
                yield arrow_rows(schema, [(w, held[w]) for w in words[k : k + 50_000]])

        for batch in small(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                salt = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in run_counts(text).items():
                    if damage:
                        h = zlib.crc32(word.encode(), salt)
                        if h % damage == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                    held[word] += n
            if len(held) > COUNTED:
                yield from out()
                held.clear()
        yield from out()

    counts = texts(docs).mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# -- blocks -------------------------------------------------------------------------


def _named(words: DataFrame) -> DataFrame:
    """Name each row's block by the letters outside its window (a, b) of differences."""
    outside = F.concat(F.substring("word", F.lit(1), F.col("a")), F.lit("|"), F.substring("word", F.length("word") - (F.col("m") - F.col("b")) + 1, F.col("m") - F.col("b")))
    return words.withColumn("outside", outside)


def _halves(words: DataFrame) -> DataFrame:
    """Two rows per row: the window's first and second half."""
    mid = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    halves = F.array(F.struct(F.col("a").alias("a"), mid.alias("b")), F.struct(mid.alias("a"), F.col("b").alias("b")))
    return words.select("word", "n", "m", F.explode(halves).alias("w")).select("word", "n", "m", "w.a", "w.b")


def blocks(words: DataFrame, least: int, limit: int = BLOCK_WORDS) -> tuple[DataFrame, list[str]]:
    """(word, n, m, a, b, outside) with blocks of at most ``limit`` words where windows can be halved."""
    size = F.length("word")
    classes = F.filter(F.array(size, size - 1), lambda m: m >= least)
    start = words.select("word", "n", F.explode(classes).alias("m")).withColumn("a", F.lit(0)).withColumn("b", F.col("m"))
    name = ["m", "a", "b", "outside"]
    now, paths, done = _named(_halves(start)), [], None
    while True:
        now, path = save(now, "spelling-blocks")
        paths.append(path)
        # A window of one place has a few letters' choice of words: there is nothing to halve.
        hot = now.groupBy(*name).agg(F.count(F.lit(1)).alias("size")).where((F.col("size") > limit) & (F.col("b") - F.col("a") > 1)).select(*name)
        hot, path = save(hot, "spelling-hot")
        paths.append(path)
        fine = now.join(hot, name, "left_anti")
        done = fine if done is None else done.unionByName(fine)
        if hot.isEmpty():
            return done, paths
        now = _named(_halves(now.join(hot, name, "left_semi").select("word", "n", "m", "a", "b")))


# -- matching -------------------------------------------------------------------------


def near_in_lists(letters: np.ndarray, length: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, found) of words one edit apart in the same block.

    ``letters`` holds one word a row, zeros behind its end; rows are sorted by block, then
    by letters, and differ within a block.  Each pair is found from both its words.
    """
    n, width = letters.shape
    fresh = np.ones(n, bool)
    fresh[1:] = block[1:] != block[:-1]
    differ = letters[1:] != letters[:-1]
    common = np.where(fresh[1:], -1, np.where(differ.any(axis=1), differ.argmax(axis=1), width)) if n > 1 else np.empty(0, int)
    common = np.concatenate([[-1], common])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], n)
    own = np.cumsum(fresh) - 1
    padded = np.zeros((n, width + 4), np.uint8)
    padded[:, 2 : width + 2] = letters  # letter j at column j + 2; before the start is a zero
    padded[:, width + 2 :] = 1  # beyond the last column nothing matches
    found: list[tuple[np.ndarray, np.ndarray]] = []
    pieces = max(1, NODES // 64)
    for at in range(0, n, pieces):
        query = np.arange(at, min(n, at + pieces))
        # A node: a query, a run of its block's list [lo, hi), and the matrix row for the
        # run's common letters: cells one before the diagonal, on it, and one behind.
        lo, hi = first[own[query]], last[own[query]]
        before, on, behind = np.full(len(query), 2, np.int8), np.zeros(len(query), np.int8), np.ones(len(query), np.int8)
        for depth in range(width + 1):
            if not len(query):
                break
            # Words that end here stand first in their run.
            ends = length[lo] == depth
            gap = length[query] - depth
            cell = np.where(gap == 0, on, np.where(gap == 1, behind, np.where(gap == -1, before, 2)))
            hit = ends & (cell == 1)
            if hit.any():
                found.append((query[hit], lo[hit]))
            if depth == width:
                break
            # Runs of one more common letter: they start where neighbours share no more than ``depth``.
            starts = np.flatnonzero(common <= depth)
            stops = np.append(starts[1:], n)
            k, to = np.searchsorted(starts, lo), np.searchsorted(starts, hi)
            k = k + ends  # the word that ended is no part of a longer run
            times = to - k
            row = np.repeat(np.arange(len(query)), times)
            run = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(k, times)
            query, before, on, behind = query[row], before[row], on[row], behind[row]
            lo, hi = starts[run], stops[run]
            c = letters[lo, depth]
            mine = padded[query, depth + 1], padded[query, depth + 2], padded[query, depth + 3]
            new_before = np.minimum(before + (c != mine[0]), on + 1)
            new_on = np.minimum(np.minimum(on + (c != mine[1]), behind + 1), new_before + 1)
            new_behind = np.minimum(behind + (c != mine[2]), new_on + 1)
            alive = (new_before <= 1) | (new_on <= 1) | (new_behind <= 1)
            query, lo, hi = query[alive], lo[alive], hi[alive]
            before, on, behind = np.minimum(new_before[alive], 2), np.minimum(new_on[alive], 2), np.minimum(new_behind[alive], 2)
    if not found:
        return np.empty(0, int), np.empty(0, int)
    return np.concatenate([q for q, _ in found]), np.concatenate([f for _, f in found])


def _matched(words: list[str], n: np.ndarray, m: int, a: np.ndarray, b: np.ndarray, block: np.ndarray) -> Iterator[tuple]:
    """(word, n, near words, largest n among them, first word of that n) for lists of one class."""
    raw = [w.encode("latin-1") for w in words]
    width = max(map(len, raw))
    letters = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in raw), np.uint8).reshape(len(raw), width)
    length = np.fromiter(map(len, raw), np.int64, len(raw))
    query, found = near_in_lists(letters, length, block)
    keep = np.minimum(length[query], length[found]) == m
    query, found = query[keep], found[keep]
    differ = letters[query] != letters[found]
    at = differ.argmax(axis=1) if len(query) else np.empty(0, int)
    # The pair belongs to the window that holds its first difference (the last window also its end).
    keep = (at >= a[query]) & ((at < b[query]) | (b[query] == m))
    query, found = query[keep], found[keep]
    # Rows are sorted by letters within a block, so a smaller index is a smaller word.
    order = np.lexsort((found, -n[found], query))
    query, found = query[order], found[order]
    lead = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.empty(0, int)
    times = np.diff(np.append(lead, len(query)))
    for q, f, k in zip(query[lead].tolist(), found[lead].tolist(), times.tolist(), strict=True):
        yield words[q], int(n[q]), k, int(n[f]), words[f]


def near_words(words: DataFrame, least: int = MIN_LENGTH, limit: int = BLOCK_WORDS) -> tuple[DataFrame, list[str]]:
    """(word, n_near, best_n, best): near words of each word that has any, and paths to drop."""
    rows, paths = blocks(words, least, limit)
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
    name = ["m", "a", "b", "outside"]
    dealt = rows.repartition(*name).sortWithinPartitions(*name, "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(rows_: list[tuple]) -> Iterator[pa.RecordBatch]:
            """Lists of one class; a block of one word has no pair."""
            keys = Counter(r[2:] for r in rows_)
            rows_ = [r for r in rows_ if keys[r[2:]] > 1]
            if rows_:
                number = {k: i for i, k in enumerate(dict.fromkeys(r[2:] for r in rows_))}
                column = lambda k: np.array([r[k] for r in rows_], np.int64)
                block = np.array([number[r[2:]] for r in rows_])
                got = list(_matched([r[0] for r in rows_], column(1), rows_[0][2], column(3), column(4), block))
                if got:
                    yield arrow_rows(schema, got)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("word", "n", *name)), strict=True):
                # Between blocks: hand on at a change of class or when the lists are large.
                if held and row[2:] != held[-1][2:] and (row[2] != held[-1][2] or len(held) * (row[2] + 1) > CELLS or len(held) > 60_000):
                    yield from out(held)
                    held = []
                held.append(row)
        yield from out(held)

    parts = dealt.mapInArrow(run, "word string, n long, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w"))).alias("lead")
    found = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return found.select("word", "n_near", (-F.col("lead.n")).alias("best_n"), F.col("lead.w").alias("best")), paths


def spelling_groups(
    docs: DataFrame, damage: int = DAMAGE, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, factor: int = FACTOR, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the vocabulary.

    Null and empty texts have no words; a null doc_id counts as an empty one in the hash;
    repeated rows count each; ties of a form go to the smallest word; no documents give
    no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    words, words_path = save(vocabulary(docs, damage, min_length, min_count), "vocabulary")
    near, paths = near_words(words, min_length, block_words)
    good = F.col("best_n") >= F.col("n") * factor
    joined = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n"),
    )
    table, table_path = save(joined, "forms")
    # Roots: each round, what a word points to is replaced by what that points to.  Counts
    # grow by ``factor`` with each step, so chains are short and rounds fewer still.
    at, at_path = save(table.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    used = [words_path, *paths]
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved, path = save(at.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        used.append(at_path)
        at, at_path = moved.select("word", "root"), path
        if moved.where("moved").isEmpty():
            break
    drop(spark, *used)
    return table.join(at, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
