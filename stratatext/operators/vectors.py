"""Exact cosine top-k over an embedding table, and embedding upserts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import values as V
from ..session import is_small

#: Most query vectors sent to the tasks as one broadcast block.
QUERY_BLOCK = 4_096
QUERY_BLOCK_BYTES = 256 << 20
#: Bytes of one tile of the score matrix; queries are met tile by tile.
TILE_BYTES = 32 << 20
#: Corpus rows per group when there are too many queries for one block.
CORPUS_CHUNK = 50_000


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.vstack(vectors.to_numpy()).astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """Best ``k`` entries per row number; equal scores by id."""
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    first = np.searchsorted(rows, rows, side="left")
    keep = np.arange(len(rows)) - first < k
    return rows[keep], ids[keep], scores[keep]


def _batch_best(q: np.ndarray, groups: np.ndarray | None, pdf: pd.DataFrame, k: int, threshold: float, tile_bytes: int):
    """Best ``k`` rows of a batch per query, over tiles of at most ``tile_bytes`` of scores."""
    units, ids = _unit(pdf["embedding"]).T, pdf["id"].to_numpy()
    step = max(1, tile_bytes // (8 * max(1, len(ids))))
    parts = []
    for at in range(0, len(q), step):
        s = np.round(q[at : at + step] @ units, 9)
        if groups is not None:
            mine = groups[at : at + step]
            other = np.array([g is not None for g in mine])[:, None] & (mine[:, None] != pdf["group"].to_numpy()[None, :])
            s[other] = -np.inf
        keep = s >= threshold
        if s.shape[1] > k:
            keep &= s >= np.partition(s, -k, axis=1)[:, -k][:, None]
        rows, cols = np.nonzero(keep & np.isfinite(s))
        parts.append(_best(rows + at, ids[cols], s[rows, cols], k))
    return tuple(np.concatenate(p) for p in zip(*parts))


def _search_batches(q_ids: np.ndarray, q: np.ndarray, groups, batches, k: int, threshold: float, tile_bytes: int = TILE_BYTES) -> Iterator[pd.DataFrame]:
    """Running best ``k`` per query over the batches; nothing else is kept.

    Cutting at the threshold first gives the same rows as cutting after the rank.
    """
    held = None
    for pdf in batches:
        if not len(pdf):
            continue
        found = _batch_best(q, groups, pdf, k, threshold, tile_bytes)
        held = found if held is None else _best(*(np.concatenate(p) for p in zip(held, found)), k)
    if held is not None:
        rows, ids, scores = held
        yield pd.DataFrame({"query_id": q_ids[rows], "id": ids, "score": scores})


def vector_search(
    corpus: DataFrame,
    queries: DataFrame,
    top: int = 10,
    score_threshold: float = V.SCORE_THRESHOLD,
    condition: Column | None = None,
    section: Column | None = None,
    query_block: int = QUERY_BLOCK,
    corpus_chunk: int = CORPUS_CHUNK,
    group: str | None = None,
    tile_bytes: int = TILE_BYTES,
) -> DataFrame:
    """Cosine top hits per query: (query_id, rank, id, score).

    With ``group``, a column of the corpus, a query with a ``group`` of its own meets
    the rows of that group alone, and one with a null meets all.
    ``condition`` filters the corpus before ranking.  ``section`` is a condition
    applied to the best ``3 * top`` hits.  The threshold is applied after the
    cut.  Up to ``query_block`` query vectors (counted first) go to every task
    and one pass over the corpus ships back at most ``k`` rows per query and
    partition.  More queries are met block by block: (corpus chunk, query block)
    groups of bounded size, each again returning only its best ``k``.
    """
    side = corpus.filter(condition) if condition is not None else corpus
    fetch = 3 * top if section is not None else top
    slim = side.select("id", "embedding", *([F.col(group).alias("group")] if group else []))
    asked = queries.select("query_id", "embedding", *(["group"] if group else []))
    if is_small(asked, query_block, QUERY_BLOCK_BYTES):
        found = _one_block(slim, asked, fetch, score_threshold, tile_bytes)
    else:
        found = _many_blocks(slim, asked, fetch, score_threshold, query_block, corpus_chunk, tile_bytes)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= fetch)
    if section is not None:
        ranked = ranked.join(corpus.filter(section).select("id"), "id", "left_semi")
        ranked = ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "id", "score")


def _hit_schema(corpus: DataFrame, queries: DataFrame) -> str:
    id_type = corpus.schema["id"].dataType.simpleString()
    q_type = queries.schema["query_id"].dataType.simpleString()
    return f"query_id {q_type}, id {id_type}, score double"


def _groups(asked: pd.DataFrame) -> np.ndarray | None:
    if "group" not in asked:
        return None
    return np.array([None if pd.isna(g) else g for g in asked["group"]], dtype=object)


def _one_block(corpus: DataFrame, queries: DataFrame, k: int, threshold: float, tile_bytes: int) -> DataFrame:
    schema = _hit_schema(corpus, queries)
    block = queries.orderBy("query_id").toPandas()  # at most query_block rows, checked
    if not len(block):
        return corpus.sparkSession.createDataFrame([], schema)
    q_ids, q, groups = block["query_id"].to_numpy(), _unit(block["embedding"]), _groups(block)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _search_batches(q_ids, q, groups, batches, k, threshold, tile_bytes)

    return corpus.mapInPandas(run, schema)


def _many_blocks(
    corpus: DataFrame, queries: DataFrame, k: int, threshold: float, query_block: int, corpus_chunk: int, tile_bytes: int
) -> DataFrame:
    blocks = -(-queries.count() // query_block)
    chunks = max(1, -(-corpus.count() // corpus_chunk))
    chunk = F.pmod(F.xxhash64("id"), F.lit(chunks)).alias("chunk")
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")
    left = corpus.select("*", chunk, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = queries.select("*", block, F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    left = left.withColumn("block", F.col("block").cast("long"))
    right = right.withColumn("chunk", F.col("chunk").cast("long"))

    def meet(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        q_ids, q = asked["query_id"].to_numpy(), _unit(asked["embedding"])
        return next(_search_batches(q_ids, q, _groups(asked), [rows], k, threshold, tile_bytes))

    return (
        left.groupBy("chunk", "block")
        .cogroup(right.groupBy("chunk", "block"))
        .applyInPandas(meet, _hit_schema(corpus, queries))
    )


def upsert(current: DataFrame, incoming: DataFrame, key: str = "id", version: str | None = None) -> DataFrame:
    """Rows of both sides, the incoming row winning per key.

    Several incoming rows per key: the highest ``version`` wins (the given
    column, required when keys repeat).
    """
    order = F.col(version) if version else F.lit(0)
    tagged = current.withColumn("__side", F.lit(0)).unionByName(incoming.withColumn("__side", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc("__side"), order.desc())
    return tagged.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn", "__side")
