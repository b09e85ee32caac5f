"""Hybrid search of a table of queries: expansion, both sides, fusion, re-ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import values as V
from ..operators import bm25, fusion, lookup, vectors

MODES = ("hybrid", "vector", "bm25")


def search(
    corpus: DataFrame,
    index: bm25.KeywordIndex | None,
    queries: DataFrame,
    vector_corpus: DataFrame | None = None,
    query_vectors: DataFrame | None = None,
    top: int = 8,
    condition: Column | None = None,
    mode: str = "hybrid",
    alpha: float = V.ALPHA,
    rrf_k: int = V.RRF_K,
    score_threshold: float = V.SCORE_THRESHOLD,
    wider: int = 2,
    clusters: DataFrame | None = None,
    relevance: DataFrame | None = None,
) -> DataFrame:
    """Best ``top`` hits per query with ``query_id, rank, id, score, source``.

    ``condition`` over ``corpus`` (keyed ``id``) filters both sides before they are
    ranked.  The sides bring ``wider * top`` hits each to the fusion; one side alone
    (``mode``) brings ``top``.  ``clusters`` appends synonyms to the keyword side's
    queries; ``relevance(query_id, id, relevance)`` re-orders the fused hits, and is
    used in the hybrid mode alone.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    n = top * wider if mode == "hybrid" else top
    vec = kw = None
    if mode != "bm25":
        among = vector_corpus if condition is None else vector_corpus.join(corpus.filter(condition).select("id"), "id", "left_semi")
        vec = vectors.vector_search(among, query_vectors, n, score_threshold)
    if mode != "vector":
        asked = queries
        if clusters is not None:
            asked = lookup.expand_queries(queries, clusters).select("query_id", F.col("expanded").alias("text"))
        kw = bm25.bm25_search(index, asked, n, corpus, condition)
    if mode == "hybrid":
        found = fusion.rrf_fusion(vec, kw, alpha, rrf_k, top)
        if relevance is not None:
            found = fusion.rerank(found, relevance, top)
    else:
        found = (vec if kw is None else kw).withColumn("source", F.lit(mode))
    return found.select("query_id", "rank", "id", "score", "source")


def search_by_edition(corpus: DataFrame, index: bm25.KeywordIndex | None, queries: DataFrame, edition_id: str, *args, top: int = 10, **kwargs) -> DataFrame:
    """:func:`search` among the rows of one edition."""
    return search(corpus, index, queries, *args, top=top, condition=F.col("edition_id") == edition_id, **kwargs)
