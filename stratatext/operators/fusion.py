"""Rank fusion, score scaling, reranking and intent ordering of hit tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import values as V


def rrf_fusion(
    vector_hits: DataFrame, keyword_hits: DataFrame, alpha: float = V.ALPHA, rrf_k: int = V.RRF_K,
    top: int = 5, by: list[str] | None = None,
) -> DataFrame:
    """Weighted reciprocal rank fusion of two ranked hit tables.

    Both sides hold (query keys, id, rank).  Equal scores: vector hits first in
    their order, then keyword hits in theirs.
    """
    by = by or ["query_id"]

    def side(hits: DataFrame, weight: float, name: str) -> DataFrame:
        return hits.select(
            *by, "id", (F.lit(weight) / (F.lit(rrf_k) + F.col("rank"))).alias("part"),
            *[(F.col("rank") if n == name else F.lit(None).cast("int")).alias(n) for n in ("vec_rank", "kw_rank")],
        )

    both = side(vector_hits, alpha, "vec_rank").unionByName(side(keyword_hits, 1 - alpha, "kw_rank"))
    fused = both.groupBy(*by, "id").agg(
        F.round(F.sum("part"), 12).alias("score"), F.max("vec_rank").alias("vec_rank"), F.max("kw_rank").alias("kw_rank")
    )
    w = Window.partitionBy(*by).orderBy(
        F.desc("score"), F.asc_nulls_last("vec_rank"), F.asc_nulls_last("kw_rank")
    )
    source = F.when(F.col("vec_rank").isNotNull(), "vector").otherwise("bm25")
    return (
        fused.withColumn("source", source)
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= top)
    )


def min_max(hits: DataFrame, score: str = "score") -> DataFrame:
    """Scores scaled to 0..1 per query; 0.5 when all are equal."""
    w = Window.partitionBy("query_id")
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return hits.withColumn(
        score, F.when(lo == hi, F.lit(0.5)).otherwise((F.col(score) - lo) / (hi - lo))
    )


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def rerank(hits: DataFrame, scores: DataFrame, top_n: int = 5, score_threshold: float = 0.0,
           raw: bool = True) -> DataFrame:
    """Re-order hits by outside relevance scores ``(query_id, id, relevance)``.

    Cross-encoder scores (``raw``) pass a sigmoid.  The ``top_n`` cut comes
    before the threshold.  Queries without any score keep their first ``top_n``
    hits unchanged.
    """
    joined = hits.join(scores, ["query_id", "id"], "left")
    value = sigmoid(F.col("relevance")) if raw else F.col("relevance")
    scored = joined.withColumn("__new", value).withColumn(
        "__any", F.count("relevance").over(Window.partitionBy("query_id")) > 0
    )
    w = Window.partitionBy("query_id").orderBy(
        F.when(F.col("__any"), F.col("__new")).desc_nulls_last(), "rank"
    )
    return (
        scored.withColumn("__rn", F.row_number().over(w))
        .filter(F.col("__rn") <= top_n)
        .filter(~F.col("__any") | (F.col("__new") >= score_threshold))
        .withColumn("score", F.when(F.col("__any"), F.col("__new")).otherwise(F.col("score")))
        .withColumn("source", F.when(F.col("__any"), F.lit("reranked")).otherwise(F.col("source")))
        .withColumn("rank", F.col("__rn"))
        .drop("__new", "__any", "__rn", "relevance")
    )


def order_by_intent(hits: DataFrame) -> DataFrame:
    """Re-rank hits ``(query_id, rank, edition_id, sort_key, intent, edition_hint, latest_first)``.

    specific_time with a hint: hits of matching editions, or all when none
    matches.  Definitions: newest first.  Evolution: oldest first.  Other
    intents: newest first when the flag is set.  Equal keys keep their rank.
    """
    per_query = Window.partitionBy("query_id")
    timed = (F.col("intent") == "specific_time") & (F.coalesce(F.col("edition_hint"), F.lit("")) != "")
    match = F.coalesce(F.contains(F.col("edition_id"), F.col("edition_hint")), F.lit(False))
    any_match = F.bool_or(match).over(per_query)
    kept = hits.withColumn("__any", any_match).filter(~timed | match | ~F.col("__any"))
    newest = (F.col("intent") == "general_definition") | (
        ~F.col("intent").isin("evolution_comparison", "specific_time") & F.col("latest_first")
    )
    plain_specific_latest = (F.col("intent") == "specific_time") & ~timed & F.col("latest_first")
    key = (
        F.when(timed, F.lit(0))
        .when(newest | plain_specific_latest, -F.col("sort_key"))
        .when(F.col("intent") == "evolution_comparison", F.col("sort_key"))
        .otherwise(0)
    )
    w = Window.partitionBy("query_id").orderBy("__key", "rank")
    return (
        kept.withColumn("__key", key)
        .withColumn("new_rank", F.row_number().over(w))
        .drop("__key", "__any", "rank")
        .withColumnRenamed("new_rank", "rank")
    )
