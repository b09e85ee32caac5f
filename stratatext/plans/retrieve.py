"""End-to-end retrieval plans: batch of queries in, ordered hit table out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import values as V
from ..functions import classify as CL
from ..functions import editions as E
from ..operators import bm25 as B
from ..operators import fusion as FU
from ..operators import policy as P
from ..operators import vectors as VS
from ..session import broadcast_if_small, stored


def normalise_hits(hits: DataFrame, quotes: DataFrame) -> DataFrame:
    """Hits with the quote's attributes in the standard shape.

    The year is the leading four digits of the edition id, else 0; a missing
    type counts as narrative.
    """
    attrs = quotes.select(
        "quote_id", "edition_id", "type", "section_path", "char_start", "char_end", "sha256", "text", "quality_flags"
    )
    # The few quotes that were hit, not all texts, meet the hits.
    attrs = attrs.join(broadcast_if_small(hits.select("quote_id").distinct()), "quote_id", "left_semi")
    year = F.regexp_extract("edition_id", r"^(\d{4})", 1)
    return hits.join(attrs, "quote_id", "left").select(
        "query_id",
        "rank",
        "quote_id",
        "edition_id",
        F.coalesce(F.when(year != "", year.cast("int")), F.lit(0)).alias("year"),
        F.coalesce("type", F.lit("narrative")).alias("type"),
        F.coalesce("section_path", F.array().cast("array<string>")).alias("chapter_path"),
        "score",
        F.coalesce("char_start", F.lit(0)).alias("char_start"),
        F.coalesce("char_end", F.lit(0)).alias("char_end"),
        F.coalesce("sha256", F.lit("")).alias("sha256"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("quality_flags", F.array().cast("array<string>")).alias("quality_flags"),
    )


def safe_hits(hits: DataFrame, preview_chars: int | None = None) -> DataFrame:
    """Hits without their text: length, 4-digit score and, on request, a short preview."""
    out = hits.withColumn("text_length", F.length("text")).withColumn("raw_score", F.col("score")).withColumn(
        "score", F.round("score", 4)
    )
    if preview_chars:
        cut = F.concat(F.substring("text", 1, preview_chars), F.lit("..."))
        out = out.withColumn("text_preview", F.when(F.length("text") > preview_chars, cut).otherwise(F.col("text")))
    return out.drop("text")


def retrieve(
    queries: DataFrame,
    corpus: DataFrame,
    index,
    top: int = 8,
    vector_corpus: DataFrame | None = None,
    query_vectors: DataFrame | None = None,
    editions: list = V.EDITIONS,
    policy: dict = V.POLICY,
    alpha: float = V.ALPHA,
    rrf_k: int = V.RRF_K,
    score_threshold: float = V.SCORE_THRESHOLD,
    required: DataFrame | None = None,
) -> DataFrame:
    """Whole retrieval for a table of queries.

    ``queries(query_id, text, intent, edition_hint)`` pass the policy layer, are
    searched per fallback stage (keyword side, and vector side when vectors are
    given), fused by reciprocal rank, cut to the first adequate stage, repaired
    so that compared editions are covered, and ordered by intent.  ``corpus`` is
    ``(id, ord, edition_id, ...)``; an index that carries ``edition_id`` saves a join.  ``required(query_id, edition_id, ord)``
    defaults to the editions named in the text of evolution queries.
    """
    side_k = max(2 * top, 10)
    base = queries
    if "edition_hint" not in base.columns:
        base = base.withColumn("edition_hint", F.lit(None).cast("string"))
    asked = stored(CL.resolve_edition_hint(CL.apply_policy(base, policy), editions), "queries")
    stages = P.stages_of(asked)
    edition_of = corpus.select("id", "edition_id")
    if required is None:
        required = (
            asked.filter(F.col("intent") == "evolution_comparison")
            .select("query_id", F.posexplode(E.hints_in(F.col("text"), editions)).alias("ord", "edition_id"))
        )
    # Compared editions are searched as extra stages (numbers from -1 down).
    wanted = required.select(
        "query_id", (-1 - F.col("ord")).alias("stage"), "edition_id"
    )
    searched = stages.select("query_id", "stage", "edition_id").unionByName(wanted)

    # A stage asks for one edition or for all, so the best of each edition hold all hits.
    if "edition_id" in index.keys:
        scored = B.scores(index, asked.select("query_id", "text"), top=side_k, per="edition_id")
    else:
        scored = B.scores(index, asked.select("query_id", "text")).join(edition_of, "id")
    by_stage = Window.partitionBy("query_id", "stage")
    keyword = (
        P.candidates_by_stage(scored, searched)
        .withColumn("rank", F.row_number().over(by_stage.orderBy(F.desc("score"), "ord")))
        .filter(F.col("rank") <= side_k)
        .select("query_id", "stage", "id", "rank")
    )
    if vector_corpus is not None:
        vector = _vector_by_stage(vector_corpus, query_vectors, searched, side_k, score_threshold)
    else:
        vector = keyword.limit(0)
    fused = stored(
        FU.rrf_fusion(vector, keyword, alpha, rrf_k, top, by=["query_id", "stage"]).join(edition_of, "id"), "fused"
    )
    hits = P.choose_stage(fused.filter("stage >= 0"), stages)
    best = fused.filter((F.col("stage") < 0) & (F.col("rank") == 1)).select("query_id", "id", "edition_id")
    covered = P.ensure_coverage(hits, best, required, top)
    scores = fused.groupBy("query_id", "id").agg(
        F.max(F.when(F.col("stage") >= 0, F.col("score"))).alias("s1"), F.max("score").alias("s2"), F.max("source").alias("source")
    )
    shaped = (
        covered.join(scores, ["query_id", "id"])
        .withColumn("score", F.coalesce("s1", "s2"))
        .drop("s1", "s2")
        .join(asked.select("query_id", "intent", "edition_hint", "latest_first"), "query_id")
        .withColumn("sort_key", E.sort_key(F.col("edition_id"), editions))
    )
    return FU.order_by_intent(shaped).select("query_id", "rank", "id", "edition_id", "score", "source", "intent")


def _vector_by_stage(corpus: DataFrame, query_vectors: DataFrame, searched: DataFrame, k: int, threshold: float) -> DataFrame:
    """Vector hits per (query, stage) in one pass over the corpus.

    A stage with an edition ranks that edition's rows alone, whether or not it is in
    the edition list; a stage without one ranks all rows.
    """
    key = F.to_json(F.struct("query_id", "stage"))
    asked = searched.withColumn("ask", key).join(query_vectors, "query_id")
    vectors = asked.select(F.col("ask").alias("query_id"), "embedding", F.col("edition_id").alias("group"))
    found = VS.vector_search(corpus, vectors, k, threshold, group="edition_id").withColumnRenamed("query_id", "ask")
    return found.join(asked.select("ask", "query_id", "stage"), "ask").select("query_id", "stage", "id", "rank")
