"""Edition policies over scored candidates: fallback cascade and coverage repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small


def stages_of(queries: DataFrame) -> DataFrame:
    """(query_id, stage, edition_id, last, min_hits): primary, fallbacks, then everything.

    Queries without fallbacks or with ``min_hits`` 0 have one unconditional stage.
    """
    cascade = (F.size("fallback_editions") > 0) & (F.col("min_hits") > 0)
    all_editions = F.array(F.lit(None).cast("string"))
    chain = F.when(
        cascade, F.concat(F.array("edition_filter"), F.col("fallback_editions"), all_editions)
    ).otherwise(F.array("edition_filter"))
    return queries.select(
        "query_id", "min_hits", F.size(chain).alias("n"), F.posexplode(chain).alias("stage", "edition_id")
    ).select("query_id", "stage", "edition_id", (F.col("stage") == F.col("n") - 1).alias("last"), "min_hits")


def candidates_by_stage(scored: DataFrame, stages: DataFrame) -> DataFrame:
    """Scored rows ``(query_id, id, edition_id, ...)`` repeated for every stage that admits them.

    One pass over the scores: stages meet them on the query, and a stage bound to
    an edition admits only that edition.
    """
    few = broadcast_if_small(stages.select("query_id", "stage", F.col("edition_id").alias("__only")))
    admitted = F.col("__only").isNull() | (F.col("__only") == F.col("edition_id"))
    return scored.join(few, "query_id").filter(admitted).drop("__only")


def choose_stage(stage_hits: DataFrame, stages: DataFrame) -> DataFrame:
    """Keep, per query, the hits of the first stage with enough of them.

    The last stage needs no minimum.
    """
    counts = stage_hits.groupBy("query_id", "stage").agg(F.count(F.lit(1)).alias("n"))
    chosen = (
        counts.join(stages, ["query_id", "stage"])
        .filter(F.col("last") | (F.col("n") >= F.col("min_hits")))
        .groupBy("query_id")
        .agg(F.min("stage").alias("stage"))
    )
    return stage_hits.join(chosen, ["query_id", "stage"])


def fallback_search(scored: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """Best ``top`` of the first adequate stage per query, with ``rank`` and ``stage``."""
    stages = stages_of(queries)
    w = Window.partitionBy("query_id", "stage").orderBy(F.desc("score"), "ord")
    ranked = (
        candidates_by_stage(scored, stages)
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= top)
    )
    return choose_stage(ranked, stages)


def repair_order(hits: list[tuple[str, str]], extra: list[tuple[str, str]], limit: int) -> list[str]:
    """Ids of ``hits`` with room made for ``extra`` (both lists of (id, edition)).

    The rule of :func:`ensure_coverage` for one query's lists, step by step.
    Room comes from the edition with most hits (the one seen first on ties): its
    last hit goes.  When every edition has one hit left, the last hit goes.
    """
    kept = list(hits)
    added = [e for e in extra if e[0] not in {h[0] for h in kept}]
    seen = list(dict.fromkeys(edition for _, edition in kept))
    while added and kept and len(kept) + len(added) > limit:
        load = {e: sum(edition == e for _, edition in kept) for e in seen}
        heaviest = max(seen, key=lambda e: load[e])
        if load[heaviest] > 1:
            at = max(i for i, (_, edition) in enumerate(kept) if edition == heaviest)
        else:
            at = len(kept) - 1
        del kept[at]
    return [i for i, _ in kept + added][:limit]


def ensure_coverage(hits: DataFrame, best_by_edition: DataFrame, required: DataFrame, top: int) -> DataFrame:
    """Guarantee every required edition a place among a query's hits.

    ``hits(query_id, rank, id, edition_id)`` holds at most ``top`` rows per
    query, ``best_by_edition(query_id, id, edition_id)`` the best hit of each
    edition, ``required(query_id, edition_id, ord)`` the editions wanted.
    Queries with fewer than two required editions stay as they are.  The order in
    which :func:`repair_order` takes hits away is a rank, so no group is handled row by
    row; each is at most ``top`` hits plus one row per required edition.
    """
    several = required.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("query_id")
    missing = (
        required.join(several, "query_id", "left_semi")
        .join(hits.select("query_id", "edition_id").distinct(), ["query_id", "edition_id"], "left_anti")
        .join(best_by_edition, ["query_id", "edition_id"])
        .join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti")
        .select("query_id", "id", "edition_id", F.col("ord").alias("rank"), F.lit(1).alias("kind"))
    )
    both = hits.select("query_id", "id", "edition_id", "rank", F.lit(0).alias("kind")).unionByName(missing)
    # A hit's turn to go: those behind others of their edition, furthest behind first
    # (ties: the edition seen first); then what is left of each edition, from the end.
    query = Window.partitionBy("query_id")
    edition = Window.partitionBy("query_id", "kind", "edition_id")
    behind = F.col("depth") > 1
    turn = Window.partitionBy("query_id", "kind").orderBy(F.desc(behind), F.desc("depth"), F.when(behind, F.col("first")).otherwise(-F.col("rank")))
    marked = (
        both.withColumn("depth", F.row_number().over(edition.orderBy("rank")))
        .withColumn("first", F.min("rank").over(edition))
        .withColumn("turn", F.row_number().over(turn))
        .withColumn("surplus", F.count(F.lit(1)).over(query) - top)
        .withColumn("added", F.sum("kind").over(query))
    )
    kept = marked.filter((F.col("added") == 0) | (F.col("kind") == 1) | (F.col("turn") > F.col("surplus")))
    place = F.row_number().over(query.orderBy("kind", "rank"))
    return (
        kept.withColumn("place", F.when(F.col("added") == 0, F.col("rank")).otherwise(place).cast("int"))
        .filter((F.col("added") == 0) | (F.col("place") <= top))
        .select("query_id", "id", "edition_id", F.col("place").alias("rank"))
    )
