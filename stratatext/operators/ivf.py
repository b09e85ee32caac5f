"""Vector search over inverted lists: centroids, cells, and a bound that skips cells.

Centroids are learned on a bounded sample (``fit_rows``, the smallest by a hash of the
id); every vector of the corpus is then put into the cell of its nearest centroid, and
the stored table is sorted by cell, so a search reads the row groups of its cells.  For
each cell the widest angle between a member and the centroid is kept.

A search meets each query with the ``probes`` nearest cells.  That is the approximate
mode.  The exact mode goes on: no member of a cell can be nearer to the query than the
angle to its centroid less the cell's widest angle, so only cells whose bound reaches
the query's k-th score so far are met as well.  A cell with many members is split into
parts, so one crowded cell is many bounded groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import values as V
from ..session import stored
from .vectors import CORPUS_CHUNK, QUERY_BLOCK, _search_batches, _unit

#: Sample for the centroids, their number per square root of the corpus, and rounds of refining.
FIT_ROWS, CELLS_PER_ROOT, ROUNDS, MOST_CELLS = 20_000, 1.0, 8, 4096
#: Slack of the cell bounds, above the rounding of scores to 9 digits.
SLACK = 1e-8


@dataclass(frozen=True)
class CellIndex:
    """vectors(cell, part, id, embedding), cells(cell, n, parts, widest); centroids are unit rows."""

    vectors: DataFrame
    cells: DataFrame
    centroids: np.ndarray


def learn_centroids(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from evenly spaced rows of the sample."""
    unit = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300)
    centres = unit[np.linspace(0, len(unit) - 1, min(cells, len(unit))).astype(int)].copy()
    for _ in range(rounds):
        mine = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, mine, unit)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-300), centres)
    return centres


def write_cells(corpus: DataFrame, folder: str, cells: int | None = None, fit_rows: int = FIT_ROWS, chunk: int = CORPUS_CHUNK) -> None:
    """Index ``(id, embedding)`` into ``folder``; null vectors stay out."""
    rows = corpus.select("id", "embedding").where("embedding is not null")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(fit_rows).select("embedding").toPandas()  # at most fit_rows
    spark = corpus.sparkSession
    wanted = cells or int(min(MOST_CELLS, max(1, CELLS_PER_ROOT * rows.count() ** 0.5)))
    centres = learn_centroids(np.vstack(sample["embedding"].to_numpy()).astype(np.float64), wanted) if len(sample) else np.zeros((0, 1))
    id_type = corpus.schema["id"].dataType.simpleString()
    vector_type = corpus.schema["embedding"].dataType.simpleString()

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                cos = _unit(pdf["embedding"]) @ centres.T
                cell = np.argmax(cos, axis=1)
                yield pd.DataFrame({"id": pdf["id"], "embedding": pdf["embedding"], "cell": cell.astype(np.int32), "angle": np.arccos(np.clip(cos[np.arange(len(cell)), cell], -1, 1))})

    placed = stored(rows.mapInPandas(assign, f"id {id_type}, embedding {vector_type}, cell int, angle double"), "placed")
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("widest"))
    stats = stored(stats.withColumn("parts", F.ceil(F.col("n") / chunk).cast("int")), "cells")
    stats.coalesce(1).write.mode("overwrite").parquet(f"{folder}/cells")
    dealt = placed.join(stats.select("cell", "parts"), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    out = dealt.select("cell", "part", "id", "embedding").repartitionByRange("cell", "part", F.xxhash64("id")).sortWithinPartitions("cell", "part")
    out.write.mode("overwrite").parquet(f"{folder}/vectors")
    table = [(i, [float(v) for v in c]) for i, c in enumerate(centres)]
    spark.createDataFrame(table, "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centroids")


def read_cells(spark: SparkSession, folder: str) -> CellIndex:
    centres = spark.read.parquet(f"{folder}/centroids").orderBy("cell").toPandas()  # at most MOST_CELLS
    array = np.vstack(centres["centroid"].to_numpy()) if len(centres) else np.zeros((0, 1))
    return CellIndex(spark.read.parquet(f"{folder}/vectors"), spark.read.parquet(f"{folder}/cells"), array)


def _meet(index: CellIndex, pairs: DataFrame, queries: DataFrame, k: int, threshold: float) -> DataFrame:
    """Best ``k`` per query and group over the (query_id, cell) pairs: (query_id, id, score)."""
    types = {c: f.schema[n].dataType.simpleString() for c, f, n in (("q", queries, "query_id"), ("i", index.vectors, "id"))}
    cells = [r["cell"] for r in pairs.select("cell").distinct().collect()]  # at most MOST_CELLS numbers
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    rows = index.vectors.where(F.col("cell").isin(cells or [-1]))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = pairs.join(index.cells.select("cell", "parts"), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = asked.join(queries.select("query_id", "embedding"), "query_id").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    keys = ["cell", "part", "block"]

    def meet(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if len(mine) and len(theirs):
            found = next(_search_batches(theirs["query_id"].to_numpy(), _unit(theirs["embedding"]), None, [mine], k, threshold), None)
            if found is not None:
                return found
        return pd.DataFrame({"query_id": [], "id": [], "score": []})

    return rows.groupBy(*keys).cogroup(asked.select(*keys, "query_id", "embedding").groupBy(*keys)).applyInPandas(meet, f"query_id {types['q']}, id {types['i']}, score double")


def cell_search(index: CellIndex, queries: DataFrame, top: int = 10, score_threshold: float = V.SCORE_THRESHOLD, probes: int = 4, exact: bool = True) -> DataFrame:
    """Cosine top hits per query: (query_id, rank, id, score), exact or of the nearest ``probes`` cells."""
    out_columns = ["query_id", "rank", "id", "score"]
    asked = stored(queries.select("query_id", "embedding").where("embedding is not null"), "asked")
    q_type = queries.schema["query_id"].dataType.simpleString()
    centres = index.centroids
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    rank = lambda df: df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    many = min(probes, len(centres))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) and many:
                cos = _unit(pdf["embedding"]) @ centres.T
                best = np.argpartition(-cos, many - 1, axis=1)[:, :many]
                yield pd.DataFrame({"query_id": np.repeat(pdf["query_id"].to_numpy(), many), "cell": best.ravel().astype(np.int32)})

    probed = stored(asked.mapInPandas(nearest, f"query_id {q_type}, cell int"), "probed")
    first = stored(_meet(index, probed, asked, top, -2.0 if exact else score_threshold), "first-hits")
    if not exact:
        return rank(first).select(*out_columns)
    floors = rank(first).where(F.col("rank") == top).select("query_id", F.col("score").alias("floor"))
    held = asked.join(floors, "query_id", "left").select("query_id", "embedding", F.greatest(F.coalesce("floor", F.lit(-2.0)), F.lit(score_threshold)).alias("floor"))
    widest = np.full(len(centres), -np.inf)
    for r in index.cells.collect():  # at most MOST_CELLS rows
        widest[r["cell"]] = r["widest"]

    def reachable(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) and len(centres):
                angle = np.arccos(np.clip(_unit(pdf["embedding"]) @ centres.T, -1, 1))
                bound = np.where(np.isfinite(widest), np.cos(np.maximum(0, angle - widest)), -3.0)
                rows, cells = np.nonzero(bound + SLACK >= pdf["floor"].to_numpy()[:, None])
                yield pd.DataFrame({"query_id": pdf["query_id"].to_numpy()[rows], "cell": cells.astype(np.int32)})

    further = stored(held.mapInPandas(reachable, f"query_id {q_type}, cell int").join(probed, ["query_id", "cell"], "left_anti"), "further")
    rest = _meet(index, further, asked, top, score_threshold)
    return rank(first.where(F.col("score") >= score_threshold).unionByName(rest)).select(*out_columns)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact hits that were found."""
    both = exact.select("query_id", "id").join(found.select("query_id", "id"), ["query_id", "id"], "left_semi").count()
    return both / max(1, exact.count())
