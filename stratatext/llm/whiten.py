"""Whitening of embeddings by shifted CholeskyQR.

The vectors become whole numbers, and each distinct one is fitted once.  With X the
centred rows of that list, a pass over it sums the Gram matrix of X in every task; its
Cholesky factor R1, taken with a small shift that keeps a badly conditioned matrix
positive, gives Q1 = X R1^-1 by a triangular solve.  Later passes do the same with
Q1, Q2, ...: each solves its rows through the factors so far, so no Q is stored, and the
product of the factors is R with X = Q R and Q orthogonal to rounding.  The singular
values of R are those of X; its right singular vectors are the components.  What is
left of Q's Gram matrix at the end is folded into R, so directions without variance
(whose Cholesky pivots are only the shift) come out as zeros.

Only matrices of dimension x dimension reach the driver, a few of them per pass.

Defined results: rows whose vector is null, empty, holds a null, a non-finite entry or
one beyond 2^44 in size have no rows; of vectors of several lengths those of the most
frequent length (smaller first) take part, the others have no rows.  Repeated rows and
ids are answered each, null ids stay null.  Components without variance (to double
precision) are left out, so a table of one vector, or none, gives no rows.  A deviation
beyond a long is null.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratatext.llm.common import arrow_rows, drop, save

SCALE = 256
#: Entries beyond this have no exact whole-number form here.
LARGEST = float(1 << 44)
#: Gram passes: one with a large shift, then two that orthogonalise.
PASSES = 3
#: Bytes of partial matrices that the driver may receive in a pass.
DRIVER_BYTES = 32 << 20
#: An eigenvalue below this share of the largest is no variance.
NOTHING = 1e-26


@dataclass
class Whitening:
    """n fitted vectors, their sums, and per component (a column of ``axes``) its eigenvalue."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float


def whole_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, x): rows with a usable vector, its entries as whole numbers."""
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(column).alias("_v"))
    usable = F.forall("_v", lambda c: F.coalesce(F.abs(c.cast("double")) <= LARGEST, F.lit(False)))  # NaN is larger than all
    kept = rows.where(F.coalesce(usable & (F.size("_v") > 0), F.lit(False)))
    return kept.select("vec_id", F.transform("_v", lambda c: F.floor(c.cast("double") * SCALE).cast("long")).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """An Arrow column of lists of ``d`` whole numbers as a matrix of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def solve_lower(lower: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with ``lower`` x = b, by forward substitution over all columns of b."""
    x = b.copy()
    for i in range(len(lower)):
        x[i] = (x[i] - lower[i, :i] @ x[:i]) / lower[i, i]
    return x


def _summed(fit: DataFrame, d: int, size: int, part) -> np.ndarray:
    """Sum over all batches of ``part(x)`` (``size`` doubles): in tasks, in a few tasks, then here."""
    schema = pa.schema([("slot", pa.int32()), ("m", pa.list_(pa.float64()))])
    few = max(1, min(16, DRIVER_BYTES // (8 * size)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size), 0
        for batch in batches:
            if batch.num_rows:
                total += part(_matrix(batch.column("x"), d))
                n += batch.num_rows
        if n:
            yield arrow_rows(schema, [(n % few, total)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size), 0
        for batch in batches:
            for m in batch.column("m"):
                total += m.values.to_numpy()
                n += 1
        if n:
            yield arrow_rows(schema, [(0, total)])

    parts = fit.mapInArrow(run, "slot int, m array<double>").repartition(few, "slot").mapInArrow(add, "slot int, m array<double>")
    return sum((np.array(r["m"]) for r in parts.collect()), np.zeros(size))


def fit_whitening(fit: DataFrame, components: int = 4, passes: int = PASSES) -> Whitening | None:
    """Fit on the rows ``x`` of a stored table; none without variance."""
    first = fit.select("x").limit(1).collect()
    if not first:
        return None
    d = len(first[0]["x"])
    # Exact sums per place of the vector: decimal, so that no count of rows overflows.
    rows = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).collect()
    sums = [0] * d
    for r in rows:
        sums[r["i"]], n = int(r["s"]), r["n"]
    mean = np.array([s / n for s in sums])
    factors: list[np.ndarray] = []

    def gram(held: list[np.ndarray]) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            q = (x - mean).T
            for r in held:
                q = solve_lower(r.T, q)  # rows times R^-1
            return (q @ q.T).ravel()

        return _summed(fit, d, d * d, part).reshape(d, d)

    g = gram(factors)
    total = float(np.trace(g))
    if total <= 0:
        return None
    unit = np.finfo(float).eps
    for k in range(passes):
        # The shift of the first pass follows rows and columns; later ones only keep directions without variance positive.
        shift = 11 * (n * d + d * (d + 1)) * unit * total if k == 0 else 11 * d * unit
        shift = min(shift, 1e-4 * total) if k == 0 else shift
        factors.append(np.linalg.cholesky(g + shift * np.eye(d)).T)
        g = gram(factors)
    r = np.eye(d)
    for f in factors:
        r = f @ r
    left, turn = np.linalg.eigh((g + g.T) / 2)
    r = np.sqrt(np.clip(left, 0, None))[:, None] * (turn.T @ r)
    _, sigma, axes = np.linalg.svd(r)
    values = sigma**2 / n
    keep = [k for k in range(min(components, d)) if values[k] > NOTHING * values[0]]
    out = Whitening(n, sums, axes[keep].T.copy(), values[keep], total / n, 0.0)
    c = len(keep)

    def projected(x: np.ndarray) -> np.ndarray:
        w = ((x - mean) @ out.axes) / np.sqrt(out.values)
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    both = _summed(fit, d, c + c * c, projected) / n
    out.identity_error = float(np.abs(both[c:].reshape(c, c) - np.outer(both[:c], both[:c]) - np.eye(c)).max())
    return out


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum over the places of (n*x - S)^2; null beyond a long."""
    far = max(abs(n * int(x.max()) - min(sums)), abs(n * int(x.min()) - max(sums)))
    if x.shape[1] * far * far < 1 << 63 and max(n * int(abs(x).max()), *map(abs, sums)) < 1 << 63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = (sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist())
    return [v if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, components: int = 4, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per usable row and component."""
    rows = whole_vectors(vectors, key, column)
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not sizes:
        return spark.createDataFrame([], schema)
    d = sizes[0]["d"]
    rows = rows.where(F.size("x") == d)
    fit, path = save(rows.select("x").distinct(), "fit-list")
    model = fit_whitening(fit, components)
    drop(spark, path)
    if model is None:
        return spark.createDataFrame([], schema)
    mean = np.array([s / model.n for s in model.sums])
    share = model.values / model.trace
    c = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), d)
            w = ((x - mean) @ model.axes) / np.sqrt(model.values)
            size = len(x) * c
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), c))),
                    pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(size, model.n)),
                    pa.array([v for v in _deviations(x, model.n, model.sums) for _ in range(c)], pa.int64()),
                    pa.array(w.ravel()),
                    pa.array(np.tile(share, len(x))),
                    pa.array(np.full(size, model.identity_error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
