"""Idempotent ingest: first row per hash and id wins, known keys are skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def new_rows(incoming: DataFrame, table: DataFrame | None, order: list[str], id_col: str = "quote_id", hash_col: str = "content_hash") -> DataFrame:
    """Incoming rows that may be inserted, by hash first and then by id.

    Of rows with one hash the first in ``order`` stays, then of rows with one id;
    rows whose hash or id the table already holds are dropped.  Hot hashes (many
    copies) are cut per task before they are compared: the window keeps one row
    per key, so each task forwards at most one.
    """
    rows = incoming
    if table is not None:
        rows = rows.join(table.select(hash_col), hash_col, "left_anti").join(table.select(id_col), id_col, "left_anti")
    for key in (hash_col, id_col):
        w = Window.partitionBy(key).orderBy(*order)
        rows = rows.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")
    return rows


def new_rows_greedy(incoming: DataFrame, table: DataFrame | None, order: str, id_col: str = "quote_id", hash_col: str = "content_hash") -> DataFrame:
    """The exact row-by-row rule: a row enters unless its id or hash entered before.

    Sequential first-wins equals rounds of local minima: a row that comes first
    among the undecided rows of its id and of its hash enters, and every row that
    shares a key with an entered row is out.  Each round is two minima (combined
    before their shuffle) and anti joins, so a hash shared by a third of all rows
    never gathers anywhere.  ``order`` must be unique.
    """
    rows = incoming
    if table is not None:
        rows = rows.join(table.select(hash_col), hash_col, "left_anti").join(table.select(id_col), id_col, "left_anti")
    rows = stored(rows, "incoming")
    open_rows = rows.select(order, id_col, hash_col)
    entered = None
    while True:
        first = [open_rows.groupBy(k).agg(F.min(order).alias(order)).select(order) for k in (id_col, hash_col)]
        firsts = first[0].join(first[1], order)
        winners = stored(open_rows.join(firsts, order, "left_semi"), "winners")
        entered = winners if entered is None else entered.unionByName(winners)
        open_rows = stored(
            open_rows.join(winners.select(id_col), id_col, "left_anti").join(winners.select(hash_col), hash_col, "left_anti"),
            "undecided",
        )
        if open_rows.isEmpty():
            break
    return rows.join(entered.select(order), order, "left_semi")


def ingest_report(parsed: DataFrame, rejected: DataFrame, inserted: DataFrame, table_after: DataFrame, expected_min: int | None = None) -> DataFrame:
    """One row: parsed, converted, inserted, skipped, errors, table total, gate."""
    n = lambda df: df.agg(F.count(F.lit(1))).scalar()
    one = parsed.sparkSession.range(1)
    out = one.select(
        (n(parsed) + n(rejected)).alias("parsed"), n(parsed).alias("converted"), n(inserted).alias("inserted"),
        (n(parsed) - n(inserted)).alias("skipped"), n(rejected).alias("errors"), n(table_after).alias("table_total"),
    )
    return out.withColumn("verified", F.lit(True) if expected_min is None else F.col("table_total") >= expected_min)


def update_delta(before: DataFrame, after: DataFrame, source: DataFrame) -> DataFrame:
    """One row: table sizes before and after, net new rows, and whether the source has more rows."""
    n = lambda df: df.agg(F.count(F.lit(1))).scalar()
    return before.sparkSession.range(1).select(
        n(before).alias("before"), n(after).alias("after"), (n(after) - n(before)).alias("net_new"), (n(source) > n(before)).alias("has_updates"),
    )
