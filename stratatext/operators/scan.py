"""Order-dependent numbering that never puts one hot group into one task.

A plain ``row_number`` over a group that holds a third of all rows sorts that
third in a single task.  Here every group is cut into document ranges; numbers
inside a document come from a per-document window, and each document's offset
from a two-step prefix sum over (group, range) and (group, document) counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def range_bounds(df: DataFrame, key: str, ranges: int = 64) -> list:
    """At most ``ranges - 1`` cut points that split ``key`` into even ranges."""
    steps = [i / ranges for i in range(1, ranges)]
    row = df.select(F.percentile_approx(key, steps, F.lit(10_000)).alias("q")).first()
    return sorted(set(row["q"] or []))


def range_of(key: Column, bounds: list) -> Column:
    """Number of the range a key falls in; monotone in the key."""
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= key))


def sequence_in_groups(
    df: DataFrame,
    group: list[str],
    doc: str,
    order: list[str],
    out: str,
    bounds: list,
) -> DataFrame:
    """1-based number of each row within ``group`` in (``doc``, ``order``) order.

    ``doc`` must be the column the rows are already clustered by (all rows of one
    document come from one input row).  Rows get their number inside the document
    and are written once; the prefix sum then reads only (document, group, count)
    from that table, and every document's offsets come back as one small map.
    """
    key = F.to_json(F.struct(*group), {"ignoreNullFields": "false"})
    local = Window.partitionBy(doc, *group).orderBy(*order)
    numbered = stored(df.withColumn("__n", F.row_number().over(local)).withColumn("__g", key), "numbered")
    counts = numbered.groupBy(doc, "__g").agg(F.max("__n").alias("__c")).withColumn("__r", range_of(F.col(doc), bounds))
    per_range = counts.groupBy("__g", "__r").agg(F.sum("__c").alias("__rc"))
    ahead = Window.partitionBy("__g").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    range_offset = per_range.select(
        "__g", "__r", F.coalesce(F.sum("__rc").over(ahead), F.lit(0)).alias("__ro")
    )
    inner = (
        Window.partitionBy("__g", "__r").orderBy(doc).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        counts.withColumn("__do", F.coalesce(F.sum("__c").over(inner), F.lit(0)))
        .join(range_offset, ["__g", "__r"])
        .groupBy(doc)
        .agg(
            F.map_from_entries(
                F.collect_list(F.struct("__g", (F.col("__do") + F.col("__ro")).alias("o")))
            ).alias("__offsets")
        )
    )
    return (
        numbered.join(offsets, doc)
        .withColumn(out, (F.col("__n") + F.col("__offsets")[F.col("__g")]).cast("long"))
        .drop("__n", "__g", "__offsets")
    )
