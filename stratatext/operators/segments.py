"""Cut documents at headers, merge small pieces, split long ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import values as V
from ..functions import text as T
from .headers import HeaderRules, add_paths, depth_of, level_of, title_of


def raw_segments(docs: DataFrame, rules: HeaderRules = V.HEADER_RULES) -> DataFrame:
    """One row per header block.

    Columns: doc_id, edition_id, doc_char_start, start_line, level, depth, title,
    text.  The block before the first header has a null level.  Documents are
    hash-partitioned by ``doc_id`` before they are cut, so all per-document
    windows and groupings that follow need no further exchange.
    """
    first = F.col("start_line") if "start_line" in docs.columns else F.lit(1)
    base = F.col("char_start") if "char_start" in docs.columns else F.lit(0)

    def cut(lines: Column) -> Column:
        marks = F.filter(
            F.transform(
                lines, lambda raw, i: F.when(level_of(T.strip(raw), rules).isNotNull(), i + 1)
            ),
            lambda x: x.isNotNull(),
        )
        starts = F.array_distinct(F.concat(F.array(F.lit(1)), marks))

        def blocks(bs: Column) -> Column:
            def one(b: Column, k: Column) -> Column:
                stop = F.coalesce(F.get(bs, k + 1), F.size(lines) + 1)
                return F.struct(
                    (b + first - 1).alias("start_line"),
                    T.strip(F.get(lines, b - 1)).alias("head"),
                    F.array_join(F.slice(lines, b, stop - b), "").alias("text"),
                )

            return F.transform(bs, one)

        return T.let(starts, blocks)

    segs = docs.filter(F.length("text") > 0).repartition("doc_id").select(
        "doc_id",
        "edition_id",
        base.cast("long").alias("doc_char_start"),
        F.inline(T.let(T.lines_with_ends(F.col("text")), cut)),
    )
    level = level_of(F.col("head"), rules)
    return segs.select(
        "doc_id",
        "edition_id",
        "doc_char_start",
        "start_line",
        level.alias("level"),
        depth_of(level, rules).alias("depth"),
        F.when(level.isNotNull(), title_of(F.col("head"))).alias("title"),
        "text",
    )


def segments(
    docs: DataFrame, rules: HeaderRules = V.HEADER_RULES, min_tokens: int = V.MIN_TOKENS
) -> DataFrame:
    """Header blocks with path, span and token count; small ones merged.

    A block under ``min_tokens`` joins the block before it when both have the
    same path.  Offsets, paths, islands and the final grouping all cluster on
    ``doc_id``: one exchange for the whole operator.
    """
    by_doc = Window.partitionBy("doc_id").orderBy("start_line")
    ahead = by_doc.rowsBetween(Window.unboundedPreceding, -1)
    upto = by_doc.rowsBetween(Window.unboundedPreceding, 0)
    placed = raw_segments(docs, rules).withColumn(
        "char_start", F.col("doc_char_start") + F.coalesce(F.sum(F.length("text")).over(ahead), F.lit(0))
    )
    pathed = add_paths(placed, rules, line="start_line").filter(T.strip(F.col("text")) != "")
    joins_previous = (F.col("token_count") < min_tokens) & (
        F.col("path") == F.lag("path").over(by_doc)
    )
    marked = (
        pathed.withColumn("token_count", T.token_count(F.col("text")))
        .withColumn("__start", F.when(F.coalesce(joins_previous, F.lit(False)), 0).otherwise(1))
        .withColumn("segment_no", F.sum("__start").over(upto))
    )
    piece = F.array_sort(F.collect_list(F.struct("start_line", "text")))
    return (
        marked.groupBy("doc_id", "edition_id", "segment_no")
        .agg(
            F.min("start_line").alias("start_line"),
            F.min("char_start").alias("char_start"),
            F.first("path").alias("section_path"),
            F.sum("token_count").alias("token_count"),
            piece.alias("__pieces"),
        )
        .withColumn("text", F.array_join(F.transform("__pieces", lambda p: p["text"]), ""))
        .withColumn("char_end", F.col("char_start") + F.length("text"))
        .drop("__pieces")
    )


def split_parts(
    text: Column,
    split_above: int = V.SPLIT_ABOVE,
    max_chars: int = V.MAX_CHARS,
    overlap_tokens: int = V.OVERLAP_TOKENS,
) -> Column:
    """Array of parts of a text; texts up to ``split_above`` stay whole.

    Lines are gathered until the next one would pass ``max_chars``; the following
    part then starts with the fewest whole trailing lines that reach
    ``overlap_tokens`` tokens (all of them when they do not reach it).  The fold
    runs in the row that holds the text and keeps only line numbers and running
    totals as its state.
    """

    def fold(lines: Column) -> Column:
        sizes = F.transform(
            lines, lambda s: F.struct(F.length(s).alias("c"), T.token_count(s).alias("t"))
        )

        def run(meta: Column) -> Column:
            def overlap_from(lo: Column, hi: Column) -> Column:
                back = F.reverse(F.sequence(lo, hi))
                state = F.aggregate(
                    back,
                    F.struct(F.lit(0).alias("t"), hi.alias("at")),
                    lambda a, i: F.when(a["t"] >= overlap_tokens, a).otherwise(
                        F.struct((a["t"] + F.get(meta, i - 1)["t"]).alias("t"), i.alias("at"))
                    ),
                )
                return state["at"]

            def chars(lo: Column, hi: Column) -> Column:
                return F.aggregate(
                    F.slice(meta, lo, hi - lo + 1), F.lit(0), lambda a, m: a + m["c"]
                )

            empty = F.array().cast("array<struct<lo:int,hi:int>>")
            start = F.struct(empty.alias("parts"), F.lit(1).alias("lo"), F.lit(0).alias("c"))

            def step(a: Column, i: Column) -> Column:
                size = F.get(meta, i - 1)["c"]
                full = (a["c"] + size > max_chars) & (i > a["lo"])
                lo = F.when(full, overlap_from(a["lo"], i - 1)).otherwise(a["lo"])
                part = F.array(F.struct(a["lo"].alias("lo"), (i - 1).alias("hi")))
                return F.struct(
                    F.when(full, F.concat(a["parts"], part)).otherwise(a["parts"]).alias("parts"),
                    lo.alias("lo"),
                    F.when(full, chars(lo, i - 1) + size).otherwise(a["c"] + size).alias("c"),
                )

            done = F.aggregate(F.sequence(F.lit(1), F.size(lines)), start, step)
            ranges = T.let(
                done,
                lambda d: F.concat(
                    d["parts"],
                    F.array(F.struct(d["lo"].alias("lo"), F.size(lines).alias("hi"))),
                ),
            )
            return F.transform(
                ranges, lambda r: F.array_join(F.slice(lines, r["lo"], r["hi"] - r["lo"] + 1), "")
            )

        return T.let(sizes, run)

    return F.when(F.length(text) <= split_above, F.array(text)).otherwise(
        T.let(T.lines_with_ends(text), fold)
    )
