"""Raw texts to numbered lines, and one corpus text to one row per edition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import values as V
from ..functions import text as T


def explode_lines(docs: DataFrame, offsets: bool = False) -> DataFrame:
    """One row per line: ``line_no`` (1-based), ``line`` without its terminator.

    With ``offsets`` also ``char_start``/``char_end`` counted in code points and
    including terminators.
    """
    keep = [c for c in docs.columns if c != "text"]
    rows = docs.select(*keep, F.posexplode(T.lines_with_ends(F.col("text"))).alias("pos", "raw"))
    rows = rows.select(
        *keep,
        (F.col("pos") + 1).alias("line_no"),
        F.rtrim(F.col("raw"), F.lit("\n" + T.RARE_BREAKS)).alias("line"),
        F.length("raw").alias("__len"),
    )
    if not offsets:
        return rows.drop("__len")
    upto = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("char_end", F.sum("__len").over(upto))
        .withColumn("char_start", F.col("char_end") - F.col("__len"))
        .drop("__len")
    )


def edition_boundaries(corpus: DataFrame, patterns: dict[str, str] = V.EDITION_BOUNDARY) -> DataFrame:
    """Boundary lines with their line range ``[start_line, end_line]``.

    Only matching lines leave the scan, so the per-text window is tiny.
    """
    match_type = F.lit(None).cast("string")
    for name, pattern in reversed(list(patterns.items())):
        match_type = F.when(T.matches(F.col("raw_text"), pattern), F.lit(name)).otherwise(match_type)
    keep = [c for c in corpus.columns if c != "text"]

    def boundary_rows(lines):
        found = F.transform(
            lines, lambda line, i: F.struct((i + 1).alias("start_line"), T.strip(line).alias("raw_text"))
        )
        any_match = lambda t: F.array_max(
            F.array(*[T.matches(t, p) for p in patterns.values()])
        )
        return F.struct(
            F.filter(found, lambda x: any_match(x["raw_text"])).alias("hits"),
            F.size(lines).alias("n_lines"),
        )

    scanned = corpus.select(*keep, T.let(T.lines_with_ends(F.col("text")), boundary_rows).alias("b"))
    rows = scanned.select(*keep, F.col("b.n_lines").alias("n_lines"), F.inline("b.hits"))
    year = F.when(
        F.col("match_type") == "type_a", F.regexp_extract("raw_text", r"(\d{4})년", 1)
    ).otherwise(F.regexp_extract("raw_text", r"(\d{4})", 1))
    label = F.when(
        F.col("match_type") == "type_a", F.regexp_extract("raw_text", r"(초판|\d+차)", 1)
    ).otherwise(F.regexp_extract("raw_text", r"(\d+차)", 1))
    nxt = F.lead("start_line").over(Window.partitionBy("doc_id").orderBy("start_line"))
    return (
        rows.withColumn("match_type", match_type)
        .withColumn("year", year.try_cast("int"))
        .withColumn("label", label)
        .withColumn("edition_id", F.concat_ws("-", "year", "label"))
        .withColumn("end_line", F.coalesce(nxt - 1, F.col("n_lines")))
        .drop("n_lines")
    )


def split_editions(corpus: DataFrame, patterns: dict[str, str] = V.EDITION_BOUNDARY) -> DataFrame:
    """One row per edition with its text and span; lines before the first are dropped."""
    bounds = edition_boundaries(corpus, patterns).groupBy("doc_id").agg(
        F.array_sort(
            F.collect_list(F.struct("start_line", "end_line", "edition_id", "year", "label"))
        ).alias("eds")
    )

    def cut(lines):
        def one(e):
            body = F.array_join(
                F.slice(lines, e["start_line"], e["end_line"] - e["start_line"] + 1), ""
            )
            head = F.array_join(F.slice(lines, F.lit(1), e["start_line"] - 1), "")
            return F.struct(
                e["edition_id"].alias("edition_id"),
                e["year"].alias("year"),
                e["label"].alias("label"),
                e["start_line"].alias("start_line"),
                e["end_line"].alias("end_line"),
                F.length(head).alias("char_start"),
                (F.length(head) + F.length(body)).alias("char_end"),
                body.alias("text"),
            )

        return F.transform(F.col("eds"), one)

    return (
        corpus.select("doc_id", "text")
        .join(bounds, "doc_id")
        .select("doc_id", T.let(T.lines_with_ends(F.col("text")), cut).alias("e"))
        .select("doc_id", F.inline("e"))
    )
