"""The quote table: build, validate, filter, count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import values as V
from ..functions import editions as E
from ..functions import ids
from ..functions import text as T
from ..functions import typing as Q
from .headers import HeaderRules
from .scan import range_bounds, sequence_in_groups
from .segments import segments, split_parts


def build_quotes(
    docs: DataFrame,
    header_rules: HeaderRules = V.HEADER_RULES,
    type_rules: list[dict] = V.TYPE_RULES,
    flag_rules: list[tuple] = V.FLAG_RULES,
    min_tokens: int = V.MIN_TOKENS,
    split: tuple[int, int, int] | None = (V.SPLIT_ABOVE, V.MAX_CHARS, V.OVERLAP_TOKENS),
    edition_spans_docs: bool = False,
) -> DataFrame:
    """Documents ``(doc_id, edition_id, text)`` to typed, hashed, flagged quotes.

    With ``edition_spans_docs`` the running number counts over all documents of
    an edition (two-step prefix sum, see :mod:`scan`); otherwise one document is
    one edition and the number stays inside the document.
    """
    segs = segments(docs, header_rules, min_tokens)
    if split:
        parts = segs.select(
            "*", F.posexplode(split_parts(F.col("text"), *split)).alias("part", "part_text")
        )
        body = (
            parts.withColumn(
                "token_count",
                F.when(F.col("part_text") == F.col("text"), F.col("token_count")).otherwise(
                    T.token_count(F.col("part_text"))
                ),
            )
            .drop("text")
            .withColumnRenamed("part_text", "text")
        )
    else:
        body = segs.withColumn("part", F.lit(0))
    typed = body.withColumn("type", Q.quote_type(F.col("text"), type_rules))
    group = ["edition_id", "section_path", "type"]
    if edition_spans_docs:
        bounds = range_bounds(docs, "doc_id")
        numbered = sequence_in_groups(typed, group, "doc_id", ["start_line", "part"], "seq", bounds)
    else:
        local = Window.partitionBy("doc_id", *group).orderBy("start_line", "part")
        numbered = typed.withColumn("seq", F.row_number().over(local))
    return numbered.select(
        ids.quote_id(F.col("edition_id"), F.col("section_path"), F.col("type"), F.col("seq")).alias("quote_id"),
        "doc_id",
        "edition_id",
        "type",
        "section_path",
        "text",
        F.col("char_start").cast("long").alias("char_start"),
        F.col("char_end").cast("long").alias("char_end"),
        F.col("start_line").cast("int").alias("start_line"),
        F.col("part").cast("int").alias("part"),
        F.col("token_count").cast("int").alias("token_count"),
        ids.text_hash(F.col("text")).alias("sha256"),
        Q.quality_flags(F.col("text"), flag_rules).alias("quality_flags"),
    )


# -- predicates ---------------------------------------------------------------


def where(
    edition: str | None = None,
    types: list[str] | None = None,
    section: str | None = None,
    banned_flags: list[str] | None = None,
) -> Column:
    """AND of the given metadata conditions; true when none is given.

    A missing type counts as narrative; the section condition is a substring
    test on every path element.
    """
    conds = []
    if edition:
        conds.append(F.col("edition_id") == edition)
    if types:
        kind = F.coalesce(F.col("type"), F.lit("narrative"))
        conds.append(kind == types[0] if len(types) == 1 else kind.isin(*types))
    if section:
        conds.append(F.exists("section_path", lambda s: F.contains(s, F.lit(section))))
    if banned_flags:
        conds.append(Q.has_no_flag(F.col("quality_flags"), banned_flags))
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def lookup(quotes: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Point lookups as one semi join."""
    return quotes.join(keys.select(on).distinct(), on, "left_semi")


def validate(
    records: DataFrame, editions: list = V.EDITIONS, hash_mode: str = "content"
) -> tuple[DataFrame, DataFrame]:
    """Legacy records to (good, rejected); rejected rows list every broken rule."""
    year = F.coalesce(E.year_of(F.col("edition_id"), editions), F.lit(None).cast("int"))
    rev = E.revision_of(F.col("edition_id"), editions)
    digest = ids.content_hash(F.col("text"), F.col("edition_id"), F.col("start_line"))
    if hash_mode == "text":
        digest = F.coalesce(F.when(F.col("sha256") != "", F.col("sha256")), digest)
    rows = (
        records.withColumn("year", year)
        .withColumn("revision_num", rev)
        .withColumn("content_hash", digest)
        .withColumn("is_definition", F.col("type") == "definition")
    )
    rules = [
        ("quote_id empty", F.coalesce(F.col("quote_id"), F.lit("")) == ""),
        ("text empty", F.coalesce(F.col("text"), F.lit("")) == ""),
        ("edition_id empty", F.coalesce(F.col("edition_id"), F.lit("")) == ""),
        ("year", ~F.coalesce(F.col("year").between(1979, 2100), F.lit(False))),
        ("revision_num", ~F.coalesce(F.col("revision_num").between(0, 30), F.lit(False))),
        ("quote_type", ~F.coalesce(F.col("type").isin(*V.QUOTE_TYPES), F.lit(False))),
        ("start_line", ~F.coalesce(F.col("start_line") >= 1, F.lit(False))),
        (
            "char_span",
            ~F.coalesce((F.col("char_start") >= 0) & (F.col("char_end") >= F.col("char_start")), F.lit(False)),
        ),
        ("content_hash", F.coalesce(F.length("content_hash") != 64, F.lit(True))),
    ]
    errors = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))
    checked = rows.withColumn("errors", errors)
    good = checked.filter(F.size("errors") == 0).drop("errors").withColumnRenamed("type", "quote_type")
    return good, checked.filter(F.size("errors") > 0)


# -- counts ---------------------------------------------------------------------


def counts_by(quotes: DataFrame, key: str) -> DataFrame:
    return quotes.groupBy(key).agg(F.count(F.lit(1)).alias("quotes"))


def type_distribution(quotes: DataFrame) -> DataFrame:
    """Quotes per type with their share and the flagged number."""
    per_type = quotes.groupBy("type").agg(
        F.count(F.lit(1)).alias("quotes"), F.count_if(F.size("quality_flags") > 0).alias("flagged")
    )
    total = F.sum("quotes").over(Window.partitionBy(F.lit(1)))
    return per_type.select("type", "quotes", "flagged", (F.col("quotes") * 100.0 / total).alias("pct"))


def build_summary(quotes: DataFrame, banned_flags: list[str] = V.EXCLUDED_FLAGS) -> DataFrame:
    """One row: totals before and after the flag filter and the type distribution."""
    per_type = quotes.groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(Q.has_no_flag(F.col("quality_flags"), banned_flags)).alias("kept")
    )
    return per_type.agg(
        F.sum("n").alias("total_quotes"),
        F.sum("kept").alias("filtered_quotes"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("type_distribution"),
    )


def ordered_reads(quotes: DataFrame, limit: int | None = None) -> DataFrame:
    out = quotes.orderBy("edition_id", "doc_id", "start_line", "part")
    return out.limit(limit) if limit else out


def page_sections(quotes: DataFrame, edition_id: str, title: str, line: int) -> DataFrame:
    """Pieces around a section: path holds the title, or line within 5, or text holds it.

    Pieces with the same start line: the second source wins.  Joined by blank
    lines in line order, one row per document.
    """
    mine = quotes.filter(F.col("edition_id") == edition_id)
    by_path = F.array_contains("section_path", F.lit(title))
    by_line = F.col("start_line").between(line - 5, line + 5) | F.contains("text", F.lit(title))
    picked = mine.filter(by_path | by_line).withColumn("rank", F.when(by_line, 2).otherwise(1))
    last = Window.partitionBy("doc_id", "start_line").orderBy(F.desc("rank"), F.desc("part"))
    one = picked.withColumn("rn", F.row_number().over(last)).filter("rn = 1")
    return one.groupBy("doc_id", "edition_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("start_line", "text"))), lambda p: p["text"]
            ),
            "\n\n",
        ).alias("page_text")
    )
