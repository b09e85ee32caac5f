"""Headers, their paths, and everything read off the table of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import values as V
from ..functions import text as T
from ..session import broadcast_if_small
from .textjoin import contains_join

HeaderRules = list[tuple[str, int, str]]


def level_of(line: Column, rules: HeaderRules) -> Column:
    """Name of the first level whose pattern matches, else null."""
    out = F.lit(None).cast("string")
    for name, _, pattern in reversed(rules):
        out = F.when(T.matches(line, pattern), F.lit(name)).otherwise(out)
    return out


def depth_of(level: Column, rules: HeaderRules) -> Column:
    out = F.lit(None).cast("int")
    for name, depth, _ in rules:
        out = F.when(level == name, F.lit(depth)).otherwise(out)
    return out


def title_of(line: Column) -> Column:
    """Header line cut at its first colon when the head is under 100 characters."""
    head = F.substring_index(line, ":", 1)
    return F.when(F.contains(line, F.lit(":")) & (F.length(head) < 100), T.strip(head)).otherwise(line)


def add_paths(headers: DataFrame, rules: HeaderRules, line: str = "line") -> DataFrame:
    """Add ``path``: titles of the enclosing headers, the row's own title last.

    The last header of each depth so far is a running maximum; it encloses the
    row unless a shallower header came later.  All running maxima share one
    per-document window.  Rows before the first header get an empty path.
    """
    depths = sorted({d for _, d, _ in rules})
    upto = Window.partitionBy("doc_id").orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    last = {
        f"__h{d}": F.max(F.when(F.col("depth") == d, F.struct(F.col(line).alias("at"), "title"))).over(upto)
        for d in depths
    }
    out = headers.withColumns(last)
    parts = []
    for i, d in enumerate(depths):
        here = F.col(f"__h{d}")
        alive = here.isNotNull()
        for s in depths[:i]:
            shallower = F.col(f"__h{s}")
            alive = alive & (shallower.isNull() | (shallower["at"] < here["at"]))
        parts.append(F.when(alive, here["title"]))
    return out.withColumn("path", F.array_compact(F.array(*parts))).drop(*[f"__h{d}" for d in depths])


def header_rows(docs: DataFrame, rules: HeaderRules = V.HEADER_RULES) -> DataFrame:
    """Header lines only: doc_id, edition_id, line, level, depth, title, n_lines.

    Lines are tested inside the scan, so nothing but headers is ever shuffled.
    Documents without headers give no rows.
    """
    first = F.col("start_line") if "start_line" in docs.columns else F.lit(1)

    def found(lines):
        heads = F.transform(
            lines,
            lambda raw, i: F.struct(
                (i + first).alias("line"), T.strip(raw).alias("head"), level_of(T.strip(raw), rules).alias("level")
            ),
        )
        return F.struct(
            F.filter(heads, lambda h: h["level"].isNotNull()).alias("hs"), F.size(lines).alias("n_lines")
        )

    scanned = docs.select("doc_id", "edition_id", T.let(T.lines_with_ends(F.col("text")), found).alias("f"))
    return scanned.select("doc_id", "edition_id", F.col("f.n_lines").alias("n_lines"), F.inline("f.hs")).select(
        "doc_id",
        "edition_id",
        "line",
        "level",
        depth_of(F.col("level"), rules).alias("depth"),
        title_of(F.col("head")).alias("title"),
        "n_lines",
    )


def toc(docs: DataFrame, rules: HeaderRules = V.HEADER_RULES) -> DataFrame:
    """Flat table of contents: one H0 row per document, then its headers.

    ``path`` starts with the edition id.
    """
    heads = add_paths(header_rows(docs, rules), rules)
    body = heads.select(
        "doc_id", "edition_id", "level", "depth", "title", "line",
        F.concat(F.array("edition_id"), "path").alias("path"),
    )
    first = F.col("start_line") if "start_line" in docs.columns else F.lit(1)
    roots = docs.select(
        "doc_id",
        "edition_id",
        F.lit("H0").alias("level"),
        F.lit(0).alias("depth"),
        (F.col("raw_text") if "raw_text" in docs.columns else F.col("edition_id")).alias("title"),
        first.cast("int").alias("line"),
        F.array("edition_id").alias("path"),
    )
    return roots.unionByName(body)


def header_gaps(docs: DataFrame, rules: HeaderRules = V.HEADER_RULES, threshold: int = V.HEADER_GAP_LINES) -> DataFrame:
    """Stretches longer than ``threshold`` lines without a header.

    The first line counts as a header; the tail runs to the last line.
    """
    first = F.col("start_line") if "start_line" in docs.columns else F.lit(1)
    size = F.size(T.lines_with_ends(F.col("text")))
    extent = docs.select("doc_id", "edition_id", first.alias("lo"), (first + size - 1).alias("hi"))
    heads = header_rows(docs, rules).select("doc_id", "edition_id", "line")
    points = (
        heads.select("doc_id", "edition_id", "line", F.lit(1).alias("kind"))
        .unionByName(extent.select("doc_id", "edition_id", F.col("lo").alias("line"), F.lit(0).alias("kind")))
        .unionByName(extent.select("doc_id", "edition_id", F.col("hi").alias("line"), F.lit(2).alias("kind")))
    )
    prev = F.lag("line").over(Window.partitionBy("doc_id").orderBy("line", "kind"))
    return (
        points.withColumn("start_line", prev)
        .filter((F.col("line") - F.col("start_line")) > threshold)
        .select(
            "doc_id", "edition_id", "start_line", F.col("line").alias("end_line"),
            (F.col("line") - F.col("start_line")).alias("gap_lines"),
        )
    )


def toc_stats(toc_rows: DataFrame) -> DataFrame:
    """Per document: node count, greatest 0-based depth, leaf count, nodes per level."""
    nodes = toc_rows.filter(F.col("level") != "H0").withColumn("d", F.size("path") - 2)
    nxt = F.lead("d").over(Window.partitionBy("doc_id").orderBy("line"))
    return (
        nodes.withColumn("leaf", F.coalesce(nxt <= F.col("d"), F.lit(True)))
        .groupBy("doc_id", "edition_id")
        .agg(
            F.count(F.lit(1)).alias("total_nodes"),
            F.max("d").alias("max_depth"),
            F.count_if("leaf").alias("leaf_count"),
            F.count_if(F.col("depth") == 1).alias("depth1_nodes"),
            F.count_if(F.col("depth") == 2).alias("depth2_nodes"),
            F.count_if(F.col("depth") >= 3).alias("deeper_nodes"),
        )
    )


def level_counts(toc_rows: DataFrame) -> DataFrame:
    return (
        toc_rows.filter(F.col("level") != "H0")
        .groupBy("edition_id", "level")
        .agg(F.count(F.lit(1)).alias("nodes"))
    )


def section_counts(toc_rows: DataFrame) -> DataFrame:
    """Editions with their number of sections (zero kept)."""
    return toc_rows.groupBy("edition_id").agg(
        F.count_if(F.col("level") != "H0").alias("section_count"),
        F.count_if(F.col("level") == "H0").alias("documents"),
    )


def compare_titles(toc_rows: DataFrame, edition_a: str, edition_b: str, max_level: int = 2) -> DataFrame:
    """Distinct titles down to 0-based depth ``max_level``: common, only_a, only_b."""
    nodes = toc_rows.filter(
        (F.col("level") != "H0")
        & ((F.size("path") - 2) <= max_level)
        & F.col("edition_id").isin(edition_a, edition_b)
    )
    sides = nodes.groupBy("title").agg(
        F.bool_or(F.col("edition_id") == edition_a).alias("in_a"),
        F.bool_or(F.col("edition_id") == edition_b).alias("in_b"),
    )
    return sides.select(
        "title",
        F.when(F.col("in_a") & F.col("in_b"), "common").when(F.col("in_a"), "only_a").otherwise("only_b").alias("side"),
    )


def search_titles(toc_rows: DataFrame, needle: str, edition_id: str | None = None) -> DataFrame:
    """Headers whose title contains ``needle``, ignoring case.

    An edition id that does not occur searches every edition.
    """
    nodes = toc_rows.filter(F.col("level") != "H0").filter(
        F.contains(F.lower("title"), F.lit(needle.lower()))
    )
    if edition_id is not None and not toc_rows.filter(F.col("edition_id") == edition_id).isEmpty():
        nodes = nodes.filter(F.col("edition_id") == edition_id)
    return nodes.select("doc_id", "edition_id", "path", "level", "title", "line")



def search_titles_many(toc_rows: DataFrame, needles: DataFrame) -> DataFrame:
    """:func:`search_titles` for each row of ``needles(query_id, needle, edition_id)``.

    A null edition, or one that does not occur, searches every edition; null and empty
    needles find nothing.  Distinct titles meet distinct needles on substrings; only
    titles that hold a needle go back to their headers.
    """
    nodes = toc_rows.filter(F.col("level") != "H0").withColumn("_title", F.lower("title"))
    known = toc_rows.select(F.col("edition_id").alias("_only")).distinct()
    asked = (
        needles.select("query_id", F.lower("needle").alias("_needle"), F.col("edition_id").alias("_asked"))
        .join(broadcast_if_small(known), F.col("_asked") == F.col("_only"), "left").drop("_asked")
    )
    found = contains_join(nodes.select("_title").distinct(), "_title", asked.select("_needle").distinct(), "_needle")
    pairs = found.join(asked, "_needle")
    met = nodes.join(pairs, "_title").filter(F.col("_only").isNull() | (F.col("_only") == F.col("edition_id")))
    return met.select("query_id", "doc_id", "edition_id", "path", "level", "title", "line")


def section_text(docs: DataFrame, starts: DataFrame, rules: HeaderRules = V.HEADER_RULES, max_lines: int = 100) -> DataFrame:
    """Text from each ``(doc_id, line)`` to the next header or the document end.

    At most ``max_lines`` lines; the start line is included, the last line of an
    unfollowed section is not (the end bound is exclusive).  The next header comes
    from one window per document over header and start lines; the text is cut in
    the row that holds it.
    """
    first = F.col("start_line") if "start_line" in docs.columns else F.lit(1)
    heads = header_rows(docs, rules).select("doc_id", F.col("line").cast("int").alias("line"), F.lit(True).alias("is_head"))
    points = heads.unionByName(starts.select("doc_id", F.col("line").cast("int").alias("line"), F.lit(False).alias("is_head")).distinct())
    later = Window.partitionBy("doc_id").orderBy("line").rangeBetween(1, Window.unboundedFollowing)
    wanted = (
        points.withColumn("next", F.min(F.when(F.col("is_head"), F.col("line"))).over(later))
        .filter(~F.col("is_head"))
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("line", "next")).alias("wanted"))
    )

    def cut(lines):
        def from_line(w):
            stop = F.coalesce(w["next"], F.size(lines) + first - 1)
            n = F.least(stop - w["line"], F.lit(max_lines))
            body = F.when(
                n > 0, F.array_join(F.slice(lines, F.greatest(w["line"] - first + 1, F.lit(1)), n), "")
            ).otherwise("")
            return F.struct(w["line"].alias("line"), T.strip(body).alias("section_text"))

        return F.transform(F.col("wanted"), from_line)

    return (
        docs.join(wanted, "doc_id")
        .select("doc_id", "edition_id", T.let(T.lines_with_ends(F.col("text")), cut).alias("s"))
        .select("doc_id", "edition_id", F.inline("s"))
    )


def breadcrumb(path: Column) -> Column:
    return F.when(F.size(path) == 0, "(no path)").otherwise(F.array_join(path, " > "))
