"""Changes between editions: grouping, conflicts, concept timelines, warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import values as V

DEFINITIONS_LABEL = "(검색 결과 내 정의)"  # fixed value: concept name of TC-001


def group_by_edition(hits: DataFrame, max_chars: int = 500, max_editions: int = 0) -> DataFrame:
    """Hits ``(query_id, rank, edition_id, sort_key, year, type, text)`` per query and edition.

    Year of the first hit, cut texts split into definitions and others in rank
    order, ``ord`` = place in time; at most ``max_editions`` oldest when set.
    """
    cut = F.substring("text", 1, max_chars)
    is_def = F.col("type") == "definition"
    texts = lambda c: F.transform(
        F.array_sort(F.collect_list(F.when(c, F.struct("rank", cut.alias("t"))))), lambda x: x["t"]
    )
    grouped = hits.groupBy("query_id", "edition_id", "sort_key").agg(
        F.min_by("year", "rank").alias("year"),
        F.count(F.lit(1)).alias("hit_count"),
        texts(is_def).alias("definition_texts"),
        texts(~is_def).alias("other_texts"),
    )
    w = Window.partitionBy("query_id").orderBy("sort_key", "edition_id")
    out = grouped.withColumn("ord", F.row_number().over(w))
    return out.filter(F.col("ord") <= max_editions) if max_editions else out


def definition_conflicts(hits: DataFrame) -> DataFrame:
    """Per query: do definitions span two or more editions, which, and how many."""
    is_def = F.col("type") == "definition"
    eds = F.array_sort(F.collect_set(F.when(is_def, F.struct("sort_key", "edition_id"))))
    return (
        hits.groupBy("query_id")
        .agg(eds.alias("eds"), F.count_if(is_def).alias("definition_count"))
        .select(
            "query_id",
            (F.size("eds") >= 2).alias("has_conflict"),
            F.transform("eds", lambda e: e["edition_id"]).alias("conflicting_editions"),
            "definition_count",
        )
    )


def cross_edition_terms(quotes: DataFrame, pattern: str = V.TERM_PATTERN, stopwords: list[str] | None = None, min_editions: int = 2) -> DataFrame:
    """Terms of definition quotes found in several editions, with quote counts."""
    terms = F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), 0))
    rows = quotes.filter(F.col("type") == "definition").select("edition_id", F.explode(terms).alias("term"))
    if stopwords:
        rows = rows.filter(~F.col("term").isin(*stopwords))
    # Two steps: (term, edition) first, so a hot term meets one row per edition.
    per_edition = rows.groupBy("term", "edition_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_edition.groupBy("term")
        .agg(
            F.count(F.lit(1)).alias("edition_count"),
            F.sum("n").alias("quote_count"),
            F.array_sort(F.collect_list("edition_id")).alias("editions"),
        )
        .filter(F.col("edition_count") >= min_editions)
    )


# -- concept timelines: concepts(concept_id, name_ko, name_en, category,
#    first_edition, last_edition), statuses(concept_id, edition_id, year, status, note)


def explode_timeline(concepts: DataFrame, years: DataFrame) -> DataFrame:
    """Concept rows with ``editions`` map<string, struct<status, note>> to status rows.

    Editions without a known year get year 0 and sort last.
    """
    rows = concepts.select("concept_id", F.explode("editions").alias("edition_id", "info"))
    return rows.join(years.select("edition_id", F.col("year").alias("y")), "edition_id", "left").select(
        "concept_id",
        "edition_id",
        F.coalesce("y", F.lit(0)).alias("year"),
        F.coalesce("y", F.lit(9999)).alias("sort_year"),
        F.coalesce("info.status", F.lit("maintained")).alias("status"),
        F.coalesce("info.note", F.lit("")).alias("note"),
    )


def evolution_summary(concepts: DataFrame, statuses: DataFrame) -> DataFrame:
    """One row per concept: status counts, activity, ordered history."""
    per = statuses.groupBy("concept_id").agg(
        F.count(F.lit(1)).alias("edition_count"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in ("introduced", "modified", "renamed")],
        F.array_sort(F.collect_list(F.struct("year", "edition_id", "status", "note"))).alias("history"),
    )
    return concepts.join(per, "concept_id", "left").withColumn("is_active", F.col("last_edition").isNull())


def concepts_where(
    concepts: DataFrame, statuses: DataFrame, category: str | None = None, edition: str | None = None,
    active: bool | None = None, status: str | None = None,
) -> DataFrame:
    """Concepts by category, by edition (optionally with a status there), by activity."""
    out = concepts
    if category is not None:
        out = out.filter(F.col("category") == category)
    if active is not None:
        out = out.filter(F.col("last_edition").isNull() == F.lit(active))
    if edition is not None:
        at = statuses.filter(F.col("edition_id") == edition)
        if status is not None:
            at = at.filter(F.col("status") == status)
        out = out.join(at.select("concept_id"), "concept_id", "left_semi")
    return out


def status_transitions(statuses: DataFrame) -> DataFrame:
    """(source edition, target edition, status) links with their number of concepts."""
    w = Window.partitionBy("concept_id").orderBy("year", "edition_id")
    return (
        statuses.withColumn("source", F.lag("edition_id").over(w))
        .filter(F.col("source").isNotNull())
        .groupBy("source", F.col("edition_id").alias("target"), "status")
        .agg(F.count(F.lit(1)).alias("concepts"))
    )


def match_concepts(queries: DataFrame, concepts: DataFrame, direction: str = "query_in_name") -> DataFrame:
    """(query_id, concept_id) by name, ignoring case.

    ``query_in_name``: the whole query occurs in a Korean name, English name or
    concept id.  ``name_in_query``: a name occurs in the query.
    """
    from .textjoin import contains_join

    names = concepts.select(
        "concept_id", F.explode(F.array(F.lower("name_ko"), F.lower("name_en"), F.lower("concept_id"))).alias("name")
    ).filter(F.length("name") > 0).distinct()
    q = queries.select("query_id", F.lower("text").alias("low"))
    if direction == "query_in_name":
        pairs = contains_join(names, "name", q, "low")
    else:
        pairs = contains_join(q, "low", names, "name")
    return pairs.select("query_id", "concept_id").distinct()


def hint_year(hint: Column, editions: list = V.EDITIONS) -> Column:
    """Year an edition hint stands for: leading year, known revision, first edition."""
    year = F.regexp_extract(hint, r"^(\d{4})", 1)
    rev = F.regexp_extract(hint, r"^(\d{1,2})차", 1)
    known = {str(r): y for _, y, r in editions if r in (0, 1, 10, 11, 12, 13, 14)}
    by_rev = F.lit(None).cast("int")
    for r, y in known.items():
        by_rev = F.when(rev == r, F.lit(y)).otherwise(by_rev)
    return (
        F.when(year != "", year.cast("int"))
        .when(rev != "", by_rev)
        .when(F.contains(hint, F.lit("초판")), F.lit(1979))
    )


def warnings(
    hits: DataFrame,
    queries: DataFrame,
    matches: DataFrame,
    concepts: DataFrame,
    statuses: DataFrame,
    known: DataFrame,
    max_warnings: int = 3,
    editions: list = V.EDITIONS,
) -> DataFrame:
    """Temporal warnings per query that has hits, at most ``max_warnings``.

    ``matches(query_id, concept_id)`` links queries to concepts; ``known(ord,
    concept, concept_id, editions)`` lists known conflicts, matched when the
    concept name or id occurs in the query and two of its editions are among the
    hits.  Rules in order: TC-001 definitions in several editions; TC-002 concept
    gone / TC-003 concept newer than the hint, per concept; TC-004 renamed; known
    conflicts.  The first warning per (rule, concept) counts.
    """
    from .textjoin import contains_join

    asked = queries.join(hits.select("query_id").distinct(), "query_id", "left_semi")
    cols = ["query_id", "rule_id", "severity", "concept", "editions", "seq", "ord", "sub"]

    defs = (
        hits.filter(F.col("type") == "definition")
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_set("edition_id")).alias("editions"))
        .filter(F.size("editions") >= 2)
        .select(
            "query_id", F.lit("TC-001").alias("rule_id"), F.lit("high").alias("severity"),
            F.lit(DEFINITIONS_LABEL).alias("concept"), "editions", F.lit(1).alias("seq"), F.lit("").alias("ord"), F.lit(0).alias("sub"),
        )
    )
    first_year = F.min("year").alias("first_year")
    spans = statuses.groupBy("concept_id").agg(
        first_year,
        F.array_sort(F.collect_list(F.when(F.col("status") == "renamed", F.struct("year", "edition_id")))).alias("renamed"),
    )
    linked = (
        asked.select("query_id", "edition_hint")
        .join(matches, "query_id")
        .join(concepts, "concept_id")
        .join(spans, "concept_id", "left")
    )
    place = F.format_string("%012d", "concept_ord") if "concept_ord" in concepts.columns else F.col("concept_id")
    key = place.alias("ord")
    gone = linked.filter(F.col("last_edition").isNotNull()).select(
        "query_id", F.lit("TC-002").alias("rule_id"), F.lit("medium").alias("severity"), F.col("name_ko").alias("concept"),
        F.array("first_edition", "last_edition").alias("editions"), F.lit(2).alias("seq"), key, F.lit(0).alias("sub"),
    )
    newer = linked.filter(hint_year(F.col("edition_hint"), editions) < F.col("first_year")).select(
        "query_id", F.lit("TC-003").alias("rule_id"), F.lit("medium").alias("severity"), F.col("name_ko").alias("concept"),
        F.array("first_edition").alias("editions"), F.lit(2).alias("seq"), key, F.lit(1).alias("sub"),
    )
    renamed = linked.filter(F.size("renamed") > 0).select(
        "query_id", F.lit("TC-004").alias("rule_id"), F.lit("low").alias("severity"), F.col("name_ko").alias("concept"),
        F.transform("renamed", lambda r: r["edition_id"]).alias("editions"), F.lit(3).alias("seq"), key, F.lit(0).alias("sub"),
    )
    texts = asked.select("query_id", F.lower("text").alias("low"))
    names = known.select("ord", F.explode(F.array(F.lower("concept"), "concept_id")).alias("needle")).distinct()
    named = contains_join(texts, "low", names, "needle").select("query_id", "ord").distinct()
    seen = hits.groupBy("query_id").agg(F.collect_set("edition_id").alias("seen"))
    listed = (
        named.join(known, "ord")
        .join(seen, "query_id")
        .filter(F.size(F.array_intersect("seen", "editions")) >= 2)
        .select(
            "query_id", F.lit("TC-001").alias("rule_id"), F.lit("high").alias("severity"), "concept", "editions",
            F.lit(4).alias("seq"), F.format_string("%012d", F.col("ord").cast("long")).alias("ord"), F.lit(0).alias("sub"),
        )
    )
    every = defs
    for part in (gone, newer, renamed, listed):
        every = every.unionByName(part.select(*cols))
    order = ["seq", "ord", "sub"]
    once = Window.partitionBy("query_id", "rule_id", "concept").orderBy(*order)
    unique = every.withColumn("rn", F.row_number().over(once)).filter("rn = 1")
    cap = Window.partitionBy("query_id").orderBy(*order)
    return (
        unique.withColumn("warning_no", F.row_number().over(cap))
        .filter(F.col("warning_no") <= max_warnings)
        .drop("rn", "seq", "ord", "sub")
    )


def comparison_set(hits: DataFrame, queries: DataFrame, matches: DataFrame, concepts: DataFrame, statuses: DataFrame, max_editions: int = 0, max_chars: int = 500) -> DataFrame:
    """Per query: edition groups in time order, totals, and the first matching concept."""
    groups = group_by_edition(hits, max_chars, max_editions)
    per = groups.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "edition_id", "year", "hit_count", "definition_texts", "other_texts"))).alias("groups"),
        F.count(F.lit(1)).alias("edition_count"),
    )
    totals = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("total_hits"))
    first = matches.groupBy("query_id").agg(F.min("concept_id").alias("concept_id"))
    summary = evolution_summary(concepts, statuses).select("concept_id", "name_ko", "modified_count", "is_active", "history")
    return (
        queries.select("query_id")
        .join(per, "query_id", "left")
        .join(totals, "query_id", "left")
        .join(first.join(summary, "concept_id"), "query_id", "left")
        .withColumn("edition_count", F.coalesce("edition_count", F.lit(0)))
        .withColumn("total_hits", F.coalesce("total_hits", F.lit(0)))
    )


def order_checks(hits: DataFrame) -> DataFrame:
    """Per query: are hits newest first / oldest first, several editions, first hit newest."""
    w = Window.partitionBy("query_id").orderBy("rank")
    prev = F.lag("sort_key").over(w)
    return (
        hits.withColumn("prev", prev)
        .groupBy("query_id")
        .agg(
            F.bool_and(F.col("prev").isNull() | (F.col("sort_key") <= F.col("prev"))).alias("latest_first_order"),
            F.bool_and(F.col("prev").isNull() | (F.col("sort_key") >= F.col("prev"))).alias("chronological_order"),
            (F.count_distinct("edition_id") >= 2).alias("multi_edition"),
            (F.min_by("sort_key", "rank") == F.max("sort_key")).alias("first_hit_is_latest"),
        )
    )


def hint_checks(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Per row of ``queries(query_id, hint)``: does a hit's edition contain the hint.

    A query without hits, or with a null hint, does not match.
    """
    editions = hits.select("query_id", "edition_id").distinct()
    met = F.coalesce(F.bool_or(F.contains(F.col("edition_id"), F.col("hint"))), F.lit(False))
    return queries.join(editions, "query_id", "left").groupBy("query_id", "hint").agg(met.alias("edition_filter_ok"))
