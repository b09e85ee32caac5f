"""Query classification, policies and parsed model replies as columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import values as V
from . import editions as E
from . import text as T


def _any(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [T.matches(text, p) for p in patterns], F.lit(False))


def _map(key: Column, pairs: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in pairs.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def query_hint(text: Column) -> Column:
    """Edition a single-edition query names: revision, first edition, or year."""
    rev = F.regexp_extract(text, r"(\d{1,2})차", 1)
    year = F.regexp_extract(text, r"(19[7-9]\d|20[0-2]\d)년", 1)
    return (
        F.when(rev != "", F.coalesce(_map(rev, V.HINT_REVISIONS), F.concat(rev, F.lit("차"))))
        .when(F.contains(text, F.lit("초판")), F.lit("1979-초판"))
        .when(year != "", _map(year, V.HINT_YEARS))
    )


def classify_query(text: Column, corpus: str = "") -> Column:
    """Struct (query_type, confidence, edition_hint, reason).

    First match wins: comparison words or two editions, one named edition, a
    definition question, else open.  ``corpus`` is the name users give the corpus.
    """
    q = T.strip(text)
    keyword = reduce(lambda a, b: a | b, [F.contains(q, F.lit(k)) for k in V.CROSS_KEYWORDS])
    multi = T.matches(q, V.MULTI_EDITION)
    single = _any(q, [p.replace("{corpus}", re.escape(corpus)) for p in V.SINGLE_EDITION])
    current = F.contains(q, F.lit(V.CURRENT_WORD))

    def result(kind: str, confidence: float, reason: str, hint: Column | None = None) -> Column:
        return F.struct(
            F.lit(kind).alias("query_type"),
            F.lit(confidence).alias("confidence"),
            (hint if hint is not None else F.lit(None).cast("string")).alias("edition_hint"),
            F.lit(reason).alias("reason"),
        )

    return (
        F.when(F.coalesce(q, F.lit("")) == "", result("open_ended", 0.5, "empty query"))
        .when(keyword & multi, result("cross_version", 0.95, "comparison word and two editions"))
        .when(keyword & T.matches(q, V.FIRST_SEEN), result("cross_version", 0.90, "first appearance"))
        .when(keyword, result("cross_version", 0.85, "comparison word"))
        .when(multi, result("cross_version", 0.80, "two editions"))
        .when(single, result("single_version", 0.90, "one edition named", query_hint(q)))
        .when(current, result("single_version", 0.85, "current edition", F.lit(V.CURRENT_EDITION)))
        .when(_any(q, V.DEFINITION_QUERY), result("definition", 0.90, "definition question"))
        .when(T.matches(q, V.DEFINITION_QUERY_SIMPLE), result("definition", 0.85, "meaning question"))
        .otherwise(result("open_ended", 0.7, "no pattern"))
    )


def intent_to_type(intent: Column) -> Column:
    return F.coalesce(_map(intent, V.INTENT_TO_TYPE), F.lit("open_ended"))


def accuracy(classified: DataFrame, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """Total, correct and accuracy per expected type and over all (type ``*``)."""
    ok = (F.col(expected) == F.col(predicted)).cast("int")
    per = classified.groupBy(F.col(expected).alias("query_type")).agg(
        F.count(F.lit(1)).alias("total"), F.sum(ok).alias("correct")
    )
    whole = per.agg(F.sum("total").alias("total"), F.sum("correct").alias("correct")).select(
        F.lit("*").alias("query_type"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("correct", F.lit(0)).alias("correct")
    )
    both = per.unionByName(whole)
    return both.withColumn("accuracy", F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(0.0))


def requested_count(text: Column) -> Column:
    n = F.regexp_extract(text, V.COUNT_PATTERN, 1)
    return F.when(n != "", F.least(n.try_cast("long"), F.lit(20))).otherwise(3).cast("int")


def dynamic_top_k(intent: Column, output_type: Column, text: Column, base: int) -> Column:
    """More hits for bulk requests; only for content generation."""
    n = requested_count(text)
    wanted = (
        F.when(output_type.isin("card", "quiz"), n * 3)
        .when(output_type == "slide", n * 2)
        .when(output_type == "comparison_table", F.lit(12))
        .otherwise(F.lit(8))
    )
    return F.when(intent == "content_generation", F.greatest(F.lit(base), wanted)).otherwise(F.lit(base))


def safe_edition(value: Column) -> Column:
    """Trimmed edition filter, or null when empty or not of the allowed shape."""
    v = T.strip(value)
    return F.when(T.matches(v, r"^[\w가-힣\-.\s]{1,50}$"), v)


def safe_types(values: Column, allowed: list[str] = V.QUOTE_TYPES) -> Column:
    kept = F.filter(values, lambda t: t.isin(*allowed))
    return F.when(F.size(kept) > 0, kept)


def apply_policy(queries: DataFrame, policy: dict = V.POLICY) -> DataFrame:
    """Add latest_first, edition_filter, fallback_editions and min_hits per query.

    Latest-first intents: flag on, primary edition unless a filter is set,
    fallbacks attached.  Evolution intents: flag off, no filter.  Others unchanged.
    """
    latest = F.col("intent").isin(*policy["latest_first_intents"])
    evolution = F.col("intent").isin(*policy["evolution_intents"])
    cols = queries.columns
    flag = F.col("latest_first") if "latest_first" in cols else F.lit(False)
    filt = F.col("edition_filter") if "edition_filter" in cols else F.lit(None).cast("string")
    filt = F.when(filt != "", filt)
    none = F.array().cast("array<string>")
    return queries.withColumns(
        {
            "latest_first": F.when(latest, True).when(evolution, False).otherwise(flag),
            "edition_filter": F.when(latest, F.coalesce(filt, F.lit(policy["primary_edition"])))
            .when(evolution, F.lit(None).cast("string"))
            .otherwise(filt),
            "fallback_editions": F.when(
                latest, F.array(*[F.lit(e) for e in policy["fallback_editions"]])
            ).otherwise(none),
            "min_hits": F.when(latest, F.lit(max(policy["min_hits"], 0))).otherwise(0),
        }
    )


def resolve_edition_hint(queries: DataFrame, editions: list = V.EDITIONS) -> DataFrame:
    """Point-in-time queries without a filter take the edition their hint names."""
    timed = (F.col("intent") == "specific_time") & F.col("edition_filter").isNull() & (
        F.coalesce(F.col("edition_hint"), F.lit("")) != ""
    )
    return queries.withColumn(
        "edition_filter",
        F.when(timed, E.resolve_hint(F.col("edition_hint"), editions)).otherwise(F.col("edition_filter")),
    )


# -- model replies -------------------------------------------------------------


def _score(doc: Column, axis: str) -> Column:
    raw = F.try_variant_get(doc, f"$.{axis}", "double")
    return F.when(raw > 0, F.greatest(F.lit(1.0), F.least(F.lit(5.0), raw))).otherwise(0.0)


def judge_scores(reply: Column) -> Column:
    """Struct of the four axis scores; an unreadable reply scores 0 everywhere."""
    doc = T.strict_json(T.fenced_block(reply))
    return F.struct(
        *[F.coalesce(_score(doc, a), F.lit(0.0)).alias(a) for a in V.AXES],
        doc.isNull().alias("unreadable"),
    )


def judge_passed(scores: Column, thresholds: dict[str, float] = V.AXIS_THRESHOLDS) -> Column:
    return reduce(lambda a, b: a & b, [scores[a] >= thresholds.get(a, 3.0) for a in V.AXES])


def parse_route(reply: Column) -> Column:
    """Struct (intent, confidence, edition_hint, output_type, type_filter, section_filter).

    Unreadable replies fall back to open_ended at 0.5; unknown intents become
    open_ended; confidence is clamped to 0..1.
    """
    doc = T.strict_json(T.fenced_block(reply))
    get = lambda field, kind="string": F.try_variant_get(doc, f"$.{field}", kind)
    intent = F.coalesce(get("intent"), get("query_type"), F.lit("open_ended"))
    confidence = F.coalesce(get("confidence", "double"), F.lit(0.5))
    output = get("output_type")
    types = F.filter(get("type_filter", "array<string>"), lambda t: t.isin(*V.QUOTE_TYPES))
    return F.struct(
        F.when(intent.isin(*V.INTENTS), intent).otherwise("open_ended").alias("intent"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)).alias("confidence"),
        get("edition_hint").alias("edition_hint"),
        F.when(output.isin(*V.OUTPUT_TYPES), output).alias("output_type"),
        F.when(F.size(types) > 0, types).alias("type_filter"),
        get("section_filter").alias("section_filter"),
    )
