"""Edition ids: year, revision, order, hints and display names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import values as V

Editions = list[tuple[str, int, int]]


def _lookup(key: Column, pairs: list[tuple[str, int]]) -> Column:
    out = F.lit(None).cast("int")
    for known, value in pairs:
        out = F.when(key == known, F.lit(value)).otherwise(out)
    return out


def sort_key(edition_id: Column, editions: Editions = V.EDITIONS) -> Column:
    """Chronological key: known edition, else revision, else year, else 9999."""
    rev = F.regexp_extract(edition_id, r"(\d+)차", 1)
    year = F.regexp_extract(edition_id, r"^(\d{4})", 1)
    return F.coalesce(
        _lookup(edition_id, [(e, r) for e, _, r in editions]),
        F.when(rev != "", rev.cast("int")),
        F.when(year != "", year.cast("int")),
        F.lit(9999),
    )


def year_of(edition_id: Column, editions: Editions = V.EDITIONS) -> Column:
    """Year of an edition; null when the id names none."""
    year = F.regexp_extract(edition_id, r"^(\d{4})", 1)
    return F.coalesce(
        _lookup(edition_id, [(e, y) for e, y, _ in editions]), F.when(year != "", year.cast("int"))
    )


def revision_of(edition_id: Column, editions: Editions = V.EDITIONS) -> Column:
    rev = F.regexp_extract(edition_id, r"(\d+)차", 1)
    return F.coalesce(
        _lookup(edition_id, [(e, r) for e, _, r in editions]),
        F.when(rev != "", rev.cast("int")),
        F.when(F.contains(edition_id, F.lit("초판")), F.lit(0)),
    )


def display_name(edition_id: Column) -> Column:
    """``2020-14차`` -> ``14차 개정판(2020)``, ``1979-초판`` -> ``초판(1979)``."""
    cut = F.locate("-", edition_id)
    year = F.substring_index(edition_id, "-", 1)
    name = edition_id.substr(cut + 1, F.length(edition_id))
    return (
        F.when(cut == 0, edition_id)
        .when(name == "초판", F.concat(name, F.lit("("), year, F.lit(")")))
        .otherwise(F.concat(name, F.lit(" 개정판("), year, F.lit(")")))
    )


def hints_in(text: Column, editions: Editions = V.EDITIONS) -> Column:
    """Distinct editions a text mentions as ``N차``, ``초판`` or ``YYYY년``, oldest first."""
    found = F.concat(
        F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)\s*차"), 1), lambda n: F.concat(n, F.lit("차"))),
        F.when(F.contains(text, F.lit("초판")), F.array(F.lit("초판"))).otherwise(
            F.array().cast("array<string>")
        ),
        F.regexp_extract_all(text, F.lit(r"(\d{4})\s*년"), 1),
    )
    ordered = sorted(editions, key=lambda e: e[2])
    known = []
    for edition, _, _ in ordered:
        year, _, label = edition.partition("-")
        known.append(
            F.when(
                F.array_contains(found, F.lit(label)) | F.array_contains(found, F.lit(year)),
                F.lit(edition),
            )
        )
    return F.array_compact(F.array(*known))


def resolve_hint(hint: Column, editions: Editions = V.EDITIONS) -> Column:
    """First edition, in list order, whose id contains the hint."""
    return F.coalesce(*[F.when(F.contains(F.lit(e), hint), F.lit(e)) for e, _, _ in editions])
