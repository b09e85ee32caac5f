"""Rule-based quote types and quality flags as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import values as V
from . import text as T


def _plus(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0))


def rule_score(text: Column, rule: dict) -> Column:
    """+2 per pattern found and +1 per keyword; per-line rules give +2 per line."""
    if rule.get("per_line"):
        hit = lambda line: reduce(
            lambda a, b: a | b, [T.matches(T.strip(line), p) for p in rule["patterns"]]
        )
        return F.size(F.filter(T.lines_with_ends(text), hit)) * 2
    return _plus(
        [T.matches(text, p).cast("int") * 2 for p in rule["patterns"]]
        + [F.contains(text, F.lit(k)).cast("int") for k in rule["keywords"]]
    )


def quote_type(text: Column, rules: list[dict] = V.TYPE_RULES) -> Column:
    """First rule, in priority order, that reaches its minimum score."""
    out = F.lit("narrative")
    for rule in reversed(rules):
        out = F.when(rule_score(text, rule) >= rule["min_score"], F.lit(rule["name"])).otherwise(out)
    return out


def quality_flags(text: Column, rules: list[tuple] = V.FLAG_RULES) -> Column:
    flags = []
    for name, kind, what in rules:
        if kind == "contains":
            cond = reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in what])
        else:
            cond = T.matches(text, what)
        flags.append(F.when(cond, F.lit(name)))
    return F.array_compact(F.array(*flags))


def has_no_flag(flags: Column, banned: list[str] = V.EXCLUDED_FLAGS) -> Column:
    return ~F.arrays_overlap(flags, F.array(*[F.lit(b) for b in banned]))
