"""Identifiers and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def section_key(path: Column) -> Column:
    return F.when(F.size(path) == 0, F.lit("_root")).otherwise(F.array_join(path, ">"))


def quote_id(edition: Column, path: Column, kind: Column, seq: Column) -> Column:
    """``edition|path>path|type|001``; numbers over 999 keep all digits."""
    number = F.when(seq < 1000, F.lpad(seq.cast("string"), 3, "0")).otherwise(seq.cast("string"))
    return F.concat_ws("|", edition, section_key(path), kind, number)


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def content_hash(text: Column, edition: Column, start_line: Column) -> Column:
    return F.sha2(F.concat_ws("|", text, edition, start_line.cast("string")), 256)


def query_key(query: Column, mode: Column, top_k: Column, edition: Column, types: Column) -> Column:
    """32 hex digits over the search parameters as JSON with sorted keys.

    Written with ``", "`` and ``": "`` separators so that equal parameters give
    equal keys across writers.
    """
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    types_json = F.concat(
        F.lit("["), F.array_join(F.transform(F.array_sort(types), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), ", "), F.lit("]")
    )
    body = F.concat(
        F.lit('{"ef": '), quoted(F.coalesce(edition, F.lit(""))),
        F.lit(', "k": '), top_k.cast("string"),
        F.lit(', "m": '), quoted(mode),
        F.lit(', "q": '), quoted(query),
        F.lit(', "tf": '), types_json, F.lit("}"),
    )
    return F.substring(F.sha2(body, 256), 1, 32)


def is_quote_id(value: Column) -> Column:
    """At least four ``|``-separated parts, none blank."""
    parts = F.split(value, r"\|")
    return F.coalesce((F.size(parts) >= 4) & F.forall(parts, lambda p: F.trim(p) != ""), F.lit(False))
