"""Text column helpers: whitespace, lines, tokens, cleaning, JSON extraction."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters str.split()/str.strip() treat as blank, once as a set of
#: characters and once as a regex class valid in Java and RE2.
BLANKS = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
BLANK_CLASS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
#: Line terminators other than a plain newline.
RARE_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
AFTER_BREAK = r"(?<=[\n\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]|\r(?!\n))"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    A one-element transform keeps Catalyst from inlining (and re-evaluating) an
    expensive expression at every use inside nested lambdas.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def rx(pattern: str) -> str:
    """Java form of a Unicode-aware pattern whose ``$`` stops only at ``\\n``."""
    return "(?dU)" + pattern


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(rx(pattern))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def tokens(text: Column) -> Column:
    """Blank-separated tokens, no empty strings."""
    return F.filter(F.split(text, BLANK_CLASS + "+"), lambda t: t != F.lit(""))


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def squash(text: Column) -> Column:
    """Every blank run becomes one space; ends are trimmed."""
    return strip(F.regexp_replace(text, BLANK_CLASS + "+", " "))


def has_rare_break(text: Column) -> Column:
    """Any terminator but ``\\n``: byte searches, far cheaper than a regex scan."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in RARE_BREAKS])


def lines_with_ends(text: Column) -> Column:
    """Lines including their terminators; joining them restores the text.

    The usual case (only ``\\n``) takes the literal split; the look-behind regex
    runs only on texts that hold another terminator.
    """

    def drop_empty_tail(parts: Column) -> Column:
        return F.filter(parts, lambda line: line != F.lit(""))

    def plain(parts: Column) -> Column:
        last = F.size(parts) - 1
        return F.transform(
            parts, lambda line, i: F.when(i < last, F.concat(line, F.lit("\n"))).otherwise(line)
        )

    common = let(F.split(text, "\n"), plain)
    return drop_empty_tail(
        F.when(has_rare_break(text), F.split(text, AFTER_BREAK)).otherwise(common)
    )


def clean_query(text: Column) -> Column:
    """Drop control characters and markup tags, then trim."""
    no_control = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return strip(F.regexp_replace(no_control, r"<[^>]+>", ""))


# fixed values: lines removed from generated text
META_LINES = [
    r"^.*제공(?:된|해주신) (?:\S+ |)컨텍스트.*?(?:분석|검토|확인).*$",
    r"^.*직접적인 (?:원문|내용|근거).*?(?:포함|존재|확인|찾).*$",
    r"^.*(?:더 많은|추가|해당).*?(?:정보가 필요|제공해 주|제공해주).*$",
    r"^.*컨텍스트에서 (?:확인|찾).*$",
    r"^.*만약.*?(?:원문|컨텍스트).*?(?:제공|포함).*$",
    r"^-{3,}$",
    r"^\*?\*?(?:제안|참고|원문에 근거한).*$",
    r"^.*(?:생성 원칙|작성 원칙)에 따라.*$",
    r"^출처:.*$",
]


# fixed values: keys of a JSON reply that hold no text
JSON_LABELS = ["type", "quiz_id", "card_id"]


def json_texts(text: Column) -> Column:
    """The texts of a JSON object in order: string values and strings in list values.

    Null where the text is no object or holds none.
    """
    is_text = lambda v: F.schema_of_variant(v) == "STRING"
    as_text = lambda v: F.try_variant_get(v, "$", "string")

    def texts(entry: Column) -> Column:
        items = F.coalesce(F.try_variant_get(entry["value"], "$", "array<variant>"), F.array().cast("array<variant>"))
        own = F.when(is_text(entry["value"]) & ~entry["key"].isin(JSON_LABELS), F.array(as_text(entry["value"])))
        return F.when(is_text(entry["value"]), F.coalesce(own, F.array().cast("array<string>"))).otherwise(F.transform(F.filter(items, is_text), as_text))

    trimmed = strip(text)
    object_ = F.when(trimmed.startswith("{") & trimmed.endswith("}"), F.from_json(trimmed, "map<string,variant>"))
    found = F.flatten(F.transform(F.map_entries(object_), texts))
    return F.when(F.size(found) > 0, F.array_join(found, "\n"))


def clean_generated(text: Column, drop_lines: list[str] = META_LINES) -> Column:
    """Unwrap code fences and bold, drop meta lines, squeeze blank runs.

    A reply that is a JSON object as a whole becomes its texts.
    """
    bare = F.regexp_replace(text, r"(?s)```(?:\w+)?\s*\n(.*?)```", "$1")
    bare = F.regexp_replace(bare, r"```(?:\w+)?\s*\n?", "")
    out = F.regexp_replace(bare, r"\*\*(.+?)\*\*", "$1")
    for pattern in drop_lines:
        out = F.regexp_replace(out, "(?dm)" + pattern, "")
    return F.coalesce(json_texts(bare), strip(F.regexp_replace(out, r"\n{3,}", "\n\n")))


def fenced_block(text: Column) -> Column:
    """Content of the first code fence (json fence first), else the text."""
    json_at = F.substring_index(text, "```json", 1)
    tail_json = text.substr(F.length(json_at) + 8, F.length(text))
    head = F.substring_index(text, "```", 1)
    tail = text.substr(F.length(head) + 4, F.length(text))
    return (
        F.when(F.contains(text, F.lit("```json")), strip(F.substring_index(tail_json, "```", 1)))
        .when(F.contains(text, F.lit("```")), strip(F.substring_index(tail, "```", 1)))
        .otherwise(strip(text))
    )


def repair_json(text: Column) -> Column:
    """Fix trailing commas and commas missing at line ends."""
    out = F.regexp_replace(text, r",\s*([\]}])", "$1")
    out = F.regexp_replace(out, r'(")\s*\n(\s*")', "$1,\n$2")
    return F.regexp_replace(out, r"\}\s*\n(\s*\{)", "},\n$1")


def strict_json(text: Column) -> Column:
    """The value of a text that is one JSON value and nothing else, else null.

    Spark's parser stops after the first value.  Inside brackets, more values make more
    elements; inside an object, a bracket too many is an error; so both forms are read.
    """
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    alone = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()
    return F.when((F.size(listed) == 1) & alone, F.get(listed, F.lit(0)))


def json_or_repaired(text: Column) -> Column:
    """The first part of a reply that is JSON and nothing else: a json fence, a fence, the text
    from the first brace, the text from the first bracket; then the same parts repaired; else null.
    """
    parts = [
        F.when(F.contains(text, F.lit("```json")), strip(F.get(F.split(F.get(F.split(text, "```json"), F.lit(1)), "```"), F.lit(0)))),
        F.when(F.contains(text, F.lit("```")), strip(F.get(F.split(text, "```"), F.lit(1)))),
        *[F.when(F.contains(text, F.lit(c)), strip(text.substr(F.instr(text, c), F.length(text)))) for c in "{["],
    ]
    parses = lambda c: F.when(strict_json(c).isNotNull(), c)
    return F.coalesce(*[parses(p) for p in parts], *[parses(repair_json(p)) for p in parts])
