"""Shared inputs of the registered queries and their SQL building blocks.

Mapping onto the given tables: an edition is a ``source`` (``src7`` has order 7
and year 1986), headers are short lines, quote types and flags follow small rule
tables whose patterns mean the same in Java and RE2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratatext.functions.text import BLANK_CLASS
from stratatext.operators import bm25
from stratatext.operators.quotes import build_quotes
from stratatext.session import broadcast_if_small, spread, stored

HEADER_RULES = [("H1", 1, "^.{1,25}$"), ("H2", 2, "^.{26,45}$"), ("H3", 3, "^.{46,65}$")]
TYPE_RULES = [
    {"name": "definition", "min_score": 2, "patterns": ["^(The|Th|La|Le|Der|Die|El)[a-z]* "], "keywords": []},
    {"name": "example", "min_score": 3, "patterns": ["(ing|ung|ment)[.]"], "keywords": [" que ", " und ", " of ", " que "]},
    {"name": "checklist", "min_score": 4, "per_line": True, "patterns": ["^[A-Z][a-z]+ (the|le|la|der|el|un|und|to|of)"], "keywords": []},
    {"name": "procedure", "min_score": 3, "patterns": ["[a-z]ed, "], "keywords": ["tionti", "enen", "erer", "mentde"]},
    {"name": "principle", "min_score": 2, "patterns": [], "keywords": ["ation", "schen", "qued", "euxle", "ingth"]},
]
FLAG_RULES = [
    ("symbol_noise", "contains", ["%%%", "###", "***"]),
    ("digit_run", "regex", "[0-9]{4}"),
    ("bracketed", "regex", r"\(.*\)"),
]
BANNED = ["symbol_noise"]
MIN_TOKENS = 40


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def read_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The table as a stream, whether it is one file or a folder of files.

    The path is given as a pattern: a plain one is taken for a folder.
    """
    schema = read(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(read(spark, sf, "documents").select("doc_id", F.col("source").alias("edition_id"), "text"), "doc_id")


def written_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that have a text: what the SQL calls ``docs``."""
    return docs(spark, sf).filter("text <> ''")


def edition_order(col) -> "F.Column":
    return F.regexp_extract(col, "([0-9]+)", 1).cast("int")


def quotes(spark: SparkSession, sf: str) -> DataFrame:
    built = build_quotes(
        docs(spark, sf), HEADER_RULES, TYPE_RULES, FLAG_RULES, MIN_TOKENS, split=None, edition_spans_docs=True
    )
    return stored(built, "quotes")


def benchmark_queries(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def short_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The first four words of each benchmark text."""
    return benchmark_queries(spark, sf).select("query_id", F.array_join(F.slice(F.split("text", " "), 1, 4), " ").alias("text"))


def document_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), "text", F.col("source").alias("edition_id"), "lang"
    )


def quote_corpus(qs: DataFrame) -> DataFrame:
    return qs.withColumn("id", F.col("quote_id")).withColumn(
        "ord", F.struct("doc_id", "start_line")
    )


def quote_hits(spark: SparkSession, sf: str, top: int = 8) -> tuple[DataFrame, DataFrame]:
    """(hits with quote attributes, quotes): BM25 top hits of the benchmark texts."""
    qs = quotes(spark, sf)
    corpus = quote_corpus(qs)
    found = stored(bm25.bm25_search(bm25.build_index(corpus), benchmark_queries(spark, sf), top), "found")
    attrs = corpus.select(
        "id", "quote_id", "doc_id", "edition_id", "type", "section_path", "text", "start_line",
        "quality_flags", "sha256", edition_order("edition_id").alias("sort_key"),
        (edition_order("edition_id") + 1979).alias("year"),
    )
    # A few hits go to the quotes, not the quotes' texts through a shuffle.
    return attrs.join(broadcast_if_small(found.drop("ord")), "id"), qs


# -- SQL ------------------------------------------------------------------------

W = BLANK_CLASS



def toks(text: str) -> str:
    return "list_filter(string_split_regex(" + text + ", '" + W + "+'), lambda x: x <> '')"


def _rule_sql(text: str, rule: dict) -> str:
    if rule.get("per_line"):
        cond = " OR ".join(f"regexp_matches(trim(l), '{p}')" for p in rule["patterns"])
        return f"2 * len(list_filter(string_split({text}, chr(10)), lambda l: {cond}))"
    parts = [f"2 * CAST(regexp_matches({text}, '{p}') AS INT)" for p in rule["patterns"]]
    parts += [f"CAST(contains({text}, '{k}') AS INT)" for k in rule["keywords"]]
    return " + ".join(parts) or "0"


def type_sql(text: str) -> str:
    whens = " ".join(f"WHEN {_rule_sql(text, r)} >= {r['min_score']} THEN '{r['name']}'" for r in TYPE_RULES)
    return f"CASE {whens} ELSE 'narrative' END"


def flags_sql(text: str) -> str:
    out = []
    for name, kind, what in FLAG_RULES:
        cond = (
            " OR ".join(f"contains({text}, '{w}')" for w in what) if kind == "contains" else f"regexp_matches({text}, '{what}')"
        )
        out.append(f"CASE WHEN {cond} THEN '{name}' END")
    return f"list_filter([{', '.join(out)}], lambda f: f IS NOT NULL)"


def depth_sql(line: str) -> str:
    return "CASE " + " ".join(
        f"WHEN regexp_matches({line}, '{p}') THEN {d}" for _, d, p in HEADER_RULES
    ) + " END"


CTES: dict[str, tuple[list[str], str]] = {
    "docs": ([], "SELECT doc_id, source AS edition_id, text FROM documents WHERE text <> ''"),
    "lns": (
        ["docs"],
        f"""SELECT doc_id, edition_id, line_no, line, n, {depth_sql('trim(line)')} AS depth
        FROM (SELECT doc_id, edition_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no, len(ls) AS n
              FROM (SELECT doc_id, edition_id, string_split(text, chr(10)) AS ls FROM docs))""",
    ),
    "blocks": (
        ["lns"],
        """SELECT doc_id, edition_id, seg, min(line_no) AS start_line, max(depth) AS depth,
               max(CASE WHEN depth IS NOT NULL THEN trim(line) END) AS title,
               string_agg(line, chr(10) ORDER BY line_no) || CASE WHEN max(line_no) = max(n) THEN '' ELSE chr(10) END AS text
        FROM (SELECT *, sum(CASE WHEN depth IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS seg FROM lns)
        GROUP BY doc_id, edition_id, seg""",
    ),
    "pathed": (
        ["blocks"],
        """SELECT doc_id, edition_id, seg, start_line, depth, text, cs AS char_start,
               list_filter([
                 CASE WHEN l1 IS NOT NULL THEN t1 END,
                 CASE WHEN l2 > coalesce(l1, -1) THEN t2 END,
                 CASE WHEN l3 > coalesce(l1, -1) AND l3 > coalesce(l2, -1) THEN t3 END], lambda p: p IS NOT NULL) AS path,
               len(""" + toks("text") + """) AS token_count
        FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY start_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cs,
                """ + ", ".join(
            f"max(CASE WHEN depth = {d} THEN start_line END) OVER w AS l{d}, last_value(CASE WHEN depth = {d} THEN title END IGNORE NULLS) OVER w AS t{d}"
            for d in (1, 2, 3)
        ) + """
              FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY start_line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        WHERE trim(text, ' ' || chr(10)) <> ''""",
    ),
    "segs": (
        ["pathed"],
        f"""SELECT doc_id, edition_id, isl AS segment_no, min(start_line) AS start_line, CAST(min(char_start) AS BIGINT) AS char_start,
               any_value(path) AS section_path, CAST(sum(token_count) AS BIGINT) AS token_count,
               string_agg(text, '' ORDER BY start_line) AS text
        FROM (SELECT *, sum(CASE WHEN token_count < {MIN_TOKENS} AND path = pp THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start_line) AS isl
              FROM (SELECT *, lag(path) OVER (PARTITION BY doc_id ORDER BY start_line) AS pp FROM pathed))
        GROUP BY doc_id, edition_id, isl""",
    ),
    "quotes0": (["segs"], "SELECT *, " + type_sql("text") + " AS type, " + flags_sql("text") + " AS quality_flags, char_start + length(text) AS char_end FROM segs"),
    "quotes": (
        ["quotes0"],
        """SELECT edition_id || '|' || CASE WHEN len(section_path) = 0 THEN '_root' ELSE array_to_string(section_path, '>') END
                  || '|' || type || '|' || CASE WHEN seq < 1000 THEN lpad(CAST(seq AS VARCHAR), 3, '0') ELSE CAST(seq AS VARCHAR) END AS quote_id,
               doc_id, edition_id, type, section_path, text, char_start, char_end, start_line, token_count, sha256(text) AS sha256, quality_flags,
               CAST(regexp_extract(edition_id, '([0-9]+)', 1) AS INT) AS sort_key
        FROM (SELECT *, row_number() OVER (PARTITION BY edition_id, section_path, type ORDER BY doc_id, start_line) AS seq FROM quotes0)""",
    ),
    "heads": (
        ["lns"],
        "SELECT doc_id, edition_id, line_no AS line, 'H' || depth AS level, depth, trim(line) AS title FROM lns WHERE depth IS NOT NULL",
    ),
    "tocb": (
        ["heads"],
        """SELECT doc_id, edition_id, line, level, depth, title,
               list_filter([edition_id,
                 CASE WHEN l1 IS NOT NULL THEN t1 END,
                 CASE WHEN l2 > coalesce(l1, -1) THEN t2 END,
                 CASE WHEN l3 > coalesce(l1, -1) AND l3 > coalesce(l2, -1) THEN t3 END], lambda p: p IS NOT NULL) AS path
        FROM (SELECT *, """ + ", ".join(
            f"max(CASE WHEN depth = {d} THEN line END) OVER w AS l{d}, last_value(CASE WHEN depth = {d} THEN title END IGNORE NULLS) OVER w AS t{d}"
            for d in (1, 2, 3)
        ) + """
              FROM heads WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    ),
    "qsrc": ([], "SELECT item_id AS query_id, text FROM benchmark"),
    "qshort": ([], "SELECT item_id AS query_id, array_to_string(list_slice(string_split(text, ' '), 1, 4), ' ') AS text FROM benchmark"),
    "csrc": ([], "SELECT doc_id AS id, doc_id AS o1, 0 AS o2, text, 1 AS times, source AS edition_id, lang FROM documents"),
    "qcsrc": (["quotes"], "SELECT quote_id AS id, doc_id AS o1, start_line AS o2, text, 1 AS times, edition_id, type FROM quotes"),
    "qcsrcb": (
        ["quotes"],
        "SELECT quote_id AS id, doc_id AS o1, start_line AS o2, text, CASE type WHEN 'definition' THEN 2 ELSE 1 END AS times, edition_id, type FROM quotes",
    ),
}


def bm25_ctes(prefix: str, corpus: str, queries: str) -> None:
    """Register the CTE chain of a BM25 run as ``{prefix}_scores`` (query_id, id, o1, o2, score)."""
    p = prefix
    CTES[f"{p}_tok"] = ([corpus], f"SELECT id, o1, o2, times, {toks('text')} AS ts FROM {corpus}")
    CTES[f"{p}_len"] = ([f"{p}_tok"], f"SELECT id, len(ts) * times AS dl FROM {p}_tok")
    CTES[f"{p}_post"] = (
        [f"{p}_tok"],
        f"SELECT id, o1, o2, term, times * len(ts) AS dl, count(*) * times AS tf FROM (SELECT id, o1, o2, times, ts, unnest(ts) AS term FROM {p}_tok) GROUP BY id, o1, o2, term, times, len(ts)",
    )
    CTES[f"{p}_term"] = (
        [f"{p}_post", f"{p}_len"],
        f"SELECT term, count(*) AS df, ln((SELECT count(*) FROM {p}_len) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS idf FROM {p}_post GROUP BY term",
    )
    CTES[f"{p}_q"] = (
        [queries, f"{p}_term"],
        f"""SELECT q.query_id, q.term, q.qtf * CASE WHEN t.idf < 0 THEN 0.25 * (SELECT avg(idf) FROM {p}_term) ELSE t.idf END AS weight
        FROM (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({toks('text')}) AS term FROM {queries}) GROUP BY ALL) q
        JOIN {p}_term t USING (term)""",
    )
    CTES[f"{p}_scores"] = (
        [f"{p}_q", f"{p}_post", f"{p}_len"],
        f"""SELECT query_id, id, o1, o2, CAST(sum(CAST(round(weight * tf * 2.5 / (tf + 1.5 * (1 - 0.75::DOUBLE + 0.75 * dl / (SELECT avg(dl) FROM {p}_len))) * 1e12) AS BIGINT)) AS DOUBLE) / 1e12 AS score
        FROM {p}_post JOIN {p}_q USING (term) GROUP BY ALL HAVING score > 0""",
    )
    CTES[f"{p}_ranked"] = (
        [f"{p}_scores"],
        f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, o1, o2) AS rank FROM {p}_scores",
    )


bm25_ctes("d", "csrc", "qsrc")
bm25_ctes("qq", "qcsrc", "qsrc")
bm25_ctes("qb", "qcsrcb", "qsrc")
CTES["hits"] = (
    ["qq_ranked", "quotes"],
    """SELECT r.query_id, r.rank, r.score, q.*, q.sort_key + 1979 AS year
    FROM qq_ranked r JOIN quotes q ON q.quote_id = r.id WHERE r.rank <= 8""",
)


def sql(select: str, *needs: str, **extra: str) -> str:
    """WITH clause holding ``needs`` (and what they need) plus ``extra``, then ``select``."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in CTES[name][0]:
            visit(dep)
        order.append(name)

    for n in needs:
        visit(n)
    mode = " AS MATERIALIZED ("
    parts = [f"{n}{mode}{CTES[n][1]})" for n in order] + [f"{n}{mode}{body})" for n, body in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + select
