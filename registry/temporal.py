"""Query understanding, edition policies and change detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratatext import values as V
from stratatext.functions import classify as CL
from stratatext.functions import editions as E
from stratatext.operators import bm25, lookup, policy, temporal
from stratatext.operators import textjoin as TJ
from stratatext.plans import retrieve as RT
from stratatext.session import stored

from . import common as C
from .common import CTES, sql

QUERIES, SQL = {}, {}


def query(name: str, text: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if text:
            SQL[name] = text
        return fn

    return add


# Questions made from the user turns: a template by turn number around the first word.
TEMPLATES = [
    "{w}란 무엇인가?", "초판에서 {w}의 범위는?", "{w} 개념이 초판에서 14차까지 어떻게 변화했는가?", "10차 개정판에서 {w} 설명",
    "현행 {w} 내용", "1998년과 2020년 {w} 비교", "{w} 카드 5장 만들어줘", "2004년에서 {w}", "{w}의 역할은?", "what is {w}",
    "{w} 설명", "11차와 14차의 {w}", "{w}가 처음 도입된 시점", "{w}의 뜻은", "퀴즈 30문제 {w}", "   ",
]
N = len(TEMPLATES)
CTES["ask"] = ([], f"""SELECT conv_id * 1000 + turn AS query_id, replace(list_extract([{', '.join("'" + t + "'" for t in TEMPLATES)}], CAST((conv_id + turn) % {N} AS INT) + 1), '{{w}}', regexp_extract(text, '[A-Za-z]+', 0)) AS text,
    list_extract(['specific_time','general_definition','evolution_comparison','content_generation','open_ended'], CAST(conv_id % 5 AS INT) + 1) AS intent,
    list_extract(['summary','card','comparison_table','quiz','slide'], CAST(turn % 5 AS INT) + 1) AS output_type FROM conversations""")


def ask(spark, sf):
    k = (F.col("conv_id") + F.col("turn")) % N
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), i.cast("int") + 1)
    return C.read(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        F.replace(pick(TEMPLATES, k), F.lit("{w}"), F.regexp_extract("text", "[A-Za-z]+", 0)).alias("text"),
        pick(["specific_time", "general_definition", "evolution_comparison", "content_generation", "open_ended"], F.col("conv_id") % 5).alias("intent"),
        pick(["summary", "card", "comparison_table", "quiz", "slide"], F.col("turn") % 5).alias("output_type"),
    )


def _list(col, pats):
    return " OR ".join(f"regexp_matches({col}, '{p}')" for p in pats)


_HINT = """CASE WHEN regexp_extract(t, '([0-9]{1,2})차', 1) <> '' THEN coalesce(CASE regexp_extract(t, '([0-9]{1,2})차', 1) WHEN '1' THEN '1981-1차' WHEN '10' THEN '1998-10차' WHEN '11' THEN '2004-11차' WHEN '12' THEN '2008-12차' WHEN '13' THEN '2016-13차' WHEN '14' THEN '2020-14차' END, regexp_extract(t, '([0-9]{1,2})차', 1) || '차')
  WHEN contains(t, '초판') THEN '1979-초판' WHEN regexp_extract(t, '(19[7-9][0-9]|20[0-2][0-9])년', 1) <> '' THEN CASE regexp_extract(t, '(19[7-9][0-9]|20[0-2][0-9])년', 1) WHEN '1979' THEN '1979-초판' WHEN '1981' THEN '1981-1차' WHEN '1998' THEN '1998-10차' WHEN '2004' THEN '2004-11차' WHEN '2008' THEN '2008-12차' WHEN '2016' THEN '2016-13차' WHEN '2020' THEN '2020-14차' END END"""
_KW = " OR ".join(f"contains(t, '{k}')" for k in V.CROSS_KEYWORDS)
CTES["classed"] = (["ask"], f"""SELECT *, CASE WHEN t = '' THEN 'open_ended' WHEN kw OR multi THEN 'cross_version' WHEN single OR contains(t, '현행') THEN 'single_version' WHEN def OR def2 THEN 'definition' ELSE 'open_ended' END AS query_type,
    CASE WHEN t = '' THEN 0.5 WHEN kw AND multi THEN 0.95 WHEN kw AND regexp_matches(t, '{V.FIRST_SEEN}') THEN 0.9 WHEN kw THEN 0.85 WHEN multi THEN 0.8 WHEN single THEN 0.9 WHEN contains(t, '현행') THEN 0.85 WHEN def THEN 0.9 WHEN def2 THEN 0.85 ELSE 0.7 END AS confidence,
    CASE WHEN t = '' OR kw OR multi THEN NULL WHEN single THEN {_HINT} WHEN contains(t, '현행') THEN '2020-14차' END AS edition_hint
  FROM (SELECT *, {_KW} AS kw, regexp_matches(t, '{V.MULTI_EDITION}') AS multi,
      {_list('t', [p.replace('{corpus}', '') for p in V.SINGLE_EDITION])} AS single,
      {_list('t', V.DEFINITION_QUERY)} AS def, regexp_matches(t, '{V.DEFINITION_QUERY_SIMPLE}') AS def2 FROM (SELECT *, trim(text) AS t FROM ask))""")


@query("query_classification", sql("SELECT query_id, query_type, CAST(confidence AS DOUBLE) AS confidence, edition_hint FROM classed", "classed"))
def query_classification(spark, sf):
    return ask(spark, sf).select("query_id", CL.classify_query(F.col("text")).alias("c")).select(
        "query_id", "c.query_type", "c.confidence", "c.edition_hint")


_TYPE = "CASE intent WHEN 'specific_time' THEN 'single_version' WHEN 'general_definition' THEN 'definition' WHEN 'evolution_comparison' THEN 'cross_version' ELSE 'open_ended' END"


@query("classification_accuracy", sql(f"""SELECT coalesce(e, '*') AS query_type, count(*) AS total, CAST(sum(CAST(e = p AS INT)) AS BIGINT) AS correct, round(avg(CAST(e = p AS INT)), 6) AS accuracy
    FROM (SELECT {_TYPE} AS e, query_type AS p FROM classed) GROUP BY e UNION ALL SELECT '*', count(*), CAST(sum(CAST({_TYPE} = query_type AS INT)) AS BIGINT), round(avg(CAST({_TYPE} = query_type AS INT)), 6) FROM classed""", "classed"))
def classification_accuracy(spark, sf):
    rows = ask(spark, sf).select(
        CL.intent_to_type(F.col("intent")).alias("expected"), CL.classify_query(F.col("text"))["query_type"].alias("predicted"))
    return CL.accuracy(rows).withColumn("accuracy", F.round("accuracy", 6))


@query("misclassified_queries", sql(f"SELECT query_id, {_TYPE} AS expected, query_type AS predicted FROM classed WHERE {_TYPE} <> query_type", "classed"))
def misclassified_queries(spark, sf):
    return ask(spark, sf).select(
        "query_id", CL.intent_to_type(F.col("intent")).alias("expected"), CL.classify_query(F.col("text"))["query_type"].alias("predicted")
    ).filter("expected <> predicted")


_ED = {r: e for e, y, r in V.EDITIONS}


@query("edition_hints", sql("SELECT query_id, array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN list_contains(f, '{e.split('-')[1]}') OR list_contains(f, '{y}') THEN '{e}' END" for e, y, r in sorted(V.EDITIONS, key=lambda x: x[2])
) + "], lambda x: x IS NOT NULL), ',') AS hints FROM (SELECT query_id, list_transform(regexp_extract_all(text, '([0-9]+) *차', 1), lambda n: n || '차') || CASE WHEN contains(text, '초판') THEN ['초판'] ELSE [] END || regexp_extract_all(text, '([0-9]{4}) *년', 1) AS f FROM ask)", "ask"))
def edition_hints(spark, sf):
    return ask(spark, sf).select("query_id", F.array_join(E.hints_in(F.col("text")), ",").alias("hints"))


@query("requested_counts", sql("""SELECT query_id, CAST(c AS INT) AS n, CAST(CASE WHEN intent <> 'content_generation' THEN 8 WHEN output_type IN ('card', 'quiz') THEN greatest(8, c * 3) WHEN output_type = 'slide' THEN greatest(8, c * 2) WHEN output_type = 'comparison_table' THEN 12 ELSE 8 END AS INT) AS top_k
    FROM (SELECT *, CASE WHEN regexp_extract(text, '([0-9]+) *(장|개|매|건|문제|문항|슬라이드|페이지)', 1) <> '' THEN least(20, CAST(regexp_extract(text, '([0-9]+) *(장|개|매|건|문제|문항|슬라이드|페이지)', 1) AS INT)) ELSE 3 END AS c FROM ask)""", "ask"))
def requested_counts(spark, sf):
    t = F.col("text")
    return ask(spark, sf).select("query_id", CL.requested_count(t).alias("n"), CL.dynamic_top_k(F.col("intent"), F.col("output_type"), t, 8).alias("top_k"))


@query("policy_columns", sql("""SELECT query_id, intent IN ('general_definition', 'open_ended', 'content_generation') AS latest_first,
    CASE WHEN intent IN ('general_definition', 'open_ended', 'content_generation') THEN coalesce(f, '2020-14차') WHEN intent = 'evolution_comparison' THEN NULL ELSE coalesce(f, CASE WHEN edition_hint <> '' THEN edition_hint END) END AS edition_filter,
    CASE WHEN intent IN ('general_definition', 'open_ended', 'content_generation') THEN '2016-13차,2008-12차' ELSE '' END AS fallbacks, CASE WHEN intent IN ('general_definition', 'open_ended', 'content_generation') THEN 2 ELSE 0 END AS min_hits
    FROM (SELECT *, CASE WHEN query_id % 7 = 0 THEN '1998-10차' END AS f FROM classed)""", "classed"))
def policy_columns(spark, sf):
    q = ask(spark, sf).withColumn("edition_hint", CL.classify_query(F.col("text"))["edition_hint"]).withColumn(
        "edition_filter", F.when(F.col("query_id") % 7 == 0, F.lit("1998-10차")))
    out = CL.resolve_edition_hint(CL.apply_policy(q))
    return out.select("query_id", "latest_first", "edition_filter", F.array_join("fallback_editions", ",").alias("fallbacks"), "min_hits")


@query("hint_resolution", sql("SELECT query_id, h AS hint, CASE " + " ".join(f"WHEN contains('{e}', h) THEN '{e}'" for e, _, _ in V.EDITIONS) + " END AS edition_id FROM (SELECT query_id, CAST(1975 + query_id % 50 AS VARCHAR) AS h FROM ask)", "ask"))
def hint_resolution(spark, sf):
    h = (F.col("query_id") % 50 + 1975).cast("string")
    return ask(spark, sf).select("query_id", h.alias("hint"), E.resolve_hint(h).alias("edition_id"))


@query("edition_id_parts", sql("""SELECT query_id, e AS edition_id, CAST(coalesce(CASE WHEN regexp_extract(e, '([0-9]+)차', 1) <> '' THEN CAST(regexp_extract(e, '([0-9]+)차', 1) AS INT) WHEN e = '1979-초판' THEN 0 END, CAST(left(e, 4) AS INT)) AS INT) AS sort_key, CAST(left(e, 4) AS INT) AS year,
    left(e, 4) || '' AS y4, CASE WHEN split_part(e, '-', 2) = '초판' THEN '초판(' || left(e, 4) || ')' ELSE split_part(e, '-', 2) || ' 개정판(' || left(e, 4) || ')' END AS display
    FROM (SELECT query_id, CAST(1979 + query_id % 40 AS VARCHAR) || '-' || CASE WHEN query_id % 9 = 0 THEN '초판' ELSE CAST(query_id % 9 AS VARCHAR) || '차' END AS e FROM ask)""", "ask"))
def edition_id_parts(spark, sf):
    k = F.col("query_id") % 9
    e = F.concat((F.col("query_id") % 40 + 1979).cast("string"), F.lit("-"), F.when(k == 0, "초판").otherwise(F.concat(k.cast("string"), F.lit("차"))))
    return ask(spark, sf).select("query_id", e.alias("edition_id")).select(
        "query_id", "edition_id", E.sort_key(F.col("edition_id")).alias("sort_key"), E.year_of(F.col("edition_id")).alias("year"),
        F.substring("edition_id", 1, 4).alias("y4"), E.display_name(F.col("edition_id")).alias("display"))


@query("filter_sanitising", r"""SELECT page_id, CASE WHEN regexp_matches(v, '^[\p{L}\p{M}\p{N}_\-.\s]{1,50}$') THEN v END AS edition_filter, CASE WHEN len(ts) > 0 THEN array_to_string(ts, ',') END AS types
    FROM (SELECT page_id, trim(regexp_extract(html, '<title>(.*?)</title>', 1)) AS v, list_filter(['definition', CASE WHEN page_id % 2 = 0 THEN 'principle' ELSE 'bogus' END, url], lambda t: t IN ('definition', 'principle', 'procedure', 'checklist', 'example', 'narrative') AND NOT (page_id % 3 = 0)) AS ts FROM pages)""")
def filter_sanitising(spark, sf):
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    types = F.array(F.when(F.col("page_id") % 3 == 0, "none").otherwise("definition"),
                    F.when(F.col("page_id") % 3 == 0, "none").when(F.col("page_id") % 2 == 0, "principle").otherwise("bogus"), F.col("url"))
    return C.read(spark, sf, "pages").select("page_id", CL.safe_edition(title).alias("edition_filter"), F.array_join(CL.safe_types(types), ",").alias("types"))


# -- policies over hits ------------------------------------------------------------

EDS = [(f"src{i}", 1979 + i, i) for i in range(20)]
POLICY = dict(V.POLICY, primary_edition="src19", fallback_editions=["src18", "src17"], min_hits=4)
_INTENT = "list_extract(['general_definition', 'evolution_comparison', 'specific_time', 'open_ended'], CAST(query_id % 4 AS INT) + 1)"


def intents(spark, sf):
    q = F.col("query_id")
    pick = F.element_at(F.array(*[F.lit(x) for x in ("general_definition", "evolution_comparison", "specific_time", "open_ended")]), (q % 4).cast("int") + 1)
    return C.benchmark_queries(spark, sf).withColumn("intent", pick).withColumn("edition_hint", F.concat(F.lit("src"), (q % 20).cast("string")))


_CASCADE = """, st AS (SELECT query_id, unnest(range(len(ch))) AS stage, unnest(ch) AS ed, len(ch) AS n FROM (SELECT query_id, CASE WHEN intent IN ('general_definition', 'open_ended') THEN ['src19', 'src18', 'src17', NULL] WHEN intent = 'specific_time' THEN [hint] ELSE [NULL] END AS ch
        FROM (SELECT query_id, """ + _INTENT + """ AS intent, list_extract([""" + ", ".join(f"CASE WHEN contains('src{i}', 'src' || CAST(query_id % 20 AS VARCHAR)) THEN 'src{i}' END" for i in range(0)) + """NULL], 1) AS x, 'src' || CASE WHEN query_id % 20 = 1 THEN '1' ELSE CAST(query_id % 20 AS VARCHAR) END AS hint FROM qsrc))),
      rk AS (SELECT s.query_id, st.stage, st.n, s.id, s.edition_id, s.score, row_number() OVER (PARTITION BY s.query_id, st.stage ORDER BY s.score DESC, s.o1, s.o2) AS rank FROM (SELECT a.*, c.edition_id FROM {scores} a JOIN {corpus} c USING (id)) s JOIN st ON st.query_id = s.query_id AND (st.ed IS NULL OR st.ed = s.edition_id))"""


@query("edition_fallback", sql(_CASCADE.format(scores="qq_scores", corpus="qcsrc") + """
      SELECT query_id, CAST(stage AS INT) AS stage, id, CAST(rank AS INT) AS rank FROM rk JOIN (SELECT query_id, min(stage) AS stage FROM (SELECT query_id, stage, n, count(*) AS c FROM rk WHERE rank <= 6 GROUP BY ALL) WHERE c >= 4 OR stage = n - 1 GROUP BY 1) USING (query_id, stage) WHERE rank <= 6""", "qq_scores", "qcsrc", "qsrc"))
def edition_fallback(spark, sf):
    corpus = C.quote_corpus(C.quotes(spark, sf))
    asked = CL.resolve_edition_hint(CL.apply_policy(intents(spark, sf), POLICY), EDS)
    index = bm25.build_index(corpus, carry=["edition_id"])
    scored = stored(bm25.scores(index, asked.select("query_id", "text"), top=6, per="edition_id"), "scores")
    return policy.fallback_search(scored, asked, 6).select("query_id", "stage", "id", "rank")


@query("retrieve_quotes", sql(_CASCADE.format(scores="d_scores", corpus="csrc") + """,
      ch AS (SELECT rk.* FROM rk JOIN (SELECT query_id, min(stage) AS stage FROM (SELECT query_id, stage, n, count(*) AS c FROM rk WHERE rank <= 6 GROUP BY ALL) WHERE c >= 4 OR stage = n - 1 GROUP BY 1) USING (query_id, stage) WHERE rank <= 6),
      o AS (SELECT *, """ + _INTENT + """ AS intent, CAST(regexp_extract(edition_id, '([0-9]+)', 1) AS INT) AS sk FROM ch)
      SELECT query_id, id, edition_id, round(0.4::DOUBLE / (60 + rank), 9) AS score, intent, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE intent WHEN 'specific_time' THEN 0 WHEN 'evolution_comparison' THEN sk ELSE -sk END, rank) AS INT) AS rank FROM o""", "d_scores", "csrc", "qsrc"))
def retrieve_quotes(spark, sf):
    corpus = C.document_corpus(spark, sf)
    hits = RT.retrieve(intents(spark, sf), corpus, bm25.build_index(corpus, carry=["edition_id"]), 6, editions=EDS, policy=POLICY)
    return hits.select("query_id", "id", "edition_id", F.round("score", 9).alias("score"), "intent", "rank")


@query("retrieve_hybrid")
def retrieve_hybrid(spark, sf):
    """Both sides, policies, coverage of two compared editions per evolution query."""
    from .search import vector_corpus, vector_queries

    corpus = C.document_corpus(spark, sf)
    vec = vector_corpus(spark, sf).join(corpus.select("id", "edition_id"), "id")
    asked = intents(spark, sf)
    need = asked.filter("intent = 'evolution_comparison'").select(
        "query_id", F.posexplode(F.array(*[F.concat(F.lit("src"), ((F.col("query_id") * k + k) % 20).cast("string")) for k in (1, 3)])).alias("ord", "edition_id"))
    hits = RT.retrieve(asked, corpus, bm25.build_index(corpus, carry=["edition_id"]), 6, vec, vector_queries(spark, sf), EDS, POLICY, score_threshold=0.1, required=need)
    return hits.select("query_id", "rank", "id", "edition_id", F.round("score", 9).alias("score"), "source", "intent")


@query("coverage_repair", sql(
    """, e AS (SELECT r.query_id, r.id, r.rank, c.edition_id FROM d_ranked r JOIN csrc c USING (id)),
     h AS (SELECT * FROM e WHERE rank <= 5),
     b AS (SELECT query_id, edition_id, arg_min(id, rank) AS id FROM e GROUP BY 1, 2),
     need AS (SELECT item_id AS query_id, k AS ord, 'src' || ((item_id + o) % 20) AS edition_id FROM benchmark, (VALUES (0, 0), (1, 7), (2, 13)) v(k, o)),
     extra AS (SELECT n.query_id, b.id, n.edition_id, n.ord FROM need n JOIN b USING (query_id, edition_id) ANTI JOIN h USING (query_id, edition_id)),
     p AS (SELECT *, row_number() OVER (PARTITION BY query_id, edition_id ORDER BY rank) AS p, min(rank) OVER (PARTITION BY query_id, edition_id) AS f FROM h),
     o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p = 1, p DESC, CASE WHEN p = 1 THEN -rank ELSE f END) AS away, count(*) OVER (PARTITION BY query_id) AS n,
             (SELECT count(*) FROM extra x WHERE x.query_id = p.query_id) AS m FROM p),
     u AS (SELECT query_id, id, edition_id, 0 AS kind, rank AS pos FROM o WHERE m = 0 OR away > n + m - 5 UNION ALL SELECT query_id, id, edition_id, 1, ord FROM extra)
     SELECT * FROM (SELECT query_id, id, edition_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY kind, pos) AS INT) AS rank FROM u) WHERE rank <= 5""", "d_ranked"))
def coverage_repair(spark, sf):
    corpus = C.document_corpus(spark, sf)
    scored = bm25.scores(bm25.build_index(corpus, carry=["edition_id"]), C.benchmark_queries(spark, sf), top=5, per="edition_id")
    scored = stored(scored, "scores")
    hits = bm25.top_k(scored, 5)
    from pyspark.sql import Window
    w = Window.partitionBy("query_id", "edition_id").orderBy(F.desc("score"), "ord")
    best = scored.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("query_id", "id", "edition_id")
    need = C.benchmark_queries(spark, sf).select("query_id", F.posexplode(F.array(*[F.concat(F.lit("src"), ((F.col("query_id") + k) % 20).cast("string")) for k in (0, 7, 13)])).alias("ord", "edition_id"))
    return policy.ensure_coverage(hits, best, need, 5)


# -- changes between editions --------------------------------------------------------


@query("edition_groups", sql(
    """SELECT query_id, edition_id, CAST(arg_min(year, rank) AS INT) AS year, count(*) AS hit_count, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sort_key) AS INT) AS ord,
       sha256(coalesce(string_agg(left(text, 120), '#' ORDER BY rank) FILTER (WHERE type = 'definition'), '')) AS defs, sha256(coalesce(string_agg(left(text, 120), '#' ORDER BY rank) FILTER (WHERE type <> 'definition'), '')) AS others
       FROM hits GROUP BY query_id, edition_id, sort_key""", "hits"))
def edition_groups(spark, sf):
    hits, _ = C.quote_hits(spark, sf)
    g = temporal.group_by_edition(hits, 120)
    return g.select("query_id", "edition_id", "year", "hit_count", "ord", F.sha2(F.array_join("definition_texts", "#"), 256).alias("defs"), F.sha2(F.array_join("other_texts", "#"), 256).alias("others"))


@query("definition_conflicts", sql(
    """SELECT query_id, count(DISTINCT edition_id) FILTER (WHERE type = 'definition') >= 2 AS has_conflict, count(*) FILTER (WHERE type = 'definition') AS definition_count,
       coalesce((SELECT string_agg(edition_id, ',' ORDER BY sort_key) FROM (SELECT DISTINCT edition_id, sort_key FROM hits h2 WHERE h2.query_id = h.query_id AND type = 'definition')), '') AS editions FROM hits h GROUP BY query_id""", "hits"))
def definition_conflicts(spark, sf):
    hits, _ = C.quote_hits(spark, sf)
    return temporal.definition_conflicts(hits).select("query_id", "has_conflict", "definition_count", F.array_join("conflicting_editions", ",").alias("editions"))


@query("cross_edition_terms", sql(
    """SELECT term, count(*) AS edition_count, CAST(sum(n) AS BIGINT) AS quote_count, string_agg(edition_id, ',' ORDER BY edition_id) AS editions FROM (
       SELECT term, edition_id, count(*) AS n FROM (SELECT edition_id, quote_id, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{3,6}'))) AS term FROM quotes WHERE type = 'definition') WHERE term NOT IN ('That', 'This') GROUP BY ALL) GROUP BY term HAVING count(*) >= 2""", "quotes"))
def cross_edition_terms(spark, sf):
    t = temporal.cross_edition_terms(C.quotes(spark, sf), "[A-Z][a-z]{3,6}", ["That", "This"])
    return t.withColumn("editions", F.array_join("editions", ","))


# Concepts are part names, editions their shipping years.
CTES["st0"] = ([], "SELECT p_name AS name, year(l_shipdate) AS y, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL")
CTES["statuses"] = (["st0"], """SELECT replace(name, ' ', '_') AS concept_id, name, 'y' || y AS edition_id, CAST(y AS INT) AS year, n,
    CASE WHEN y = min(y) OVER (PARTITION BY name) THEN 'introduced' WHEN r * 20 > n * 9 THEN 'renamed' WHEN q * 4 > n * 102 THEN 'modified' ELSE 'maintained' END AS status FROM st0""")
CTES["concepts"] = (["statuses"], """SELECT concept_id, any_value(name) AS name_ko, upper(any_value(name)) AS name_en, split_part(any_value(name), ' ', 1) AS category, arg_min(edition_id, year) AS first_edition,
    CASE WHEN arg_max(n, year) % 2 = 1 THEN arg_max(edition_id, year) END AS last_edition FROM statuses GROUP BY concept_id""")


def timeline(spark, sf):
    from pyspark.sql import Window

    li = C.read(spark, sf, "lineitem").select("l_partkey", "l_shipdate", "l_returnflag", "l_quantity")
    names = C.read(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name"))
    per_part = li.groupBy("l_partkey", F.year("l_shipdate").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"), F.sum(F.col("l_quantity").cast("long")).alias("q"))
    by_year = per_part.join(names, "l_partkey").groupBy("name", "year").agg(F.sum("n").alias("n"), F.sum("r").alias("r"), F.sum("q").alias("q"))
    first = F.min("year").over(Window.partitionBy("name"))
    status = F.when(F.col("year") == first, "introduced").when(F.col("r") * 20 > F.col("n") * 9, "renamed").when(F.col("q") * 4 > F.col("n") * 102, "modified").otherwise("maintained")
    rows = stored(by_year.select(
        F.replace("name", F.lit(" "), F.lit("_")).alias("concept_id"), "name", F.concat(F.lit("y"), F.col("year").cast("string")).alias("edition_id"),
        F.col("year").cast("int").alias("year"), "n", status.alias("status"), F.lit("").alias("note")), "statuses")
    concepts = rows.groupBy("concept_id").agg(
        F.first("name").alias("name_ko"), F.upper(F.first("name")).alias("name_en"), F.substring_index(F.first("name"), " ", 1).alias("category"),
        F.min_by("edition_id", "year").alias("first_edition"), F.when(F.max_by("n", "year") % 2 == 1, F.max_by("edition_id", "year")).alias("last_edition"))
    return concepts, rows.drop("name", "n")


@query("concept_evolution", sql(
    """SELECT c.*, c.last_edition IS NULL AS is_active, count(*) AS edition_count, count(*) FILTER (WHERE status = 'introduced') AS introduced_count, count(*) FILTER (WHERE status = 'modified') AS modified_count, count(*) FILTER (WHERE status = 'renamed') AS renamed_count,
       string_agg(edition_id || ':' || status, ',' ORDER BY year) AS history FROM concepts c JOIN statuses s USING (concept_id) GROUP BY ALL""", "concepts", "statuses"))
def concept_evolution(spark, sf):
    e = temporal.evolution_summary(*timeline(spark, sf))
    return e.withColumn("history", F.array_join(F.transform("history", lambda h: F.concat_ws(":", h["edition_id"], h["status"])), ","))


@query("concepts_by_status", sql("SELECT concept_id FROM concepts c WHERE last_edition IS NULL AND EXISTS (SELECT 1 FROM statuses s WHERE s.concept_id = c.concept_id AND edition_id = 'y1997' AND status = 'maintained')", "concepts", "statuses"))
def concepts_by_status(spark, sf):
    c, s = timeline(spark, sf)
    return temporal.concepts_where(c, s, edition="y1997", active=True, status="maintained").select("concept_id")


@query("status_transitions", sql(
    "SELECT source, edition_id AS target, status, count(*) AS concepts FROM (SELECT *, lag(edition_id) OVER (PARTITION BY concept_id ORDER BY year) AS source FROM statuses) WHERE source IS NOT NULL GROUP BY ALL", "statuses"))
def status_transitions(spark, sf):
    return temporal.status_transitions(timeline(spark, sf)[1])


CTES["cq"] = ([], "SELECT item_id AS query_id, text || ' ' || p_name AS text, CAST(1993 + item_id % 5 AS VARCHAR) || '-x' AS edition_hint FROM benchmark JOIN part ON p_partkey = item_id")


def concept_queries(spark, sf):
    names = C.read(spark, sf, "part").select(F.col("p_partkey").alias("query_id"), "p_name")
    return C.benchmark_queries(spark, sf).join(names, "query_id").select(
        "query_id", F.concat_ws(" ", "text", "p_name").alias("text"), F.concat((F.col("query_id") % 5 + 1993).cast("string"), F.lit("-x")).alias("edition_hint"))


@query("concepts_in_queries", sql("SELECT DISTINCT query_id, concept_id FROM cq, concepts WHERE contains(lower(text), lower(name_ko)) OR contains(lower(text), lower(name_en)) OR contains(lower(text), lower(concept_id))", "cq", "concepts"))
def concepts_in_queries(spark, sf):
    return temporal.match_concepts(concept_queries(spark, sf), timeline(spark, sf)[0], "name_in_query")


@query("queries_in_concepts", sql("""SELECT DISTINCT query_id, concept_id FROM (SELECT n_nationkey AS query_id, lower(left(n_name, 2)) AS t FROM nation UNION ALL SELECT p_partkey + 1000, lower(split_part(p_name, ' ', 2)) FROM part) q, concepts c
    WHERE contains(lower(name_ko), t) OR contains(lower(name_en), t) OR contains(lower(concept_id), t)""", "concepts"))
def queries_in_concepts(spark, sf):
    q = C.read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.lower(F.substring("n_name", 1, 2)).alias("text")).unionByName(
        C.read(spark, sf, "part").select((F.col("p_partkey") + 1000).alias("query_id"), F.lower(F.substring_index("p_name", " ", -1)).alias("text")))
    return temporal.match_concepts(q, timeline(spark, sf)[0])


CTES["known"] = ([], "SELECT CAST(min(p_partkey) AS BIGINT) AS ord, p_name AS concept, replace(p_name, ' ', '_') AS concept_id, ['src0', 'src5', 'src10', 'src15', 'src' || CAST(min(p_partkey) % 20 AS VARCHAR)] AS editions FROM part GROUP BY p_name")


def known_conflicts(spark, sf):
    k = F.min("p_partkey")
    return C.read(spark, sf, "part").groupBy(F.col("p_name").alias("concept")).agg(
        k.alias("ord"), F.array(*[F.lit(f"src{i}") for i in (0, 5, 10, 15)], F.concat(F.lit("src"), (k % 20).cast("string"))).alias("editions")
    ).withColumn("concept_id", F.replace("concept", F.lit(" "), F.lit("_")))


@query("temporal_warnings", sql(
    """, m AS (SELECT DISTINCT query_id, concept_id, edition_hint FROM cq, concepts WHERE contains(lower(text), lower(name_ko)) OR contains(lower(text), lower(name_en)) OR contains(lower(text), lower(concept_id))),
     f AS (SELECT concept_id, min(year) AS fy, string_agg(edition_id, ',' ORDER BY year) FILTER (WHERE status = 'renamed') AS rn FROM statuses GROUP BY 1),
     w AS (SELECT query_id, 'TC-001' AS rule_id, 'high' AS severity, '""" + temporal.DEFINITIONS_LABEL + """' AS concept, string_agg(DISTINCT edition_id, ',' ORDER BY edition_id) AS editions, 1 AS seq, '' AS ord, 0 AS sub FROM hits WHERE type = 'definition' AND query_id IN (SELECT query_id FROM cq) GROUP BY query_id HAVING count(DISTINCT edition_id) >= 2
       UNION ALL SELECT query_id, 'TC-002', 'medium', name_ko, first_edition || ',' || last_edition, 2, concept_id, 0 FROM m JOIN concepts USING (concept_id) WHERE last_edition IS NOT NULL
       UNION ALL SELECT query_id, 'TC-003', 'medium', name_ko, first_edition, 2, concept_id, 1 FROM m JOIN concepts USING (concept_id) JOIN f USING (concept_id) WHERE CAST(left(edition_hint, 4) AS INT) < fy
       UNION ALL SELECT query_id, 'TC-004', 'low', name_ko, rn, 3, concept_id, 0 FROM m JOIN concepts USING (concept_id) JOIN f USING (concept_id) WHERE rn IS NOT NULL
       UNION ALL SELECT query_id, 'TC-001', 'high', concept, array_to_string(editions, ','), 4, lpad(CAST(ord AS VARCHAR), 12, '0'), 0 FROM cq, known k WHERE (contains(lower(text), lower(concept)) OR contains(lower(text), concept_id))
         AND len(list_intersect((SELECT list(DISTINCT edition_id) FROM hits h WHERE h.query_id = cq.query_id), editions)) >= 2),
     u AS (SELECT *, row_number() OVER (PARTITION BY query_id, rule_id, concept ORDER BY seq, ord, sub) AS r1 FROM w WHERE query_id IN (SELECT query_id FROM hits))
     SELECT query_id, rule_id, severity, concept, editions, CAST(no AS INT) AS warning_no FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seq, ord, sub) AS no FROM u WHERE r1 = 1) WHERE no <= 3""", "hits", "cq", "concepts", "statuses", "known"))
def temporal_warnings(spark, sf):
    hits = stored(C.quote_hits(spark, sf)[0], "hits")
    concepts, statuses = timeline(spark, sf)
    asked = concept_queries(spark, sf)
    hits = hits.join(asked.select("query_id"), "query_id", "left_semi")
    out = temporal.warnings(hits, asked, temporal.match_concepts(asked, concepts, "name_in_query"), concepts, statuses, known_conflicts(spark, sf))
    return out.withColumn("editions", F.array_join("editions", ","))


@query("comparison_sets", sql(
    """, m AS (SELECT query_id, min(concept_id) AS concept_id FROM cq, concepts WHERE contains(lower(text), lower(name_ko)) OR contains(lower(text), lower(name_en)) OR contains(lower(text), lower(concept_id)) GROUP BY 1),
     g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sort_key) AS ord FROM (SELECT query_id, edition_id, sort_key, count(*) AS n FROM hits GROUP BY ALL))
     SELECT cq.query_id, coalesce((SELECT count(*) FROM g WHERE g.query_id = cq.query_id AND ord <= 4), 0) AS edition_count, coalesce((SELECT count(*) FROM hits h WHERE h.query_id = cq.query_id), 0) AS total_hits,
       (SELECT string_agg(edition_id || '=' || n, ',' ORDER BY ord) FROM g WHERE g.query_id = cq.query_id AND ord <= 4) AS groups, m.concept_id FROM cq LEFT JOIN m USING (query_id)""", "hits", "cq", "concepts"))
def comparison_sets(spark, sf):
    hits = stored(C.quote_hits(spark, sf)[0], "hits")
    concepts, statuses = timeline(spark, sf)
    asked = concept_queries(spark, sf)
    out = temporal.comparison_set(hits, asked, temporal.match_concepts(asked, concepts, "name_in_query"), concepts, statuses, max_editions=4)
    return out.select("query_id", "edition_count", "total_hits", F.array_join(
        F.transform("groups", lambda g: F.concat_ws("=", g["edition_id"], g["hit_count"])), ",").alias("groups"), "concept_id")


@query("hit_order_checks", sql(
    """SELECT query_id, bool_and(p IS NULL OR sort_key <= p) AS latest_first_order, bool_and(p IS NULL OR sort_key >= p) AS chronological_order, count(DISTINCT edition_id) >= 2 AS multi_edition, arg_min(sort_key, rank) = max(sort_key) AS first_hit_is_latest
       FROM (SELECT *, lag(sort_key) OVER (PARTITION BY query_id ORDER BY rank) AS p FROM hits) GROUP BY 1""", "hits"))
def hit_order_checks(spark, sf):
    return temporal.order_checks(C.quote_hits(spark, sf)[0])


@query("hint_matches", sql(
    """SELECT item_id AS query_id, 'src' || (item_id % 20) AS hint, coalesce((SELECT bool_or(contains(h.edition_id, 'src' || (item_id % 20))) FROM hits h WHERE h.query_id = item_id), false) AS edition_filter_ok FROM benchmark""", "hits"))
def hint_matches(spark, sf):
    hinted = C.benchmark_queries(spark, sf).select("query_id", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")).alias("hint"))
    return temporal.hint_checks(C.quote_hits(spark, sf)[0], hinted)
