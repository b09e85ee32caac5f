"""Keyword, vector and fused retrieval over documents and quotes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stratatext.operators import blockmax, bm25, fusion, ivf, vectors
from stratatext.operators import quotes as QT
from stratatext.plans import search as plan
from stratatext.session import shared_folder, stored
from stratatext.sources import keyed

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


def ranked(df):
    return df.select("query_id", F.col("rank").cast("int").alias("rank"), "id", F.round("score", 6).alias("score"))


RANKED = "query_id, CAST(rank AS INT) AS rank, id, round(score, 6) AS score"


@query("bm25_documents", sql(f"SELECT {RANKED} FROM d_ranked WHERE rank <= 5", "d_ranked"))
def bm25_documents(spark, sf):
    index = bm25.build_index(C.document_corpus(spark, sf))
    return ranked(bm25.bm25_search(index, C.benchmark_queries(spark, sf), 5))


@query("bm25_quotes", sql(f"SELECT {RANKED} FROM qq_ranked WHERE rank <= 8", "qq_ranked"))
def bm25_quotes(spark, sf):
    index = bm25.build_index(C.quote_corpus(C.quotes(spark, sf)))
    return ranked(bm25.bm25_search(index, C.benchmark_queries(spark, sf), 8))


@query("bm25_type_boost", sql(f"SELECT {RANKED} FROM qb_ranked WHERE rank <= 8", "qb_ranked"))
def bm25_type_boost(spark, sf):
    index = bm25.build_index(
        C.quote_corpus(C.quotes(spark, sf)), bm25.boost_repeats(F.col("type"), {"definition": 2.0, "principle": 1.5}))
    return ranked(bm25.bm25_search(index, C.benchmark_queries(spark, sf), 8))


@query("bm25_prefilter", sql(
    """SELECT query_id, CAST(r2 AS INT) AS rank, id, round(score, 6) AS score FROM (
         SELECT r.*, row_number() OVER (PARTITION BY query_id ORDER BY r.rank) AS r2 FROM d_ranked r JOIN csrc c ON c.id = r.id
         WHERE c.lang = 'en' AND c.edition_id IN ('src1', 'src2', 'src3', 'src4')) WHERE r2 <= 5""", "d_ranked", "csrc"))
def bm25_prefilter(spark, sf):
    corpus = C.document_corpus(spark, sf)
    cond = (F.col("lang") == "en") & F.col("edition_id").isin("src1", "src2", "src3", "src4")
    return ranked(bm25.bm25_search(bm25.build_index(corpus), C.benchmark_queries(spark, sf), 5, corpus, cond))


@query("bm25_postfilter", sql(
    """SELECT query_id, CAST(r2 AS INT) AS rank, id, round(score, 6) AS score FROM (
         SELECT r.*, row_number() OVER (PARTITION BY query_id ORDER BY r.rank) AS r2 FROM d_ranked r JOIN csrc c ON c.id = r.id
         WHERE r.rank <= 15 AND c.lang IN ('en', 'fr')) WHERE r2 <= 5""", "d_ranked", "csrc"))
def bm25_postfilter(spark, sf):
    corpus = C.document_corpus(spark, sf)
    return ranked(bm25.bm25_search(
        bm25.build_index(corpus), C.benchmark_queries(spark, sf), 5, corpus, F.col("lang").isin("en", "fr"), "post"))


@query("bm25_corpus_stats", sql(
    """SELECT (SELECT count(*) FROM d_len) AS documents, CAST((SELECT sum(dl) FROM d_len) AS BIGINT) AS tokens, round((SELECT avg(dl) FROM d_len), 6) AS mean_length,
       count(*) AS vocabulary, round(avg(idf), 6) AS mean_idf FROM d_term""", "d_term", "d_len"))
def bm25_corpus_stats(spark, sf):
    s = bm25.corpus_stats(bm25.build_index(C.document_corpus(spark, sf)))
    return s.withColumn("mean_length", F.round("mean_length", 6)).withColumn("mean_idf", F.round("mean_idf", 6))


@query("bm25_postings", sql("SELECT id, term, tf, CAST(dl AS BIGINT) AS dl FROM d_post", "d_post"))
def bm25_postings(spark, sf):
    return bm25.build_index(C.document_corpus(spark, sf)).postings.select("id", "term", "tf", F.col("dl").cast("long").alias("dl"))


@query("bm25_frequent_terms", sql("SELECT term, df, round(idf, 6) AS idf FROM d_term ORDER BY df DESC, term LIMIT 50", "d_term"))
def bm25_frequent_terms(spark, sf):
    return bm25.type_breakdown(bm25.build_index(C.document_corpus(spark, sf)), 50).withColumn("idf", F.round("idf", 6))


# -- the stored index in blocks; short queries are the first four words of a benchmark text

C.bm25_ctes("ds", "csrc", "qshort")


def new_folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored_blocks(spark, sf):
    folder = new_folder(spark, "blocks")
    blockmax.write_segment(C.document_corpus(spark, sf), folder, carry=["edition_id", "lang"])
    return blockmax.read_index(spark, folder)


@query("blockmax_topk", sql(f"SELECT {RANKED} FROM ds_ranked WHERE rank <= 5", "ds_ranked"))
def blockmax_topk(spark, sf):
    """The index is written, opened from its folder, and searched with blocks skipped."""
    return ranked(blockmax.block_search(stored_blocks(spark, sf), C.short_queries(spark, sf), 5))


@query("blockmax_filtered", sql(
    """SELECT query_id, CAST(r2 AS INT) AS rank, id, round(score, 6) AS score FROM (
         SELECT r.*, row_number() OVER (PARTITION BY query_id ORDER BY r.rank) AS r2 FROM ds_ranked r JOIN csrc c ON c.id = r.id
         WHERE (query_id % 3 = 0 OR c.edition_id = 'src' || query_id % 4) AND (query_id % 2 = 0 OR c.lang IN ('en', 'de'))) WHERE r2 <= 4""", "ds_ranked", "csrc"))
def blockmax_filtered(spark, sf):
    """Every query with an edition and a list of languages of its own, or without."""
    q = F.col("query_id")
    asked = C.short_queries(spark, sf).withColumn("edition", F.when(q % 3 != 0, F.concat(F.lit("src"), (q % 4).cast("string")))).withColumn(
        "langs", F.when(q % 2 != 0, F.array(F.lit("en"), F.lit("de"))))
    return ranked(blockmax.block_search(stored_blocks(spark, sf), asked, 4, match={"edition_id": "edition", "lang": "langs"}))


# -- vectors: the query vector of a benchmark item is the embedding of that number

CTES["v_scores"] = ([], """SELECT b.item_id AS query_id, e.vec_id AS id, e.label, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS score
    FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings e""")
CTES["v_ranked"] = (["v_scores"], "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM v_scores")


def vector_corpus(spark, sf):
    return C.read(spark, sf, "embeddings").withColumnRenamed("vec_id", "id")


def vector_queries(spark, sf):
    b = C.read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    return vector_corpus(spark, sf).join(b, F.col("id") == F.col("query_id")).select("query_id", "embedding")


@query("vector_topk", sql(f"SELECT {RANKED} FROM v_ranked WHERE rank <= 10 AND score >= 0.2", "v_ranked"))
def vector_topk(spark, sf):
    return ranked(vectors.vector_search(vector_corpus(spark, sf), vector_queries(spark, sf), 10, 0.2))


@query("vector_topk_filtered", sql(
    """SELECT query_id, CAST(r2 AS INT) AS rank, id, round(score, 6) AS score FROM (
       SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r2 FROM v_scores WHERE label IN (1, 3, 5)) WHERE r2 <= 10 AND score >= 0.15""", "v_scores"))
def vector_topk_filtered(spark, sf):
    return ranked(vectors.vector_search(
        vector_corpus(spark, sf), vector_queries(spark, sf), 10, 0.15, F.col("label").isin(1, 3, 5)))


@query("vector_topk_section", sql(
    """SELECT query_id, CAST(r2 AS INT) AS rank, id, round(score, 6) AS score FROM (
       SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r2 FROM v_ranked WHERE rank <= 30 AND score >= 0.1 AND label >= 5) WHERE r2 <= 10""", "v_ranked"))
def vector_topk_section(spark, sf):
    return ranked(vectors.vector_search(
        vector_corpus(spark, sf), vector_queries(spark, sf), 10, 0.1, section=F.col("label") >= 5))


@query("vector_topk_blocks", sql(f"SELECT {RANKED} FROM v_ranked WHERE rank <= 4 AND score >= 0.1", "v_ranked"))
def vector_topk_blocks(spark, sf):
    """Same search met block by block, as when queries outgrow one broadcast."""
    return ranked(vectors.vector_search(
        vector_corpus(spark, sf), vector_queries(spark, sf), 4, 0.1, query_block=16, corpus_chunk=200))


@query("vector_cells", sql(f"SELECT {RANKED} FROM v_ranked WHERE rank <= 10 AND score >= 0.2", "v_ranked"))
def vector_cells(spark, sf):
    """The exact search over stored cells: those out of reach are skipped."""
    folder = new_folder(spark, "cells")
    ivf.write_cells(vector_corpus(spark, sf), folder)
    return ranked(ivf.cell_search(ivf.read_cells(spark, folder), vector_queries(spark, sf), 10, 0.2))


@query("embedding_upsert_folders", """SELECT vec_id AS id, CASE WHEN vec_id % 50 < 3 THEN label + 100 ELSE label END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE vec_id % 100 = 0""")
def embedding_upsert_folders(spark, sf):
    """Two upserts into one stored table; the second rewrites the folders it touches."""
    folder, base = new_folder(spark, "vectors"), vector_corpus(spark, sf)
    keyed.upsert_partitions(base, folder)
    changed = base.where("id % 50 < 3").withColumn("label", (F.col("label") + 100).cast("int"))
    keyed.upsert_partitions(changed.unionByName(base.where("id % 100 = 0").withColumn("id", F.col("id") + 1000000)), folder)
    return spark.read.parquet(folder).select("id", "label")


@query("embedding_upsert", """SELECT vec_id AS id, CAST(sum(x) AS DOUBLE) AS total, label FROM (
    SELECT vec_id, unnest(list_transform(embedding, lambda v: CAST(round(CAST(v AS DOUBLE) * 1000) AS BIGINT))) * CASE WHEN label < 3 THEN 2 ELSE 1 END AS x, CASE WHEN label < 3 THEN label + 100 ELSE label END AS label FROM embeddings) GROUP BY ALL""")
def embedding_upsert(spark, sf):
    base = vector_corpus(spark, sf)
    changed = base.filter("label < 3").withColumn("label", (F.col("label") + 100).cast("int")).withColumn(
        "embedding", F.transform("embedding", lambda v: (F.round(v.cast("double") * 1000).cast("long") * 2 / 1000).cast("float")))
    total = F.aggregate("embedding", F.lit(0).cast("long"), lambda a, v: a + F.round(v.cast("double") * 1000).cast("long"))
    return vectors.upsert(base, changed).select("id", total.cast("double").alias("total"), "label")


CTES["fused"] = (["v_ranked", "d_ranked"], """SELECT query_id, id, round(sum(p), 12) AS score, max(vr) AS vr, max(kr) AS kr FROM (
    SELECT query_id, id, 0.6::DOUBLE / (60 + rank) AS p, rank AS vr, NULL AS kr FROM v_ranked WHERE rank <= 16 AND score >= 0.1
    UNION ALL SELECT query_id, id, 0.4::DOUBLE / (60 + rank), NULL, rank FROM d_ranked WHERE rank <= 16) GROUP BY ALL""")
CTES["hybrid"] = (["fused"], "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vr NULLS LAST, kr NULLS LAST) AS rank FROM fused")


@query("hybrid_search", sql(
    """SELECT query_id, CAST(rank AS INT) AS rank, id, round(score, 9) AS score, CASE WHEN vr IS NULL THEN 'bm25' ELSE 'vector' END AS source FROM hybrid WHERE rank <= 8""", "hybrid"))
def hybrid_search(spark, sf):
    corpus = C.document_corpus(spark, sf)
    fused = plan.search(corpus, bm25.build_index(corpus), C.benchmark_queries(spark, sf), vector_corpus(spark, sf), vector_queries(spark, sf), 8, score_threshold=0.1)
    return fused.withColumn("score", F.round("score", 9))


@query("hybrid_by_edition", sql(
    """, vr AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY v.score DESC, id) AS rank, v.score FROM v_scores v JOIN csrc c USING (id) WHERE c.edition_id = 'src2'),
     kr AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, s.o1) AS rank FROM d_scores s JOIN csrc c USING (id) WHERE c.edition_id = 'src2'),
     f AS (SELECT query_id, id, round(sum(p), 12) AS score, max(a) AS a, max(b) AS b FROM (SELECT query_id, id, 0.6::DOUBLE / (60 + rank) AS p, rank AS a, NULL AS b FROM vr WHERE rank <= 10 AND score >= 0.0
        UNION ALL SELECT query_id, id, 0.4::DOUBLE / (60 + rank), NULL, rank FROM kr WHERE rank <= 10) GROUP BY ALL)
     SELECT query_id, id, round(score, 9) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, a NULLS LAST, b NULLS LAST) AS rank FROM f) WHERE rank <= 5""",
    "v_scores", "d_scores", "csrc"))
def hybrid_by_edition(spark, sf):
    corpus = C.document_corpus(spark, sf)
    found = plan.search_by_edition(
        corpus, bm25.build_index(corpus), C.benchmark_queries(spark, sf), "src2", vector_corpus(spark, sf), vector_queries(spark, sf), top=5, score_threshold=0.0)
    return found.select("query_id", "id", F.round("score", 9).alias("score"), "rank")


@query("minmax_scores", sql(
    """SELECT query_id, id, round(CASE WHEN hi = lo THEN 0.5 ELSE (score - lo) / (hi - lo) END, 6) AS score FROM (
       SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM d_ranked WHERE rank <= 10)""", "d_ranked"))
def minmax_scores(spark, sf):
    kw = bm25.bm25_search(bm25.build_index(C.document_corpus(spark, sf)), C.benchmark_queries(spark, sf), 10)
    return fusion.min_max(kw).select("query_id", "id", F.round("score", 6).alias("score"))


@query("rerank_hits", sql(
    """, s AS (SELECT query_id, id, rank, score, 1.0 / (1.0 + exp(-(CAST(id % 17 AS DOUBLE) - 8.0))) AS rel FROM d_ranked WHERE rank <= 10),
       r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rank) AS rn FROM s)
       SELECT query_id, id, CAST(rn AS INT) AS rank, round(rel, 6) AS score, 'reranked' AS source FROM r WHERE rn <= 5 AND rel >= 0.3""", "d_ranked"))
def rerank_hits(spark, sf):
    kw = bm25.bm25_search(bm25.build_index(C.document_corpus(spark, sf)), C.benchmark_queries(spark, sf), 10)
    rel = kw.select("query_id", "id", (F.col("id") % 17 - 8).cast("double").alias("relevance"))
    out = fusion.rerank(kw.withColumn("source", F.lit("bm25")), rel, 5, 0.3)
    return out.select("query_id", "id", "rank", F.round("score", 6).alias("score"), "source")


@query("score_cutoff", sql("SELECT query_id, id, round(score, 6) AS score FROM v_scores WHERE greatest(score, 0.0) >= 0.25", "v_ranked", "v_scores"))
def score_cutoff(spark, sf):
    """Every pair above the cut-off: the search with no rank limit but the corpus size."""
    corpus = vector_corpus(spark, sf)
    n = corpus.count()
    return vectors.vector_search(corpus, vector_queries(spark, sf), n, 0.25).select("query_id", "id", F.round("score", 6).alias("score"))


@query("intent_order", sql(
    """, h AS (SELECT query_id, rank, id, edition_id, sort_key, CASE query_id % 5 WHEN 0 THEN 'specific_time' WHEN 1 THEN 'general_definition' WHEN 2 THEN 'evolution_comparison' ELSE 'open_ended' END AS intent,
          'rc' || CAST(query_id % 20 AS VARCHAR) AS hint, query_id % 5 = 4 AS latest FROM hits),
       k AS (SELECT *, contains(edition_id, hint) AS m, bool_or(contains(edition_id, hint)) OVER (PARTITION BY query_id) AS anym FROM h)
       SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN intent = 'general_definition' OR (intent = 'open_ended' AND latest) THEN -sort_key WHEN intent = 'evolution_comparison' THEN sort_key ELSE 0 END, rank) AS INT) AS rank
       FROM k WHERE intent <> 'specific_time' OR m OR NOT anym""", "hits").replace("query_id, rank, id,", "query_id, rank, quote_id AS id,"))
def intent_order(spark, sf):
    hits, _ = C.quote_hits(spark, sf)
    q = F.col("query_id")
    h = hits.withColumn(
        "intent", F.when(q % 5 == 0, "specific_time").when(q % 5 == 1, "general_definition").when(q % 5 == 2, "evolution_comparison").otherwise("open_ended")
    ).withColumn("edition_hint", F.concat(F.lit("rc"), (q % 20).cast("string"))).withColumn("latest_first", q % 5 == 4)
    return fusion.order_by_intent(h).select("query_id", "id", "rank")


@query("normalised_hits", sql(
    """SELECT query_id, CAST(rank AS INT) AS rank, quote_id, edition_id, year, type, array_to_string(section_path, '>') AS chapter_path, round(score, 6) AS score,
       char_start, CAST(char_end AS BIGINT) AS char_end, sha256, CAST(length(text) AS INT) AS text_length, CASE WHEN length(text) > 40 THEN left(text, 40) || '...' ELSE text END AS preview,
       round(score, 4) AS safe_score FROM hits""", "hits"))
def normalised_hits(spark, sf):
    from stratatext.plans.retrieve import normalise_hits, safe_hits

    qs = C.quotes(spark, sf)
    found = stored(bm25.bm25_search(bm25.build_index(C.quote_corpus(qs)), C.benchmark_queries(spark, sf), 8), "found")
    hits = normalise_hits(found.select("query_id", "rank", F.col("id").alias("quote_id"), "score"), qs).withColumn(
        "year", C.edition_order("edition_id") + 1979)
    safe = safe_hits(hits, preview_chars=40)
    return safe.select(
        "query_id", "rank", "quote_id", "edition_id", "year", "type", F.array_join("chapter_path", ">").alias("chapter_path"),
        F.round("raw_score", 6).alias("score"), "char_start", "char_end", "sha256", "text_length", F.col("text_preview").alias("preview"), F.col("score").alias("safe_score"))
