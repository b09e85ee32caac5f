"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratatext.llm import bpe, decontaminate, html, lines, minhash, passages, private, quality, rans, spelling, suffixes, warc, whiten

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary() -> str:
    """Path of the public byte-level vocabulary file on this machine and the executors."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_warc_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("html", "url")


SQL["op1_warc_ranges"] = """
WITH d AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM d),
q AS (SELECT *, [CAST(('0x' || substr(hex, 5 * i + 1, 5)) AS BIGINT) FOR i IN range(8)] AS parts FROM f)
SELECT page_id, payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((parts[j // 4 + 1] >> (15 - 5 * (j % 4))) & 31 AS INT) + 1, 1) FOR j IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM q
"""


@query
def op2_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Id appended to each document, and the size of the vocabulary.
END_ID, VOCABULARY = 2, 50257


@query
def op3_rans_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.round_trip(table(spark, sf_dir, "documents"), rans.library_encoder(vocabulary()), VOCABULARY, END_ID)


@query
def op4_line_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_table(table(spark, sf_dir, "documents"))


SQL["op4_line_filters"] = """
WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS no, unnest(ls) AS line
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT doc_id, no, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.doc_id, k.no, k.line, s.last IS NOT NULL AND s.last <> k.doc_id AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


@query
def op5_minimum_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


@query
def op6_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), vocabulary())


@query
def op7_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2)


@query
def op8_sampled_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.byte_table(table(spark, sf_dir, "documents"))


@query
def op9_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_passages(table(spark, sf_dir, "documents"))


@query
def op11_shifted_cholesky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


@query
def op12_sorted_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


@query
def op13_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.private_table(table(spark, sf_dir, "documents"))
