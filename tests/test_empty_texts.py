"""Documents without a text: registered queries give what their SQL gives."""

import duckdb
import pytest

import __spark_entry__ as entry
from stratatext.operators import quality as QL


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The smallest tables; of the documents some are empty, null or blank."""
    folder = tmp_path_factory.mktemp("empty")
    con = duckdb.connect()
    given = "/root/testdata/sf0.001/documents.parquet"
    text = "CASE WHEN doc_id % 20 = 3 THEN '' WHEN doc_id % 20 = 4 THEN NULL WHEN doc_id % 20 = 5 THEN '  ' ELSE text END"
    con.execute(f"COPY (SELECT * REPLACE ({text} AS text) FROM '{given}') TO '{folder}/documents.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    return str(folder), con


def same_as_sql(spark, tables, name):
    folder, con = tables
    df = entry.queries()[name](spark, folder)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in df.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, want))


def test_toc_flat_leaves_empty_texts_out(spark, tables):
    same_as_sql(spark, tables, "toc_flat")


def test_toc_section_counts_leave_empty_texts_out(spark, tables):
    same_as_sql(spark, tables, "toc_section_counts")


def test_health_checks_allow_empty_texts_in_the_raw_table(spark, tables):
    same_as_sql(spark, tables, "health_checks")


def test_stream_ingest_keeps_refused_texts(spark, tables):
    same_as_sql(spark, tables, "stream_ingest")


def test_health_checks_of_a_collection_fail_on_empty_texts(spark):
    docs = spark.createDataFrame([(i, "" if i == 3 else "a") for i in range(12)], "doc_id long, text string")
    toc = spark.createDataFrame([("e", "H1")], "edition_id string, level string")
    quotes = spark.createDataFrame([("q", "h", "definition")], "quote_id string, sha256 string, type string")
    rows = {r["check"]: (r["status"], r["summary"]) for r in QL.health_checks(docs, toc, quotes).collect()}
    assert rows["docs"] == ("FAIL", "empty texts") and rows["EXIT"][0] == "FAIL"
