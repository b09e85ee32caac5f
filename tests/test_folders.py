"""Streams over tables that are one file or a folder of files."""

from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry


@pytest.fixture(params=["file", "folder"])
def tables(request, spark, tmp_path):
    """The smallest documents and events, each as one file or as a folder of three."""
    for name in ("documents", "events"):
        df = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(90)
        if request.param == "folder":
            df.repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
        else:
            df.toPandas().to_parquet(f"{tmp_path}/{name}.parquet", coerce_timestamps="us")
    return str(tmp_path)


def test_streams_read_every_file(spark, tables):
    q = entry.queries()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    first = {}
    for k in sorted(texts):
        first.setdefault(texts[k], k)
    kept = q["stream_ingest"](spark, tables).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(first.values())
    df = Counter(w for t in texts.values() for w in set(t.split()))
    got = {r["term"]: r["df"] for r in q["stream_postings"](spark, tables).collect()}
    assert all(got[w] == n for w, n in df.items() if w.isalpha())
    hours = q["stream_hourly_totals"](spark, tables).collect()
    assert sum(r["requests"] for r in hours) == spark.read.parquet(f"{tables}/events.parquet").count()


def test_upserted_vectors_round_as_their_sql(spark, tmp_path):
    """Entries whose thousandths lie nearer to a half than a float tells."""
    x = (np.arange(-2000, 2000) + 0.5).astype(np.float64) / 1000
    near = [float(v) for s in (0, 1, -1) for v in np.nextafter(x.astype(np.float32), np.float32(s))]
    rows = [(i, [v], i % 6) for i, v in enumerate(near)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(f"SELECT id, total, label FROM ({entry.oracle_sql()['embedding_upsert']})").fetchall()
    got = entry.queries()["embedding_upsert"](spark, str(tmp_path)).select("id", "total", "label").collect()
    assert sorted(map(tuple, got)) == sorted(want)
