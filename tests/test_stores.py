"""Stored cells of vectors, batches with a ledger, upserted folders, streamed segments."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratatext.operators import blockmax, bm25, ivf, vectors
from stratatext.operators.ingest import new_rows
from stratatext.sources import keyed
from stratatext.streaming import jobs


@pytest.fixture(scope="module")
def cloud(spark):
    """Clusters of several sizes; a third of all rows is one vector."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([c + rng.normal(scale=0.4, size=(int(n), 16)) for c, n in zip(centres, rng.integers(20, 160, 12), strict=True)])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(10_000 + i, rows[0][1]) for i in range(len(rows) // 2)] + [(90_000, None), (90_001, [0.0] * 16)]
    return spark.createDataFrame(rows, "id long, embedding array<double>").repartition(4).cache()


def asked(cloud):
    return cloud.where("id % 10 = 0 and embedding is not null").select(F.col("id").alias("query_id"), "embedding")


def hits(df):
    return {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in df.collect()}


@pytest.mark.parametrize("threshold", [-2.0, 0.3])
def test_cells_exact_and_near(spark, cloud, tmp_path, threshold):
    ivf.write_cells(cloud, str(tmp_path), chunk=60)
    index = ivf.read_cells(spark, str(tmp_path))
    assert index.cells.agg(F.max("parts")).first()[0] > 4
    want = vectors.vector_search(cloud.where("embedding is not null"), asked(cloud), 8, threshold)
    assert hits(ivf.cell_search(index, asked(cloud), 8, threshold, probes=2)) == hits(want)
    near = ivf.cell_search(index, asked(cloud), 8, threshold, probes=6, exact=False)
    assert ivf.recall(near, want) >= 0.9


def test_cells_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([(1, None)], "id long, embedding array<double>")
    ivf.write_cells(none, str(tmp_path))
    one = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    for exact in (True, False):
        assert ivf.cell_search(ivf.read_cells(spark, str(tmp_path)), one, 3, exact=exact).count() == 0


def batch(spark, rows):
    return spark.createDataFrame(rows, "quote_id string, content_hash string, ord int")


def test_batches_equal_plain_ingest_and_replay(spark, tmp_path):
    rng = np.random.default_rng(6)
    parts = [[(f"q{rng.integers(40)}", f"h{rng.integers(40)}", n * 100 + i) for i in range(30)] for n in range(3)]
    table, path = None, str(tmp_path)
    for n, rows in enumerate(parts):
        fresh = new_rows(batch(spark, rows), table, ["ord"])
        table = fresh if table is None else table.unionByName(fresh)
        keyed.append_batch(batch(spark, rows), path, n, ["ord"])
    want = sorted(map(tuple, table.select("quote_id", "content_hash", "ord").collect()))
    now = lambda: sorted(map(tuple, keyed.read_batches(spark, path).select("quote_id", "content_hash", "ord").collect()))
    assert now() == want
    for n in (1, 2, 0):
        keyed.append_batch(batch(spark, parts[n]), path, n, ["ord"])
        assert now() == want
    # A batch that died before its ledger entry is unseen, and runs again as if new.
    batch(spark, [("dead", "dead", 1)]).write.parquet(f"{path}/rows/batch=3")
    assert now() == want and keyed.ledger(spark, path) == [0, 1, 2]
    keyed.append_batch(batch(spark, [("new", "new", 1), ("new", "other", 2), (parts[0][0][0], "x", 3)]), path, 3, ["ord"])
    assert now() == sorted([*want, ("new", "new", 1)])
    plan = keyed.known_keys(spark, path, batch(spark, [("new", "new", 1)]), 9, "quote_id", "content_hash")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_upsert_leaves_other_folders_alone(spark, tmp_path):
    path = f"{tmp_path}/t"
    files = lambda: {d: sorted(f for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")) for d in os.listdir(path) if d.startswith("bucket=")}
    keyed.upsert_partitions(spark.createDataFrame([(i, f"v{i}", 1) for i in range(500)], "id long, v string, at int"), path, buckets=16)
    before = files()
    new = spark.createDataFrame([(3, "old", 1), (3, "new", 2), (700, "added", 1)], "id long, v string, at int")
    touched = keyed.upsert_partitions(new, path, version="at", buckets=16)
    after = files()
    assert len(touched) <= 2 and all(before[d] == after[d] for d in before if int(d.split("=")[1]) not in touched) and before != after
    got = {r["id"]: r["v"] for r in spark.read.parquet(path).collect()}
    assert got == {**{i: f"v{i}" for i in range(500)}, 3: "new", 700: "added"}


def test_streamed_segments(spark, tmp_path):
    schema = "id long, ord long, text string, deleted boolean"
    arrivals = [[(1, 1, "red fox runs", False), (2, 2, "blue fox", False), (3, 3, "green hill", False), (4, 9, "kept", None)], [(1, 4, "red hen", False), (1, 5, "red hen sits", False), (2, 6, None, True)], [(3, 3, "green hill", False), (5, 7, "fox fox", False)]]
    for k, rows in enumerate(arrivals):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        jobs.segment_stream(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    now = spark.createDataFrame([(1, 5, "red hen sits"), (3, 3, "green hill"), (4, 9, "kept"), (5, 7, "fox fox")], "id long, ord long, text string")
    queries = spark.createDataFrame([(1, "fox hen"), (2, "green hill kept"), (3, "blue")], "query_id long, text string")
    want = {k: (i, round(s, 9)) for k, (i, s) in hits(bm25.bm25_search(bm25.build_index(now), queries, 3)).items()}
    found = lambda: {k: (i, round(s, 9)) for k, (i, s) in hits(blockmax.block_search(jobs.read_segments(spark, f"{tmp_path}/out"), queries, 3)).items()}
    assert found() == want
    assert jobs.merge_segments(spark, f"{tmp_path}/out", 2) and found() == want and not jobs.merge_segments(spark, f"{tmp_path}/out", 2)
    spark.createDataFrame([(5, 8, None, True), (3, 9, "fox hill", False)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    jobs.segment_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    left = spark.createDataFrame([(1, 5, "red hen sits"), (3, 9, "fox hill"), (4, 9, "kept")], "id long, ord long, text string")
    want = {k: (i, round(s, 9)) for k, (i, s) in hits(bm25.bm25_search(bm25.build_index(left), queries, 3)).items()}
    assert found() == want
