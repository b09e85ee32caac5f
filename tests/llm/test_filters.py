"""Filters of ids stand in for joins that would shuffle every text."""

import pytest
from pyspark.sql import functions as F

from stratatext.llm import minhash, seen


def shuffled_rows(df):
    """Rows that the exchanges of the executed plan wrote."""
    df.collect()

    def walk(plan):
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(plan.executedPlan())
        if "QueryStage" in name:
            return walk(plan.plan())
        written = plan.metrics().get("shuffleRecordsWritten")
        below = plan.children()
        return (written.get().value() if written.isDefined() else 0) + sum(walk(below.apply(i)) for i in range(below.size()))

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.fixture
def no_broadcast(spark):
    """Joins as they are planned once the lists of ids are large."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def some_docs(spark, n=600):
    words = F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.concat(F.lit("w"), (i * 7 + F.when(F.col("id") % 50 == 1, F.col("id") - 1).otherwise(F.col("id")) * 31).cast("string")))
    docs = spark.range(n).select(F.when(F.col("id") != 5, F.col("id")).alias("doc_id"), F.array_join(words, " ").alias("text"), F.lit("x").alias("lang"))
    return docs.localCheckpoint()


def test_near_copies_go_without_shuffling_all_texts(spark, no_broadcast):
    out = minhash.keep_one(some_docs(spark))
    assert shuffled_rows(out) < 200  # 600 texts and the list before
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(str(None if i == 5 else i) for i in range(600) if i % 50 != 1)


def test_sets_are_made_where_texts_are_read(spark, no_broadcast):
    rows = some_docs(spark).where("doc_id is not null")
    sets = minhash.sets_of(rows.select("doc_id", "text"), spark.range(0, 600, 40), 5)
    assert shuffled_rows(sets) == 0  # 599 texts before
    got = {r["doc_id"] for r in sets.collect()}
    assert set(range(0, 600, 40)) <= got and len(got) < 60


def test_id_filters_miss_nothing(spark):
    held = [0, -1, 7, -(1 << 63), (1 << 63) - 1]
    kept = seen.id_filter(spark.createDataFrame([(i,) for i in [*held, None]], "x long"))
    ids = spark.createDataFrame([(i,) for i in [*held, None]], "y long")
    got = ids.select("y", seen.maybe_among(F.col("y"), kept).alias("ok")).collect()
    assert {r["y"]: r["ok"] for r in got} == {**dict.fromkeys(held, True), None: False}
    none = seen.id_filter(spark.range(0))
    assert not any(r["ok"] for r in ids.select(seen.maybe_among(F.col("y"), none).alias("ok")).collect())
