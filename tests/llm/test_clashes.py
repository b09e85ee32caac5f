"""Columns of the documents that have the names of helpers, empty tables, and where work is done."""

import pytest

import corpus_pipeline
from stratatext.llm import lines, minhash, quality

from .test_text import PATH, words

LINE = "A licence line that is longer than forty characters, for all to see."
NAMES = ["bad", "_id", "_row", "_words", "_lines", "_t", "_s", "drops", "_doc", "of", "row", "id", "whole", "lines", "kept", "grow", "n_words", "n_lines", "n_dropped", "_n_lines", "component_id", "comp"]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, words(3000 + i, 40) + "\n" + LINE, *[f"{n}{i}" for n in NAMES]) for i in range(8)]
    rows += [(20, rows[0][1], *NAMES), (21, None, *NAMES), (22, "", *NAMES), (None, words(3100, 40), *NAMES), (7, rows[7][1], *NAMES)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(8)] + [(None, 0), (3, None)], "doc_id long, quality int")


def test_quality_keeps_clashing_columns(clashing, labels):
    kept = quality.keep_good(clashing, labels)
    assert kept.columns == clashing.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["bad"]) for r in kept.collect()) == sorted(
        (r["doc_id"] is None, r["doc_id"] or 0, r["bad"]) for r in clashing.collect() if len((r["text"] or "").split()) >= quality.MIN_WORDS
    )
    assert quality.quality_table(clashing, labels).count() == clashing.count()


def test_lines_keep_clashing_columns(clashing):
    out = lines.without_shared_lines(clashing)
    assert out.columns == [*clashing.columns, "__n_lines", "_n_dropped"]
    before = {(r["doc_id"], r["bad"]): r for r in clashing.collect()}
    for r in out.collect():
        was = before[r["doc_id"], r["bad"]]
        assert [r[n] for n in NAMES] == [was[n] for n in NAMES]
        gone = r["doc_id"] is not None and r["doc_id"] < 20 and LINE in (was["text"] or "")
        assert r["text"] == ((was["text"] or "").replace("\n" + LINE, "") if gone else was["text"] or "")


def test_near_copies_keep_clashing_columns(clashing):
    out = minhash.keep_one(clashing)
    assert out.columns == clashing.columns
    assert sorted(r["doc_id"] for r in out.where("doc_id is not null").collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 7, 21, 22]


def test_stages_on_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0, name
    some = spark.createDataFrame([(1, words(3200, 40), "en", "s", 1), (1, words(3200, 40), "en", "s", 1), (2, None, None, None, None)], docs.schema)
    now = some
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
    assert [r["doc_id"] for r in now.collect()] == [1, 1]


def test_decoded_digest_is_that_of_the_text(spark):
    import hashlib

    from stratatext.llm import bpe

    given = [(1, words(3300, 50)), (2, "é́ \U0001f600\n\n x"), (3, ""), (4, None)]
    out = bpe.encode_and_decode(spark.createDataFrame(given, "doc_id long, text string"), PATH)
    plain = {r["doc_id"]: r["ids"] for r in bpe.encode_ids(spark.createDataFrame(given, "doc_id long, text string"), PATH).collect()}
    for r in out.collect():
        text = dict(given)[r["doc_id"]] or ""
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["ids"] == plain[r["doc_id"]] and r["n_tokens"] == len(r["ids"])


def test_rules_test_their_values(spark):
    """The rules learned on bins say on values what a plain reading of their text says."""
    good = [(i, words(3400 + i, 60)) for i in range(60)]
    junk = [(100 + i, words(3500 + i, 60).replace(" ", " ##", 30)) for i in range(60)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 100)) for k, _ in good + junk], "doc_id long, quality int")
    rules = quality.learn(docs, labels)
    assert rules and all(1 <= len(r.tests) <= quality.Learning.max_tests for r in rules)
    table = quality.statistics(docs).selectExpr("doc_id", *[f"{e} as {n}" for n, e in quality.FEATURES.items()]).withColumnRenamed("n_words", "_n")
    values = {r["doc_id"]: r.asDict() for r in table.collect()}
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_table(docs, labels).collect()}
    for k, v in values.items():
        v["n_words"] = v["_n"]
        hit = any(all((v[n] > x) if up else (v[n] <= x) for n, up, x in r.tests) for r in rules)
        assert kept[k] == (not hit)
    assert sum(kept[k] for k, _ in junk) <= 6 and sum(kept[k] for k, _ in good) >= 54
