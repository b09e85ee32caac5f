"""Work that grows with the input, not with its square."""

import difflib
import random
import re
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from stratatext.functions.text import BLANKS
from stratatext.operators import bm25, lookup
from stratatext.operators import evidence as EV


def most_rows(df):
    """The most rows that a step of the executed plan made."""
    df.collect()

    def walk(plan):
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(plan.executedPlan())
        if "QueryStage" in name:
            return walk(plan.plan())
        metric = plan.metrics().get("numOutputRows")
        made = metric.get().value() if metric.isDefined() else 0
        below = plan.children()
        return max([made, *(walk(below.apply(i)) for i in range(below.size()))])

    return walk(df._jdf.queryExecution().executedPlan())


def test_canonical_lookup_meets_equal_texts_once(spark):
    n = 600
    k = F.col("id")
    subject = F.concat_ws(" ", F.lit("hot"), F.concat(F.lit("part"), (k % 5).cast("string")))
    items = spark.range(n).select(k.alias("item_id"), k.alias("ord"), subject.alias("subject"))
    text = F.when(k % 2 == 0, F.concat(F.lit("about "), subject)).otherwise("my hot one with part3")
    asked = spark.range(n).select(k.alias("query_id"), text.alias("text"))
    got = lookup.canonical_lookup(asked, items)
    assert most_rows(got) < 20 * n  # each query met each item before: 360,000 rows
    want = {q: ((n - 5 + q % 5, 2) if q % 2 == 0 else (3, 3)) for q in range(n)}
    assert {r["query_id"]: (r["item_id"], r["how"]) for r in got.collect()} == want


def test_claims_of_a_long_text_take_one_pass(spark):
    """An expression that copied the pieces so far and the rest of the text took minutes."""
    parts = [f"Sentence number {i} says little" for i in range(30_000)]
    rows = spark.createDataFrame([(". ".join(parts),), (None,)], "t string")
    t0 = time.time()
    got = rows.select(F.size(EV.claim_sentences(F.col("t"))).alias("n"), F.element_at(EV.claim_sentences(F.col("t")), -1).alias("last")).collect()
    assert time.time() - t0 < 30
    size = len(rows.first()["t"])
    assert (got[0]["n"], got[0]["last"]["start"], got[0]["last"]["end"]) == (len(parts), size - len(parts[-1]), size)
    assert got[1]["last"] is None


def test_claim_summary_makes_the_claims_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def subject(i):
        made.add(1)
        return f"s{i % 3}"

    rows = spark.range(300).select(F.lit("value").alias("claim_type"), subject.asNondeterministic()("id").alias("subject"))
    assert len(EV.claim_summary(rows).collect()) == 5
    assert made.value == 300  # three times as many before


def some_corpus(spark, n=300):
    """Words, blanks of all kinds between them, copies, null and empty texts, two groups and none."""
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(12)] + ["the"] * 9
    rows = []
    for i in range(n):
        text = "".join(rnd.choice(words) + rnd.choice(BLANKS) for _ in range(rnd.randint(0, 30)))
        rows.append((f"d{i}", (i // 3, -i), {0: None, 1: ""}.get(i, rows[-1][2] if i % 4 == 3 else text), ["x", "y", None][i % 3], 1 + i % 2))
    return spark.createDataFrame(rows, "id string, ord struct<a:int,b:int>, text string, edition string, times int")


@pytest.mark.parametrize("sizes", [{}, {"BLOCK_QUERIES": 2, "TILE_SCORES": 40, "TILE_MATCHES": 50, "TILE_CHARS": 100}])
def test_scores_of_texts_equal_those_of_postings(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(bm25, name, value)
    corpus = some_corpus(spark).repartition(3)
    index = bm25.build_index(corpus, F.col("times"), carry=["edition"])
    asked = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(["w1 w2 w1", "the", "w3 unseen", "unseen", "", None, "w4 w5 w6 w7 the the"])], "query_id string, text string")
    whole = bm25.scores(replace(index, texts=None), asked)
    assert sorted(map(repr, bm25.scores(index, asked).collect())) == sorted(map(repr, whole.collect()))
    for k in (1, 4):
        best = lambda df: sorted(map(repr, bm25.top_k(df, k).collect()))
        assert best(bm25.scores(index, asked, top=k)) == best(whole)
        each = bm25.scores(index, asked, top=k, per="edition")
        for part in ("edition = 'x'", "edition = 'y'", "edition is null", "true"):
            assert best(each.where(part)) == best(whole.where(part))


def test_search_shuffles_no_postings(spark):
    corpus = spark.range(400).select(F.col("id"), F.col("id").alias("ord"), F.concat_ws(" ", F.array_repeat(F.lit("common"), 5), F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("w"), (i * 7 + F.col("id")).cast("string")))).alias("text"))
    asked = spark.createDataFrame([(i, f"common w{i}") for i in range(50)], "query_id long, text string")
    assert most_rows(bm25.bm25_search(bm25.build_index(corpus), asked, 3)) < 10_000  # 24,400 postings before


def test_tokens_are_split_alike(spark):
    """Python's blanks are those of the tokens."""
    assert "".join(map(chr, range(0x11000))).split() == [w for w in re.split(f"[{re.escape(BLANKS)}]+", "".join(map(chr, range(0x11000)))) if w]


def test_many_passages_are_met_in_blocks_without_the_salted_join(spark, monkeypatch):
    def never(*_):
        raise AssertionError("pairs of queries and texts would be shuffled")

    monkeypatch.setattr(bm25, "_join_on_terms", never)
    monkeypatch.setattr(bm25, "BLOCK_QUERIES", 4)
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    texts = [" ".join(word() for _ in range(12)) for _ in range(40)]
    texts[7] = texts[8]
    quotes = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "id long, ord long, text string")
    asked = {i: texts[i] if i % 3 == 0 else " ".join(texts[i].split()[:9][::-1] + [word()]) for i in range(20)}
    got = lookup.find_passages(bm25.build_index(quotes), quotes, spark.createDataFrame(list(asked.items()), "query_id long, text string"), 0.0, 2).collect()
    assert {r["query_id"] for r in got} == set(asked)
    assert sum(r["how"] == "exact" for r in got) == 7
    for r in got:
        blocks = difflib.SequenceMatcher(None, asked[r["query_id"]], texts[r["id"]]).get_matching_blocks()
        assert r["score"] == sum(b.size for b in blocks) / len(asked[r["query_id"]])
