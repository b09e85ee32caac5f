"""Repair of coverage, batched title search, hints, damaged spans and numbered lines against plain loops."""

import random

from pyspark.sql import functions as F

from stratatext.operators import evidence, headers, policy, temporal
from stratatext.sources import jsonl


def test_repair_as_ranks_equals_the_loop(spark):
    rnd = random.Random(11)
    hits, best, need, want = [], [], [], {}
    for q in range(300):
        mine = [(f"h{i}", rnd.choice("abcd")) for i in range(rnd.randint(0, 6))]
        wanted = rnd.sample("abcdefgh", rnd.randint(0, 5))
        found = {e: f"n{e}" if rnd.random() < 0.8 or not mine else rnd.choice(mine)[0] for e in wanted if rnd.random() < 0.9}
        hits += [(q, n + 1, i, e) for n, (i, e) in enumerate(mine)]
        best += [(q, i, e) for e, i in found.items()]
        need += [(q, e, n) for n, e in enumerate(wanted)]
        have = {e for _, e in mine}
        extra = [(found[e], e) for e in wanted if e not in have and e in found] if len(wanted) > 1 else []
        if mine or extra:
            want[q] = policy.repair_order(mine, list(dict.fromkeys(extra)), 6)
    out = policy.ensure_coverage(
        spark.createDataFrame(hits, "query_id int, rank int, id string, edition_id string"), spark.createDataFrame(best, "query_id int, id string, edition_id string"),
        spark.createDataFrame(need, "query_id int, edition_id string, ord int"), 6,
    )
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
        assert r["rank"] == len(got[r["query_id"]])
    assert got == {q: ids for q, ids in want.items() if ids}


def test_titles_for_many_needles(spark):
    titles = ["Alpha Beta", "beta", "GAMMA", "", "a", "Alpha Beta"]
    toc = spark.createDataFrame([(i, f"e{i % 2}", ["x"], "H1", t, i) for i, t in enumerate(titles)] + [(9, "e9", ["x"], "H0", "alpha", 0)], "doc_id int, edition_id string, path array<string>, level string, title string, line int")
    asked = [(1, "BETA", None), (2, "a", "e1"), (3, "a", "nowhere"), (4, "", None), (5, None, None), (6, "a", "e9"), (7, "beta", "e0"), (7, "gam", "e0")]
    out = headers.search_titles_many(toc, spark.createDataFrame(asked, "query_id int, needle string, edition_id string"))
    known = {"e0", "e1", "e9"}
    want = [
        (q, i, t) for q, n, e in asked for i, t in enumerate(titles)
        if n and n.lower() in t.lower() and (e not in known or e == f"e{i % 2}")
    ]
    assert sorted((r["query_id"], r["doc_id"], r["title"]) for r in out.collect()) == sorted(want)


def test_hints(spark):
    hits = spark.createDataFrame([(1, "2020-14"), (1, "1979-1"), (2, "1979-1"), (3, None)], "query_id int, edition_id string")
    asked = spark.createDataFrame([(1, "2020"), (2, "2020"), (3, "1"), (4, "1979"), (2, None)], "query_id int, hint string")
    got = {(r["query_id"], r["hint"]): r["edition_filter_ok"] for r in temporal.hint_checks(hits, asked).collect()}
    assert got == {(1, "2020"): True, (2, "2020"): False, (3, "1"): False, (4, "1979"): False, (2, None): False}


def test_damaged_spans(spark):
    raw = "one  two\nthree four"
    rows = [("ok", 0, 8, "one two"), ("short", 0, 6, "one two"), ("past", 9, 99, "three four"), ("empty", 3, 3, "x"), ("before", -1, 5, "one")]
    quotes = spark.createDataFrame([(n, 1, a, b, t) for n, a, b, t in rows], "quote_id string, doc_id int, char_start long, char_end long, text string")
    quotes = quotes.withColumn("sha256", F.when(F.col("quote_id") == "short", "x").otherwise(F.sha2("text", 256)))
    out = evidence.span_check(quotes, spark.createDataFrame([(1, raw)], "doc_id int, text string"))
    assert {r["quote_id"]: (r["text_ok"], r["hash_ok"]) for r in out.collect()} == {
        "ok": (True, True), "short": (False, False), "past": (False, True), "empty": (False, True), "before": (False, True)
    }


def test_lines_of_blocks_are_numbered(spark, tmp_path):
    """Files cut into many blocks, several to a task, with blank and broken lines."""
    rnd = random.Random(3)
    want_good, want_bad = [], []
    for f in range(3):
        lines = []
        for n in range(1, 400):
            kind = rnd.random()
            lines.append("" if kind < 0.1 else '{"id": "x' if kind < 0.2 else '{"id": "%d-%d", "query": "%s"}' % (f, n, "é" * rnd.randint(0, 60)))
            if lines[-1]:
                (want_good if lines[-1].endswith("}") else want_bad).append((f"f{f}.jsonl", n))
        (tmp_path / f"f{f}.jsonl").write_text("\n".join(lines) + ("\n" if f else ""), encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        good, bad = jsonl.read_tolerant(spark, str(tmp_path), "id string, query string", ["id", "query"])
        place = lambda df: sorted((r["file"].rsplit("/", 1)[1], r["line_num"]) for r in df.collect())
        assert good.rdd.getNumPartitions() > 3
        assert place(good) == sorted(want_good) and place(bad) == sorted(want_bad)
        assert all(r["id"].split("-")[1] == str(r["line_num"]) for r in good.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_ids_of_text_files(spark, tmp_path):
    for k, t in ((1, "a\nb"), (22, "c")):
        (tmp_path / f"item={k}").mkdir()
        (tmp_path / f"item={k}" / "x.txt").write_text(t)
    rows = jsonl.read_texts(spark, str(tmp_path), "item=([0-9]+)").collect()
    assert sorted((r["doc_id"], r["text"]) for r in rows) == [("1", "a\nb"), ("22", "c")]


def test_search_entry(spark):
    """Filters, expansion, one side alone and re-ranking through the one entry."""
    from stratatext.operators import bm25
    from stratatext.plans import search as plan

    texts = ["red apple pie", "green apple", "blue car engine", "fast auto race", "red car", "plain words here"]
    corpus = spark.createDataFrame([(f"d{i}", i, t, f"e{i % 2}") for i, t in enumerate(texts)], "id string, ord int, text string, edition_id string")
    near = spark.createDataFrame([(f"d{i}", [float(i == k) for k in range(6)]) for i in range(6)], "id string, embedding array<float>")
    asked = spark.createDataFrame([(1, "car")], "query_id int, text string")
    vec = spark.createDataFrame([(1, [0.0, 0.0, 0.0, 0.0, 1.0, 0.5])], "query_id int, embedding array<float>")
    index = bm25.build_index(corpus)
    ids = lambda df: [(r["id"], r["source"]) for r in df.orderBy("rank").collect()]
    args = (corpus, index, asked, near, vec)
    assert ids(plan.search(*args, top=3, score_threshold=0.1)) == [("d4", "vector"), ("d5", "vector"), ("d2", "bm25")]
    assert ids(plan.search(*args, top=3, score_threshold=0.1, mode="bm25")) == [("d4", "bm25"), ("d2", "bm25")]
    assert ids(plan.search(*args, top=1, score_threshold=0.1, mode="vector")) == [("d4", "vector")]
    assert ids(plan.search_by_edition(*args[:3], "e1", *args[3:], score_threshold=0.1)) == [("d5", "vector")]
    clusters = spark.createDataFrame([(0, "cars", ["car", "auto"])], "cluster_ord int, name string, terms array<string>")
    assert ("d3", "bm25") in ids(plan.search(*args, top=5, score_threshold=0.1, clusters=clusters))
    scores = spark.createDataFrame([(1, "d2", 4.0), (1, "d4", 1.0), (1, "d5", 2.0)], "query_id int, id string, relevance double")
    assert [i for i, _ in ids(plan.search(*args, top=3, score_threshold=0.1, relevance=scores))] == ["d2", "d5", "d4"]
