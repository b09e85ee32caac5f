"""Keyword, vector and fused search, policies and lookups against plain code."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from stratatext import values as V
from stratatext.functions import classify as CL
from stratatext.functions import editions as E
from stratatext.operators import bm25, fusion, lookup, policy, temporal, textjoin, vectors

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa".split()


def corpus_rows(seed, n=60):
    rnd = random.Random(seed)
    return [(i, i, " ".join(rnd.choice(WORDS + ["the"] * 6) for _ in range(rnd.randint(0, 25)))) for i in range(n)]


def okapi(rows, query, k1=1.5, b=0.75, eps=0.25):
    docs = [t.split() for *_, t in rows]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(w for d in docs for w in set(d))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = eps * sum(idf.values()) / len(idf)
    idf = {w: (floor if v < 0 else v) for w, v in idf.items()}
    out = []
    for (i, _, _), d in zip(rows, docs):
        tf = Counter(d)
        s = sum(idf.get(w, 0) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(d) / avg)) for w in query.split() if tf[w])
        out.append((round(s, 9), i))
    return sorted([x for x in out if x[0] > 0], key=lambda x: (-x[0], x[1]))


def test_bm25_matches_okapi_and_salting_changes_nothing(spark):
    rows = corpus_rows(1)
    index = bm25.build_index(spark.createDataFrame(rows, "id long, ord long, text string"))
    queries = [(1, "alpha the beta alpha"), (2, "nothing"), (3, "kappa iota the")]
    q = spark.createDataFrame(queries, "query_id long, text string")
    got = bm25.bm25_search(index, q, 7).orderBy("query_id", "rank").collect()
    for qid, text in queries:
        want = okapi(rows, text)[:7]
        mine = [(round(r["score"], 9), r["id"]) for r in got if r["query_id"] == qid]
        assert [i for _, i in mine] == [i for _, i in want]
        assert np.allclose([s for s, _ in mine], [s for s, _ in want], atol=1e-8)
    salted = bm25.top_k(bm25.scores(index, q, broadcast_rows=1, salts=3), 7).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"], r["score"]) for r in salted] == [(r["query_id"], r["id"], r["score"]) for r in got]


def test_pre_and_post_filters(spark):
    rows = corpus_rows(2)
    df = spark.createDataFrame(rows, "id long, ord long, text string")
    index, q = bm25.build_index(df), spark.createDataFrame([(1, "alpha beta")], "query_id long, text string")
    ranked = okapi(rows, "alpha beta")
    cond = F.col("id") % 5 == 0
    post = [r["id"] for r in bm25.bm25_search(index, q, 4, df, cond, "post").orderBy("rank").collect()]
    assert post == [i for _, i in ranked[:12] if i % 5 == 0][:4]
    pre = [r["id"] for r in bm25.bm25_search(index, q, 4, df, cond).orderBy("rank").collect()]
    assert pre == [i for _, i in ranked if i % 5 == 0][:4]


def test_saved_index(spark, tmp_path):
    rows = corpus_rows(3)
    index = bm25.build_index(spark.createDataFrame(rows, "id long, ord long, text string"))
    bm25.save_index(index, str(tmp_path))
    again = bm25.load_index(spark, str(tmp_path))
    q = spark.createDataFrame([(1, "alpha gamma")], "query_id long, text string")
    one, two = (sorted(map(tuple, bm25.bm25_search(i, q, 5).collect())) for i in (index, again))
    assert one == two


def test_vector_paths_agree_with_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)).astype("float32")
    x[10] = x[20]
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(300)], "id long, embedding array<float>")
    q = df.filter("id < 12").select(F.col("id").alias("query_id"), "embedding")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = {}
    for i in range(12):
        s = np.round(unit @ unit[i], 9)
        want[i] = [int(j) for j in np.lexsort((np.arange(300), -s))[:5] if s[j] >= 0.3]
    for kwargs in ({}, {"query_block": 5, "corpus_chunk": 70}):
        got = {}
        for r in vectors.vector_search(df, q, 5, 0.3, **kwargs).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["id"])
        assert got == want


def test_fusion_ties_and_rerank(spark):
    vec = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, id string, rank int")
    kw = spark.createDataFrame([(1, "c", 1), (1, "b", 2), (1, "d", 3)], "query_id int, id string, rank int")
    rows = fusion.rrf_fusion(vec, kw, alpha=0.5, top=4).orderBy("rank").collect()
    assert [r["id"] for r in rows] == ["b", "a", "c", "d"]
    assert abs(rows[0]["score"] - (0.5 / 62 + 0.5 / 62)) < 1e-9
    hits = spark.createDataFrame([(1, i, n + 1, 1.0, "x") for n, i in enumerate("abc")] + [(2, "z", 1, 0.5, "x")], "query_id int, id string, rank int, score double, source string")
    scores = spark.createDataFrame([(1, "a", -5.0), (1, "b", 3.0), (1, "c", 1.0)], "query_id int, id string, relevance double")
    out = fusion.rerank(hits, scores, 2, 0.5).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"], r["source"]) for r in out] == [(1, "b", "reranked"), (1, "c", "reranked"), (2, "z", "x")]


def test_repair_order_cases():
    hits = [("1", "x"), ("2", "x"), ("3", "x"), ("4", "y")]
    assert policy.repair_order(hits, [("n", "z")], 4) == ["1", "2", "4", "n"]
    assert policy.repair_order([("1", "x"), ("2", "y")], [("n", "z")], 2) == ["1", "n"]
    assert policy.repair_order(hits, [("1", "x")], 4) == ["1", "2", "3", "4"]
    rnd = random.Random(5)
    for _ in range(200):
        base = [(f"h{i}", rnd.choice("abc")) for i in range(rnd.randint(0, 6))]
        extra = [(f"n{e}", e) for e in "de" if rnd.random() < 0.7]
        out = policy.repair_order(base, extra, 6)
        assert len(out) <= 6 and all(i in out for i, _ in extra)


def test_coverage_repair_on_tables(spark):
    hits = spark.createDataFrame([(1, n, f"a{n}", "1979-초판") for n in (1, 2, 3)] + [(2, 1, "b1", "2020-14차")], "query_id int, rank int, id string, edition_id string")
    best = spark.createDataFrame([(1, "n1", "2020-14차"), (1, "a1", "1979-초판")], "query_id int, id string, edition_id string")
    need = spark.createDataFrame([(1, "1979-초판", 0), (1, "2020-14차", 1), (2, "1979-초판", 0)], "query_id int, edition_id string, ord int")
    rows = policy.ensure_coverage(hits, best, need, 3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"]) for r in rows] == [(1, "a1"), (1, "a2"), (1, "n1"), (2, "b1")]


def test_policy_and_classification(spark):
    cases = {
        "SUPEX란 무엇인가?": "definition", "초판에서 인사관리의 범위는?": "single_version", "초판과 14차 비교": "cross_version",
        "현행 가치 설명": "single_version", "가장 강조하는 것은?": "open_ended", "": "open_ended", "what is VWBE": "definition",
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r["t"]: r["c"] for r in df.select("t", CL.classify_query(F.col("t")).alias("c")).collect()}
    assert {t: c["query_type"] for t, c in got.items()} == cases
    assert got["초판에서 인사관리의 범위는?"]["edition_hint"] == "1979-초판"
    hints = spark.createDataFrame([("14차와 초판, 1998년 차이",)], "t string").select(E.hints_in(F.col("t")).alias("h")).first()["h"]
    assert hints == ["1979-초판", "1998-10차", "2020-14차"]
    q = spark.createDataFrame([(1, "open_ended"), (2, "evolution_comparison"), (3, "specific_time")], "query_id int, intent string")
    rows = {r["query_id"]: r for r in CL.apply_policy(q).collect()}
    assert rows[1]["edition_filter"] == "2020-14차" and rows[1]["fallback_editions"] == ["2016-13차", "2008-12차"]
    assert rows[2]["edition_filter"] is None and rows[3]["min_hits"] == 0


def test_intent_order(spark):
    rows = [(1, 1, "a", "2016-13차", 13, "general_definition", None, False), (1, 2, "b", "2020-14차", 14, "general_definition", None, False),
            (2, 1, "a", "2016-13차", 13, "specific_time", "2020", False), (2, 2, "b", "2020-14차", 14, "specific_time", "2020", False),
            (3, 1, "a", "2016-13차", 13, "specific_time", "1979", False), (3, 2, "b", "2020-14차", 14, "specific_time", "1979", False)]
    df = spark.createDataFrame(rows, "query_id int, rank int, id string, edition_id string, sort_key int, intent string, edition_hint string, latest_first boolean")
    out = [(r["query_id"], r["id"]) for r in fusion.order_by_intent(df).orderBy("query_id", "rank").collect()]
    assert out == [(1, "b"), (1, "a"), (2, "b"), (3, "a"), (3, "b")]


def test_contains_and_passage_joins(spark):
    rnd = random.Random(7)
    texts = [(i, " ".join(rnd.choice(WORDS) for _ in range(30))) for i in range(30)]
    needles = [(j, t[rnd.randint(0, 20) :][: rnd.randint(1, 60)]) for j, (_, t) in enumerate(texts)] + [(99, "absent words that never occur here")]
    needles = [(j, s) for j, s in needles if s.strip()]
    want = {(i, j) for i, t in texts for j, s in needles if s in t}
    a = spark.createDataFrame(texts, "i int, t string")
    b = spark.createDataFrame(needles, "j int, s string")
    for join in (textjoin.contains_join, textjoin.passage_join):
        assert {(r["i"], r["j"]) for r in join(a, "t", b, "s").select("i", "j").collect()} == want


def test_fuzzy_passages(spark):
    rows = [(1, 1, "alpha beta gamma delta"), (2, 2, "zeta eta theta"), (3, 3, "iota kappa"), (4, 4, "mu nu")]
    df = spark.createDataFrame(rows, "id long, ord long, text string")
    q = spark.createDataFrame([(1, "beta gamma"), (2, "alpha betX gamma")], "query_id int, text string")
    out = {r["query_id"]: r for r in lookup.find_passages(bm25.build_index(df), df, q).collect()}
    assert out[1]["how"] == "exact" and out[2]["how"] == "fuzzy" and out[2]["id"] == 1 and 0.8 < out[2]["score"] < 1


def test_canonical_and_synonyms(spark):
    items = spark.createDataFrame([("c1", 0, "구성원 행복"), ("c2", 1, "행복"), ("c3", 2, "사회적 가치·신뢰")], "item_id string, ord int, subject string")
    q = spark.createDataFrame([(1, "행복"), (2, "구성원 행복 정의"), (3, "신뢰 문화"), (4, "없음")], "query_id int, text string")
    assert {r["query_id"]: (r["item_id"], r["how"]) for r in lookup.canonical_lookup(q, items).collect()} == {1: ("c2", 1), 2: ("c1", 2), 3: ("c3", 3)}
    cl = spark.createDataFrame([(0, "A", ["인사관리", "인적 관리"]), (1, "B", ["OJT", "직장내교육"])], "cluster_ord int, name string, terms array<string>")
    q = spark.createDataFrame([(1, "인사 관리와 O.J.T"), (2, "기타")], "query_id int, text string")
    out = {r["query_id"]: r["expanded"] for r in lookup.expand_queries(q, cl).collect()}
    assert out == {1: "인사 관리와 O.J.T 인적 관리 직장내교육", 2: "기타"}
    s = lookup.synonym_stats(cl).first()
    assert (s["clusters"], s["terms"], s["pairs"]) == (2, 4, 2)


def test_warnings(spark):
    hits = spark.createDataFrame([(1, 1, "1979-초판", "definition"), (1, 2, "2020-14차", "definition")], "query_id int, rank int, edition_id string, type string")
    q = spark.createDataFrame([(1, "의욕관리 변화", "1979-초판")], "query_id int, text string, edition_hint string")
    concepts = spark.createDataFrame([("m", 0, "의욕관리", "Motivation", "x", "1981-1차", "2004-11차")], "concept_id string, concept_ord int, name_ko string, name_en string, category string, first_edition string, last_edition string")
    statuses = spark.createDataFrame([("m", "1981-1차", 1981, "introduced", ""), ("m", "1998-10차", 1998, "renamed", "n")], "concept_id string, edition_id string, year int, status string, note string")
    known = spark.createDataFrame([(0, "의욕관리", "motivation_mgmt", ["1979-초판", "2020-14차"])], "ord int, concept string, concept_id string, editions array<string>")
    m = temporal.match_concepts(q, concepts, "name_in_query")
    rows = temporal.warnings(hits, q, m, concepts, statuses, known, 5).orderBy("warning_no").collect()
    assert [(r["rule_id"], r["concept"]) for r in rows] == [("TC-001", temporal.DEFINITIONS_LABEL), ("TC-002", "의욕관리"), ("TC-003", "의욕관리"), ("TC-004", "의욕관리"), ("TC-001", "의욕관리")]
    assert temporal.warnings(hits, q, m, concepts, statuses, known).count() == 3
    assert V.EDITIONS[0][1] == 1979


def test_grouped_vectors_in_tiles(spark):
    """Every group keeps its own best rows, whatever the tile size, and a null group meets all."""
    import numpy as np

    from stratatext.operators.vectors import vector_search

    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(60, 5)), rng.normal(size=(9, 5))
    corpus = spark.createDataFrame([(i, v.tolist(), f"e{i % 3}") for i, v in enumerate(x)], "id long, embedding array<double>, edition_id string")
    asked = spark.createDataFrame([(i, v.tolist(), [None, "e1", "zz"][i % 3]) for i, v in enumerate(q)], "query_id long, embedding array<double>, group string")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(unit(q) @ unit(x).T, 9)
    want = set()
    for i in range(9):
        ok = [j for j in range(60) if i % 3 == 0 or (i % 3 == 1 and j % 3 == 1)]
        want |= {(i, r + 1, j) for r, j in enumerate(sorted(ok, key=lambda j: (-s[i, j], j))[:4])}
    for more in ({}, {"tile_bytes": 1}, {"query_block": 2, "corpus_chunk": 20}):
        got = vector_search(corpus, asked, 4, -1.0, group="edition_id", **more)
        assert {(r["query_id"], r["rank"], r["id"]) for r in got.collect()} == want


def test_stages_of_unlisted_editions(spark):
    from stratatext.plans.retrieve import _vector_by_stage

    corpus = spark.createDataFrame([(1, [1.0, 0.0], "zz"), (2, [1.0, 0.1], "e1")], "id long, embedding array<double>, edition_id string")
    vectors = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, embedding array<double>")
    searched = spark.createDataFrame([(7, 0, "zz"), (7, 1, "e1"), (7, 2, None)], "query_id long, stage int, edition_id string")
    got = {(r["stage"], r["id"], r["rank"]) for r in _vector_by_stage(corpus, vectors, searched, 5, 0.1).collect()}
    assert got == {(0, 1, 1), (1, 2, 1), (2, 1, 1), (2, 2, 2)}


def test_fuzzy_lookup_asks_for_all_turns(spark):
    from registry.requests import asked_passages

    sf = "/root/testdata/sf0.001"
    asked = asked_passages(spark, sf).where("query_id >= 0")
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    assert asked.count() == turns.count() > turns.where("role = 'system'").count()
