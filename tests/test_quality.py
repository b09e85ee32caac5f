"""Evidence, evaluation, metrics, ingest, streams and sources."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratatext.functions import classify as CL
from stratatext.functions import text as T
from stratatext.operators import evidence as EV
from stratatext.operators import ingest as IN
from stratatext.operators import metrics as M
from stratatext.operators import quality as QL
from stratatext.operators.places import seek
from stratatext.sources import dims, jsonl, tables
from stratatext.streaming import jobs as ST


def lcs(a, b):
    best, prev = 0, [0] * (len(b) + 1)
    for x in a:
        cur = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                cur[j + 1] = prev[j] + 1
                best = max(best, cur[j + 1])
        prev = cur
    return best


def test_grounding_equals_longest_common_substring(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("ab ") for _ in range(rnd.randint(1, 40)))
    answers = [(i, ". ".join(word() for _ in range(3))) for i in range(30)]
    ctx = [(i, k, f"q{i}{k}", word()) for i in range(30) for k in range(3)]
    a = spark.createDataFrame(answers, "answer_id int, answer string")
    c = spark.createDataFrame(ctx, "answer_id int, ctx_no int, quote_id string, text string")
    squash = lambda s: " ".join(s.split())
    for r in EV.ground_sentences(a, c).collect():
        mine = [x for x in ctx if x[0] == r["answer_id"]]
        ok = [x[2] for x in mine if lcs(squash(r["sentence"]), squash(x[3])) >= 8]
        assert r["quote_id"] == (ok[0] if ok else None)
    empty = spark.createDataFrame([(1, "")], "answer_id int, answer string")
    f = EV.faithfulness(empty, EV.ground_sentences(empty, c)).first()
    assert f["grounded_ratio"] == 1.0 and f["is_faithful"]


def test_evidence_verdicts(spark):
    a = spark.createDataFrame([(1, "근거문장 2020-14차|a|b|1 참고"), (2, "2020-14차|x|y|9"), (3, ""), (4, "근거 없음")], "answer_id int, answer string")
    h = spark.createDataFrame([(i, "2020-14차|a|b|1", "2020-14차", "근거문장 다른단어") for i in (1, 2, 3)], "answer_id int, quote_id string, edition_id string, text string")
    rows = {r["answer_id"]: r for r in EV.check_answers(a, h).collect()}
    assert [rows[i]["passed"] for i in (1, 2, 3, 4)] == [True, False, True, False]
    assert rows[1]["valid_ids"] == ["2020-14차|a|b|1"] and rows[1]["coverage"] == 0.5
    assert rows[2]["invalid_ids"] == ["2020-14차|x|y|9"]


def test_claim_sentences_have_right_offsets(spark):
    text = "첫 문장은 길게 쓴다. 짧다. 두 번째 문장도 길다.\n\n1. 번호는 자르지 않는다. 끝 문장이다"
    got = spark.createDataFrame([(text,)], "t string").select(EV.claim_sentences(F.col("t")).alias("c")).first()["c"]
    assert [c["text"] for c in got] == ["첫 문장은 길게 쓴다. 짧다", "두 번째 문장도 길다.", "1. 번호는 자르지 않는다. 끝 문장이다"]
    assert all(text[c["start"] : c["start"] + 3] == c["text"][:3] for c in got)


def test_claim_positions(spark):
    raw = "머리 글이 앞에 옵니다 그리고 길게 이어집니다.\n같은 문장은 두 번 나옵니다 정말로 두 번입니다.\n중간 글.\n같은 문장은 두 번 나옵니다 정말로 두 번입니다.\n"
    docs = spark.createDataFrame([(1, raw)], "doc_id int, text string")
    second = raw.rindex("같은")
    qs = spark.createDataFrame([("q1", 1, "e", 0, raw[:second]), ("q2", 1, "e", second, raw[second:])], "quote_id string, doc_id int, edition_id string, char_start long, text string")
    claims = EV.build_claims(qs)
    texts = {(r["quote_id"], r["sentence_no"]): r["text"] for r in claims.collect()}
    rows = EV.locate_claims(claims, docs).collect()
    assert len(rows) == len(texts) == 3
    for r in rows:
        text = texts[(r["quote_id"], r["sentence_no"])]
        assert raw[r["raw_start"] : r["raw_start"] + 20] == text[:20] and r["raw_end"] - r["raw_start"] == len(text)
        assert (r["raw_start"] == second) == (r["quote_id"] == "q2")


def test_places_equal_plain_search(spark):
    """Random texts over three letters, with overlapping, nested, absent, empty and null keys."""
    rnd = random.Random(5)
    rows, want = [], set()
    for doc in range(40):
        raw = None if doc == 0 else "".join(rnd.choice("aé한") for _ in range(rnd.choice([0, 5, 60, 400])))
        asked = []
        for tag in range(rnd.randint(0, 30)):
            at = rnd.randrange(len(raw) or 1) if raw else 0
            key = rnd.choice([(raw or "")[at : at + rnd.randint(1, 6)], "absent", "", None])
            hint = rnd.choice([None, 0, at, 10_000])
            place = raw.find(key, hint or 0) if raw and key else -1
            if place < 0 and raw and key:
                place = raw.find(key)
            asked.append((tag, key, hint))
            want.add((doc, tag, place if place >= 0 else None))
        rows.append((doc, raw, asked))
    df = spark.createDataFrame(rows, "doc int, raw string, asked array<struct<tag:int,key:string,hint:long>>")
    got = [tuple(r) for r in seek(df, "raw", "asked", ["doc"]).collect()]
    assert set(got) == want and len(got) == len(want)
    assert seek(df.where("false"), "raw", "asked", ["doc"]).count() == 0


def test_gate_and_report(spark):
    rows = [(str(i), "definition", i < 8, True, {"relevance": 4.0}) for i in range(10)]
    r = spark.createDataFrame(rows, "id string, query_type string, passed boolean, regression_passed boolean, scores map<string,double>")
    g = QL.quality_gate(r).first()
    assert g["pass_rate"] == 80.0 and g["gate_passed"]
    assert not QL.quality_gate(r.filter("false")).first()["gate_passed"]
    q = spark.createDataFrame([("1", "definition", "초판", "easy", ["c"]), ("2", "definition", None, "hard", [])], "id string, query_type string, expected_edition string, difficulty string, regression_checks array<string>")
    assert QL.report(r, q).first()["grade"] == "D"
    rules = {x["rule"] for x in QL.recommendations(r, q).collect()}
    assert {"coverage", "weak_axis"} <= rules and "ok" not in rules
    assert QL.axis_stats(r).filter("axis = 'faithfulness'").first()["mean"] == 0.0


def test_judge_and_route_replies(spark):
    df = spark.createDataFrame([('```json\n{"relevance": 9, "faithfulness": -1, "quote_accuracy": 4, "temporal_correctness": 3.5}\n```',), ("no",)], "t string")
    s = [r["s"] for r in df.select(CL.judge_scores(F.col("t")).alias("s")).collect()]
    assert (s[0]["relevance"], s[0]["faithfulness"], s[0]["unreadable"]) == (5.0, 0.0, False) and s[1]["unreadable"]
    r = spark.createDataFrame([('{"intent": "x", "confidence": 7, "type_filter": ["definition", "y"]}',), ("",)], "t string").select(CL.parse_route(F.col("t")).alias("r")).collect()
    assert r[0]["r"]["intent"] == "open_ended" and r[0]["r"]["confidence"] == 1.0 and r[0]["r"]["type_filter"] == ["definition"]
    assert r[1]["r"]["confidence"] == 0.5
    j = spark.createDataFrame([('{"a": [1, 2,],}',), ('{"a": "x"\n"b": 1}',), ("{",)], "t string").select(T.json_or_repaired(F.col("t")).alias("j")).collect()
    assert [x["j"] is not None for x in j] == [True, True, False]
    more = ['{"a":1},{"b":2}]', '{"a":1} trailing', "[1,2] x", '{"a":1}] x', '{"a":1}} x', '{"a":1}', "[1, 2]", "3", "", None]
    strict = [r["v"] is not None for r in spark.createDataFrame([(t,) for t in more], "t string").select(T.strict_json(F.col("t")).alias("v")).collect()]
    assert strict == [False] * 5 + [True] * 3 + [False] * 2


def test_output_schemas(spark):
    cite = '["a|b|c|1"]'
    rows = [
        (1, "summary", '{"title": "t", "body": "long enough body", "key_points": ["k"], "citations": %s}' % cite, True),
        (2, "card", '[{"front": "f", "back": "b", "citations": %s}, {"front": "", "back": "b", "citations": %s}]' % (cite, cite), False),
        (3, "quiz", '{"quizzes": [{"question": "q", "choices": ["1","2","3","4"], "correct_index": 3, "explanation": "e", "citations": %s}]}' % cite, True),
        (4, "comparison_table", '{"concept": "c", "columns": ["a","b"], "rows": [{"aspect": "x", "values": {"a": "1"}, "quote_ids": %s}]}' % cite, True),
        (5, "slide", '[{"slide_number": 0, "title": "t", "body": ["b"], "sources": %s}]' % cite, False),
        (6, "poem", "{}", False),
        (7, "card", "nothing", False),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "answer_id int, output_type string, reply string")
    assert {r["answer_id"]: r["passed"] for r in QL.validate_outputs(df).collect()} == {r[0]: r[3] for r in rows}


@pytest.mark.parametrize("values,want", [([1, 2, 3, 4, 5], 3.0), ([10, 20], 15.0), ([7], 7.0)])
def test_percentiles(spark, values, want):
    df = spark.createDataFrame([("g", float(v)) for v in values], "g string, v double")
    assert M.exact_percentiles(df, ["g"], "v", {"p50": 0.5}).first()["p50"] == want


def test_percentiles_of_a_hot_group(spark):
    rnd = random.Random(2)
    rows = [("hot" if rnd.random() < 0.8 else "cold", float(rnd.randint(0, 500))) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double")
    pdf = pd.DataFrame(rows, columns=["g", "v"]).groupby("g")["v"]
    for r in M.exact_percentiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95}, 8).collect():
        assert abs(r["p50"] - pdf.get_group(r["g"]).quantile(0.5)) < 1e-9 and abs(r["p95"] - pdf.get_group(r["g"]).quantile(0.95)) < 1e-9


def test_greedy_ingest_matches_row_by_row(spark):
    rnd = random.Random(4)
    rows = [(n, f"i{rnd.randint(0, 25)}", f"h{rnd.randint(0, 25)}") for n in range(60)]
    seen_i, seen_h, want = {"i1"}, {"h1"}, set()
    for n, i, h in rows:
        if i not in seen_i and h not in seen_h:
            seen_i.add(i)
            seen_h.add(h)
            want.add(n)
    inc = spark.createDataFrame(rows, "ord long, quote_id string, content_hash string")
    tab = spark.createDataFrame([("i1", "h1")], "quote_id string, content_hash string")
    assert {r["ord"] for r in IN.new_rows_greedy(inc, tab, "ord").collect()} == want
    abc = spark.createDataFrame([(1, "i1x", "h1x"), (2, "i2", "h1x"), (3, "i2", "h2")], inc.schema)
    assert {r["ord"] for r in IN.new_rows_greedy(abc, None, "ord").collect()} == {1, 3}
    assert {r["ord"] for r in IN.new_rows(abc, None, ["ord"]).collect()} == {1, 3}


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "quotes")
    rec = spark.createDataFrame([("q1", 1, "2020-14차", "narrative", "t", "", 0, 1, 1), ("q2", 1, "bad", "narrative", "t", "", 0, 1, 2)],
                                "quote_id string, doc_id int, edition_id string, type string, text string, sha256 string, char_start long, char_end long, start_line int")
    fresh, bad = tables.append_quotes(rec, path, [], ["start_line"])
    assert bad.count() == 1
    tables.append_quotes(rec, path, [], ["start_line"])
    assert spark.read.parquet(path).count() == 1


def test_jsonl_policies(spark, tmp_path):
    p = tmp_path / "q.jsonl"
    p.write_text('{"id": "a", "query": "x"}\n\n{bad\n{"query": "no id"}\n', encoding="utf-8")
    good, bad = jsonl.read_tolerant(spark, str(p), jsonl.QUESTION_SCHEMA, ["id", "query"])
    assert [r["id"] for r in good.collect()] == ["a"]
    assert sorted(r["message"] for r in bad.collect()) == ["missing: id", "unreadable JSON"]
    rows = jsonl.read_questions(spark, str(p)).collect()
    assert [(r["id"], r["query_type"], r["difficulty"]) for r in rows] == [("a", "unknown", "medium")]
    assert jsonl.read_results(spark, str(tmp_path / "none.jsonl")).count() == 0
    with pytest.raises(Exception):
        jsonl.read_strict(spark, str(p), jsonl.QUESTION_SCHEMA).collect()


def test_line_numbers_over_blocks(spark, tmp_path):
    """Numbers run through a file that several tasks read, and start anew in the next file."""
    for name, n in (("a", 700), ("b", 30)):
        (tmp_path / name).write_text("".join(f'{{"id": "{name}{i}", "query": "x"}}\n' if i % 7 else "\n{\n" for i in range(n)))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        good, bad = jsonl.read_tolerant(spark, str(tmp_path), jsonl.QUESTION_SCHEMA, ["id", "query"])
        got = {(r["file"][-1], r["line_num"]): r["id"] for r in good.collect()}
        broken = {(r["file"][-1], r["line_num"]) for r in bad.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    lines = {(name, k): x for name in "ab" for k, x in enumerate((tmp_path / name).read_text().split("\n"), 1)}
    assert got == {at: x.split('"')[3] for at, x in lines.items() if '"id"' in x}
    assert broken == {at for at, x in lines.items() if x == "{"}


def test_sinks_and_texts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("한 줄\n둘", encoding="utf-8")
    docs = jsonl.read_texts(spark, str(tmp_path / "in"))
    assert [(r["doc_id"], r["text"]) for r in docs.collect()] == [("a.txt", "한 줄\n둘")]
    out = str(tmp_path / "out")
    jsonl.write_records(docs.withColumn("edition_id", F.lit("e1")), out, "edition_id")
    row = spark.read.json(out).first()
    assert (row["edition_id"], row["text"]) == ("e1", "한 줄\n둘")


def test_dimensions(spark):
    data = {"editions_metadata": [{"edition_id": "e1", "year": 1979}], "concepts": [{"concept_id": "c", "name_ko": "k", "editions": {"e1": {"status": "introduced"}, "e9": None}}]}
    from stratatext.operators.temporal import explode_timeline

    rows = explode_timeline(*dims.concept_tables(spark, data)).orderBy("sort_year").collect()
    assert [(r["edition_id"], r["year"], r["status"]) for r in rows] == [("e1", 1979, "introduced"), ("e9", 0, "maintained")]


def test_token_bucket():
    out, tokens, last = ST.spend([0, 0, 0, 30, 90], 2.0, None, 1, 2)
    assert [o[0] for o in out] == [True, True, False, False, True]
    assert out[2][2] == 60.0 and last == 90


def test_registry_is_consistent():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 120


def test_json_parts_of_replies(spark):
    from stratatext.functions import text as T

    rows = [
        ('Here is: {"a": 1}', '{"a": 1}', 'Here is: {"a": 1}'),
        ("x [1,2]", "[1,2]", "x [1,2]"),
        ('```\nnope\n```\n{"b": 2}', '{"b": 2}', 'nope\n\n{"b": 2}'),
        ('```json\n{"a":1,}\n```', '{"a":1}', '{"a":1,}'),
        ('{"type": "card", "title": "hello", "items": ["a", 1, "b"], "end": "last"}', '{"type": "card", "title": "hello", "items": ["a", 1, "b"], "end": "last"}', "hello\na\nb\nlast"),
        ("**x** {y}", None, "x {y}"),
        (None, None, None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(rows)], "i int, t string")
    got = df.select("i", T.json_or_repaired(F.col("t")), T.clean_generated(F.col("t"))).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [(j, c) for _, j, c in rows]
