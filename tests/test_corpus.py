"""Lines, headers, segments and quotes against plain loops."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from stratatext import values as V
from stratatext.functions import text as T
from stratatext.functions import typing as Q
from stratatext.operators import headers as H
from stratatext.operators import lines as L
from stratatext.operators import quotes as QT
from stratatext.operators import scan
from stratatext.operators import segments as S

RULES = [("A", 1, "^#A"), ("B", 2, "^#B"), ("C", 3, "^#C")]


def random_docs(n, seed):
    rnd = random.Random(seed)
    docs = []
    for d in range(n):
        rows = []
        for _ in range(rnd.randint(0, 30)):
            kind = rnd.choice(["#A", "#B", "#C", "", "word " * rnd.randint(1, 6)])
            rows.append(kind + (str(rnd.randint(1, 2)) if kind.startswith("#") else ""))
        docs.append((d, f"e{d % 3}", "\n".join(rows) + rnd.choice(["", "\n"])))
    return docs


def stack_paths(text):
    depth = {"#A": 1, "#B": 2, "#C": 3}
    stack, out = [], []
    for i, line in enumerate(text.split("\n"), 1):
        k = depth.get(line[:2])
        if not k:
            continue
        while stack and stack[-1][0] >= k:
            stack.pop()
        stack.append((k, line))
        out.append((i, [t for _, t in stack]))
    return out


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\r\nb\rc\x0bd\x85e f\n\n", "\n\n", "a\x1cb"])
def test_lines_match_splitlines(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = df.select(T.lines_with_ends(F.col("text")).alias("x")).first()["x"]
    assert got == text.splitlines(keepends=True)
    rows = L.explode_lines(df, offsets=True).orderBy("line_no").collect()
    assert [r["line"] for r in rows] == text.splitlines()
    assert [r["char_end"] - r["char_start"] for r in rows] == [len(x) for x in text.splitlines(keepends=True)]


def test_paths_match_a_stack(spark):
    docs = random_docs(40, 1)
    df = spark.createDataFrame(docs, "doc_id long, edition_id string, text string")
    rows = H.add_paths(H.header_rows(df, RULES), RULES).collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["line"], r["path"]))
    for d, _, text in docs:
        assert sorted(got.get(d, [])) == stack_paths(text)


def fold_segments(text, min_tokens):
    lines = text.splitlines(keepends=True)
    paths = dict(stack_paths(text))
    starts = sorted({1, *paths}) if lines else []
    segs, pos = [], 0
    for s, e in zip(starts, [*starts[1:], len(lines) + 1]):
        body = "".join(lines[s - 1 : e - 1])
        seg = dict(text=body, line=s, path=paths.get(s, []), tok=len(body.split()), at=pos)
        pos += len(body)
        if not body.strip():
            continue
        if segs and seg["tok"] < min_tokens and segs[-1]["path"] == seg["path"]:
            segs[-1]["text"] += body
            segs[-1]["tok"] += seg["tok"]
        else:
            segs.append(seg)
    return [(s["line"], s["path"], s["text"], s["tok"], s["at"]) for s in segs]


def test_segments_match_a_fold(spark):
    docs = random_docs(40, 2)
    df = spark.createDataFrame(docs, "doc_id long, edition_id string, text string")
    got = {}
    for r in S.segments(df, RULES, 6).collect():
        got.setdefault(r["doc_id"], []).append((r["start_line"], r["section_path"], r["text"], r["token_count"], r["char_start"]))
    for d, _, text in docs:
        assert sorted(got.get(d, [])) == sorted(fold_segments(text, 6))


def fold_split(text, above, limit, overlap):
    if len(text) <= above:
        return [text]
    parts, cur = [], []
    for line in text.splitlines(keepends=True):
        if cur and sum(map(len, cur)) + len(line) > limit:
            parts.append("".join(cur))
            keep, tok = [], 0
            for back in reversed(cur):
                keep.insert(0, back)
                tok += len(back.split())
                if tok >= overlap:
                    break
            cur = keep
        cur.append(line)
    return parts + ["".join(cur)]


def test_split_matches_a_fold(spark):
    rnd = random.Random(3)
    texts = ["".join("w" * rnd.randint(1, 9) + rnd.choice([" ", "\n"]) for _ in range(rnd.randint(1, 120))) for _ in range(30)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["p"] for r in df.select(S.split_parts(F.col("t"), 90, 60, 4).alias("p")).collect()]
    assert got == [fold_split(t, 90, 60, 4) for t in texts]


def test_edition_lines(spark):
    text = "머리말\n1979년 초판\nx\n1989년 12월\n7차 1990년 | 전면보완\n2008년 주요 개정 내용\n'79. 3.31\n2004년 11차 | 전면 보완\ny\n"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = L.edition_boundaries(df).orderBy("start_line").collect()
    assert [(r["edition_id"], r["start_line"], r["end_line"]) for r in rows] == [("1979-초판", 2, 4), ("1990-7차", 5, 7), ("2004-11차", 8, 9)]
    cut = L.split_editions(df).orderBy("start_line").collect()
    assert all(text[r["char_start"] : r["char_end"]] == r["text"] for r in cut)
    assert cut[0]["text"].startswith("1979년 초판")


def test_default_rules_on_korean_text(spark):
    texts = {
        "경영이란 사람을 다루는 것을 말한다.": "definition",
        "예를 들면 다음과 같다": "example",
        "가. 하나\n나. 둘\n다. 셋": "checklist",
        "첫째 이것이다. 먼저 준비한다. ": "procedure",
        "경영의 기본은 사람이다": "principle",
        "그냥 글이다": "narrative",
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["k"] for r in df.select("t", Q.quote_type(F.col("t")).alias("k")).collect()}
    assert got == texts
    flags = spark.createDataFrame([("a □ (별첨)",), ("12\n",), ("├ x",)], "t string").select(Q.quality_flags(F.col("t")).alias("f")).collect()
    assert [r["f"] for r in flags] == [["ocr_error", "reference_unresolved"], ["page_header_leak"], ["table_broken"]]


def test_quote_ids_and_validation(spark):
    df = spark.createDataFrame([(1, "2020-14차", "기업관\n1. 사람\n본문 글\n"), (2, "2020-14차", "기업관\n1. 사람\n다른 글\n")], "doc_id long, edition_id string, text string")
    qs = QT.build_quotes(df, min_tokens=1, edition_spans_docs=True)
    rows = {(r["doc_id"], r["start_line"]): r for r in qs.collect()}
    assert rows[(2, 2)]["quote_id"] == "2020-14차|기업관>1. 사람|narrative|002"
    assert rows[(1, 2)]["sha256"] == hashlib.sha256("1. 사람\n본문 글\n".encode()).hexdigest()
    good, bad = QT.validate(qs.unionByName(qs.withColumn("start_line", F.lit(0))))
    assert good.count() == 4 and {tuple(r["errors"]) for r in bad.collect()} == {("start_line",)}


def test_hot_group_numbering(spark):
    n = 3000
    df = spark.range(n).select((F.col("id") % 500).alias("doc"), F.col("id").alias("line"), F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("g"))
    bounds = scan.range_bounds(df, "doc", 8)
    rows = scan.sequence_in_groups(df, ["g"], "doc", ["line"], "seq", bounds).collect()
    want = {}
    for r in sorted(rows, key=lambda r: (r["doc"], r["line"])):
        want[r["g"]] = want.get(r["g"], 0) + 1
        assert r["seq"] == want[r["g"]]


def test_gaps_and_section_text(spark):
    text = "\n".join(["#A1"] + ["x"] * 5 + ["#B1", "y", "z"] + ["q"] * 4)
    df = spark.createDataFrame([(1, "e", text)], "doc_id long, edition_id string, text string")
    gaps = H.header_gaps(df, RULES, 3).orderBy("start_line").collect()
    assert [(g["start_line"], g["end_line"], g["gap_lines"]) for g in gaps] == [(1, 7, 6), (7, 13, 6)]
    got = H.section_text(df, spark.createDataFrame([(1, 7)], "doc_id long, line int"), RULES).first()
    assert got["section_text"] == "\n".join(["#B1", "y", "z", "q", "q", "q"])
    assert V.HEADER_GAP_LINES == 200
