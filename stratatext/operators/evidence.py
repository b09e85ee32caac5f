"""Answers against their evidence: citations, coverage, grounding, verdicts."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .. import values as V
from ..functions import text as T
from ..session import stored
from .places import seek

WORDS = r"(?U)[\w가-힣]{4,}"


def citations(answer: Column, pattern: str = V.CITATION, lenient: bool = False) -> Column:
    """Distinct cited quote ids in the order they appear.

    The strict pattern allows no blanks inside an id; ``lenient`` does.
    """
    used = pattern.replace(r"[^|\s]+", r"[^|\n]+") if lenient else pattern
    return F.array_distinct(F.regexp_extract_all(answer, F.lit("(?U)" + used), 1))


def references(text: Column) -> Column:
    """Distinct ids inside ``(Ref: ...)`` marks, first seen first."""
    ids = F.transform(F.regexp_extract_all(text, F.lit(V.REF_MARK), 1), T.strip)
    return F.array_distinct(F.filter(ids, lambda i: i != F.lit("")))


def mentioned_editions(answer: Column, years: list[int] = V.REVISION_YEARS, current: str = V.CURRENT_EDITION) -> Column:
    """Editions an answer mentions by revision, as first or as current edition, sorted."""
    revs = F.regexp_extract_all(answer, F.lit(r"(\d{1,2})차"), 1)
    by_rev = [
        F.when(F.array_contains(revs, F.lit(str(n))), F.lit(f"{years[n]}-{n}차")) for n in range(1, len(years))
    ]
    rest = [
        F.when(F.contains(answer, F.lit("초판")), F.lit(f"{years[0]}-초판")),
        F.when(F.contains(answer, F.lit(V.CURRENT_WORD)), F.lit(current)),
    ]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*by_rev, *rest))))


def hallucination_flags(answer: Column, rules: list[tuple[str, str]] = V.HALLUCINATION_RULES) -> Column:
    return F.array_compact(F.array(*[F.when(T.matches(answer, p), F.lit(name)) for name, p in rules]))


def coverage(answer: Column, hit_texts: Column) -> Column:
    """Share of the hits' distinct words (4+ characters) that occur in the answer.

    Words are tested as substrings.  No words, no coverage.
    """

    def share(words: Column) -> Column:
        hit = F.size(F.filter(words, lambda w: F.contains(answer, w)))
        return F.when(F.size(words) > 0, hit / F.size(words)).otherwise(0.0)

    words = F.array_distinct(F.flatten(F.transform(hit_texts, lambda t: F.regexp_extract_all(t, F.lit(WORDS), 0))))
    return T.let(words, share)


def check_answers(
    answers: DataFrame, hits: DataFrame, min_coverage: float = 0.0, max_invalid: int = 0,
    check_editions: bool = True, check_hallucination: bool = True,
) -> DataFrame:
    """Evidence check per answer ``(answer_id, answer)`` against hits ``(answer_id, quote_id, edition_id, text)``.

    An empty answer passes; an answer without hits fails; otherwise too many
    unknown citations or too little coverage fail.  Hits per answer are a top-k.
    """
    per = hits.groupBy("answer_id").agg(
        F.collect_set("quote_id").alias("ids"),
        F.collect_set("edition_id").alias("editions"),
        F.array_distinct(F.collect_list("text")).alias("texts"),
    )
    none = F.array().cast("array<string>")
    joined = answers.join(per, "answer_id", "left")
    empty = F.coalesce(F.col("answer"), F.lit("")) == ""
    bare = empty | F.col("ids").isNull()
    out = joined.withColumn("bare", bare)
    guard = lambda c: F.when(~F.col("bare"), c).otherwise(none)
    out = out.withColumn("cited", guard(citations(F.col("answer"))))
    out = out.withColumns(
        {
            "valid_ids": guard(F.array_intersect("cited", "ids")),
            "invalid_ids": guard(F.array_except("cited", "ids")),
            "cited_editions": guard(mentioned_editions(F.col("answer")) if check_editions else none),
            "flags": guard(hallucination_flags(F.col("answer")) if check_hallucination else none),
            "coverage": F.when(F.col("bare"), 0.0).otherwise(coverage(F.col("answer"), F.col("texts"))),
        }
    )
    ok = F.size("invalid_ids") <= max_invalid
    if min_coverage > 0:
        ok = ok & (F.col("coverage") >= min_coverage)
    return out.withColumn(
        "unsupported_editions", guard(F.array_except("cited_editions", "editions"))
    ).select(
        "answer_id", "cited", "valid_ids", "invalid_ids", "cited_editions", "unsupported_editions", "flags", "coverage",
        F.when(F.col("bare"), empty).otherwise(ok).alias("passed"),
    )


def sentences(text: Column) -> Column:
    """Pieces ending in a sentence mark followed by blanks; empty ones dropped."""
    parts = F.split(T.strip(text), r"(?<=[.!?\x{3002}])" + T.BLANK_CLASS + "+")
    return F.filter(F.transform(parts, T.strip), lambda s: s != F.lit(""))


def ground_sentences(answers: DataFrame, contexts: DataFrame, min_chars: int = V.MIN_SHARED_CHARS) -> DataFrame:
    """Sentences of each answer with the first context they share ``min_chars`` characters with.

    Two texts share a substring of n characters exactly when one of the
    sentence's n-grams occurs in the context (blanks squeezed in both).  Contexts
    ``(answer_id, ctx_no, quote_id, text)`` meet their answer in an equi-join; each
    (answer, context) row tests its sentences and stops at the first n-gram found,
    so no n-gram is ever shuffled and no answer's contexts are gathered.
    """
    split = answers.select("answer_id", sentences(F.col("answer")).alias("sentences"))
    held = contexts.select("answer_id", "ctx_no", "quote_id", T.squash(F.col("text")).alias("ctx_text"))

    def occurs(sentence: Column) -> Column:
        def any_gram(s: Column) -> Column:
            last = F.length(s) - (min_chars - 1)
            at = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
            return F.exists(at, lambda i: F.contains(F.col("ctx_text"), s.substr(i, F.lit(min_chars))))

        return T.let(T.squash(sentence), any_gram)

    tested = split.join(held, "answer_id").select(
        "answer_id", F.struct("ctx_no", "quote_id").alias("ctx"),
        F.posexplode(F.transform("sentences", occurs)).alias("sentence_no", "found"),
    )
    first = tested.filter("found").groupBy("answer_id", "sentence_no").agg(F.min("ctx").alias("ctx"))
    sents = split.select("answer_id", F.posexplode("sentences").alias("sentence_no", "sentence"))
    return sents.join(first, ["answer_id", "sentence_no"], "left").select(
        "answer_id", "sentence_no", "sentence", F.col("ctx").isNotNull().alias("grounded"), F.col("ctx.quote_id").alias("quote_id")
    )


def faithfulness(answers: DataFrame, grounded: DataFrame) -> DataFrame:
    """Per answer: counts, ratio (1.0 without sentences) and whether all are grounded."""
    per = grounded.groupBy("answer_id").agg(
        F.count_if("grounded").alias("grounded_count"), F.count_if(~F.col("grounded")).alias("ungrounded_count")
    )
    g, u = F.coalesce("grounded_count", F.lit(0)), F.coalesce("ungrounded_count", F.lit(0))
    return answers.select("answer_id").join(per, "answer_id", "left").select(
        "answer_id", g.alias("grounded_count"), u.alias("ungrounded_count"),
        F.when(g + u > 0, g / (g + u)).otherwise(1.0).alias("grounded_ratio"), (u == 0).alias("is_faithful"),
    )


def pack_context(hits: DataFrame) -> DataFrame:
    """One context text per query: numbered chunks with a metadata head, in rank order."""
    section = F.when(F.size("section_path") > 0, F.array_join("section_path", " > ")).otherwise("unknown")
    chunk = F.format_string(
        "[CHUNK %d]\nquote_id: %s\nedition: %s\nsection: %s\ntype: %s\nquality_flags: [%s]\n---\n%s\n",
        F.col("rank"), F.col("quote_id"), F.col("edition_id"), section, F.col("type"),
        F.array_join(F.transform("quality_flags", lambda f: F.concat(F.lit("'"), f, F.lit("'"))), ", "), F.col("text"),
    )
    return _join_in_rank_order(hits, chunk, "context")


def judge_context(hits: DataFrame, max_chars: int = 200) -> DataFrame:
    """One line per hit, texts cut at ``max_chars``."""
    cut = F.when(F.length("text") > max_chars, F.concat(F.substring("text", 1, max_chars), F.lit("..."))).otherwise(F.col("text"))
    return _join_in_rank_order(hits, F.concat(F.lit("- ["), F.col("edition_id"), F.lit("] "), cut), "context")


def _join_in_rank_order(hits: DataFrame, piece: Column, out: str) -> DataFrame:
    return hits.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", piece.alias("p")))), lambda x: x["p"]), "\n").alias(out)
    )


# -- claims ----------------------------------------------------------------------


def walk(text: str, parts: Iterable[str]) -> list[dict]:
    """Parts with their places in the text; short ones end the part before them."""
    out: list[dict] = []
    at = 0
    for part in parts:
        found = text.find(part, at)
        begin = found if found >= 0 else at
        at = begin + len(part)
        if out and len(part) < 10:
            out[-1] = {"text": f"{out[-1]['text']}. {part}", "start": out[-1]["start"], "end": at}
        else:
            out.append({"text": part, "start": begin, "end": at})
    return out


# One forward pass: an expression that carries the pieces so far copies them, and the rest of the text, at each.
@F.pandas_udf(ArrayType(StructType([StructField("text", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])))
def _walk(text: pd.Series, parts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or p is None else walk(t, p) for t, p in zip(text, parts, strict=True)])


def claim_sentences(text: Column) -> Column:
    """Array of (text, start, end): paragraphs cut after a period that follows no digit.

    Pieces under ten characters join the piece before them.  Positions are
    0-based character offsets, searched forward from the last end.
    """
    normal = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    paras = F.filter(F.transform(F.split(normal, r"\n{2,}"), T.strip), lambda p: p != F.lit(""))
    cut = r"(?<=[^0-9])\.[" + T.BLANK_CLASS[1:-1] + "]+"
    parts = F.filter(
        F.flatten(F.transform(paras, lambda p: F.transform(F.split(p, cut), T.strip))), lambda p: p != F.lit("")
    )
    return _walk(text, parts)


def claim_type(text: Column, groups: list = V.CLAIM_PATTERNS, default: str = V.CLAIM_DEFAULT) -> Column:
    out = F.lit(default)
    for name, patterns in reversed(groups):
        any_hit = F.lit(False)
        for p in patterns:
            any_hit = any_hit | T.matches(text, p)
        out = F.when(any_hit, F.lit(name)).otherwise(out)
    return out


def claim_subject(text: Column, keywords: list[str] = V.SUBJECT_KEYWORDS, token: str = V.SUBJECT_TOKEN, default: str = V.SUBJECT_DEFAULT) -> Column:
    """Longest keyword in the text, else the word before a topic particle."""
    found = F.regexp_extract(text, T.rx(token), 1)
    # Among keywords of one length the first listed wins.
    best = [F.when(F.contains(text, F.lit(k)), F.lit(k)) for k in sorted(keywords, key=len, reverse=True)]
    return F.coalesce(*best, F.when(found != "", found), F.lit(default))


def build_claims(quotes: DataFrame, groups: list = V.CLAIM_PATTERNS, keywords: list[str] = V.SUBJECT_KEYWORDS, token: str = V.SUBJECT_TOKEN, min_chars: int = V.CLAIM_MIN_CHARS) -> DataFrame:
    """Claims of each quote with type, subject, hash and span inside the corpus text."""
    rows = quotes.select(
        "quote_id", "doc_id", "edition_id", "char_start", F.posexplode(claim_sentences(F.col("text"))).alias("n", "s")
    ).select("*", F.col("s.text").alias("text")).filter(
        (F.length("text") >= min_chars) & ~T.matches(F.col("text"), V.CLAIM_NUMBER_ONLY) & ~T.matches(F.col("text"), V.CLAIM_DATE_ONLY)
    )
    t = F.col("text")
    return rows.select(
        "quote_id", "doc_id", "edition_id", F.col("n").alias("sentence_no"),
        claim_type(t, groups).alias("claim_type"), claim_subject(t, keywords, token).alias("subject"), "text",
        (F.col("char_start") + F.col("s.start")).alias("span_start"), (F.col("char_start") + F.col("s.end")).alias("span_end"),
        F.sha2("text", 256).alias("sha256"),
    )


def locate_claims(claims: DataFrame, docs: DataFrame, key_chars: int = 30) -> DataFrame:
    """Claim positions in the raw text: first place of its first 30 characters, else its quote span.

    Sought from the quote's start, then from the top.  A document's text is read once for
    all its claims (:mod:`places`), and only their keys meet it; a null text leaves the spans.
    """
    tag = F.struct("quote_id", "sentence_no", "span_start", F.length("text").alias("n_chars")).alias("tag")
    asked = F.struct(tag, F.substring("text", 1, key_chars).alias("key"), F.col("span_start").alias("hint"))
    per_doc = claims.groupBy("doc_id").agg(F.collect_list(asked).alias("asked"))
    found = seek(docs.select("doc_id", F.col("text").alias("raw")).join(per_doc, "doc_id"), "raw", "asked", ["doc_id"])
    at = F.coalesce("at", F.col("tag.span_start").cast("long"))
    return found.select("doc_id", "tag.quote_id", "tag.sentence_no", at.alias("raw_start"), (at + F.col("tag.n_chars")).alias("raw_end"))


def claim_summary(claims: DataFrame, top: int = 10) -> DataFrame:
    """Counts per type and the most frequent subjects as (kind, name, claims)."""
    # The claims are made once; their counts are read three times.
    counts = stored(claims.groupBy("claim_type", "subject").agg(F.count(F.lit(1)).alias("n")), "claim-counts")
    total = F.sum("n").alias("claims")
    by_type = counts.groupBy(F.col("claim_type").alias("name")).agg(total).withColumn("kind", F.lit("type"))
    by_subject = (
        counts.groupBy(F.col("subject").alias("name")).agg(total)
        .orderBy(F.desc("claims"), "name").limit(top).withColumn("kind", F.lit("subject"))
    )
    distinct = counts.agg(F.count_distinct("subject").alias("claims")).select(F.lit("subjects").alias("name"), "claims", F.lit("total").alias("kind"))
    return by_type.unionByName(by_subject).unionByName(distinct)


def span_check(quotes: DataFrame, docs: DataFrame, sample: int | None = None) -> DataFrame:
    """Does each quote's text lie inside its raw span, and does its hash fit.

    ``sample`` keeps an evenly spaced sample of that size in (edition, doc,
    line) order; without it every quote is checked.
    """
    rows = quotes
    if sample:
        rows = evenly_spaced(quotes, sample)
    raw = docs.select("doc_id", F.col("text").alias("raw"))
    piece = F.col("raw").substr((F.col("char_start") + 1).cast("int"), (F.col("char_end") - F.col("char_start")).cast("int"))
    valid = (F.col("char_start") >= 0) & (F.col("char_end") <= F.length("raw")) & (F.col("char_start") < F.col("char_end"))
    return rows.join(raw, "doc_id").select(
        "quote_id",
        (valid & F.contains(T.squash(piece), T.squash(F.col("text")))).alias("text_ok"),
        (F.sha2("text", 256) == F.col("sha256")).alias("hash_ok"),
    )


def evenly_spaced(quotes: DataFrame, k: int) -> DataFrame:
    """Every ``max(1, n // k)``-th quote in corpus order, the first ``k`` of them.

    Positions come from per-document counts summed over documents, not from one
    global sort of the rows.
    """
    from .scan import range_bounds, sequence_in_groups

    one = quotes.withColumn("__all", F.lit(1))
    numbered = sequence_in_groups(one, ["__all"], "doc_id", ["start_line", "part"], "pos", range_bounds(quotes, "doc_id"))
    step = F.greatest(F.lit(1), F.floor(quotes.agg(F.count(F.lit(1))).scalar() / k))
    at = F.col("pos") - 1
    return numbered.filter((at % step == 0) & (at / step < k)).drop("__all", "pos")
