"""Quality rules: text statistics and a decision list learned by sequential covering.

Everything is DataFrame expressions and grouped counts; no row is handled in Python.
The list holds conjunctions of thresholds on statistics.  Each rule is grown on one
part of the labelled rows by the condition of largest information gain, pruned on the
other part, kept if it is precise there, and its rows are set aside before the next.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratatext.llm.common import SPACE_CLASS, bind, drop, save, texts

#: Fixed values of the base rules: symbols, window and limits.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: Statistics that rules may test, as SQL over the columns of :func:`statistics`.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}


def _repeated(words: Column) -> Column:
    """Words in windows of ``WINDOW`` words found twice or more, each counted once.

    Windows are compared by 64-bit hash.  Only texts with equal windows sort them:
    equal neighbours give the places, and each place adds the words up to the next.
    """

    def hashes(w: Column) -> Column:
        starts = F.when(F.size(w) >= WINDOW, F.sequence(F.lit(0), F.size(w) - WINDOW)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    def places(s: Column) -> Column:
        same = lambda k, j: F.coalesce(F.get(s, k)["h"] == F.get(s, j)["h"], F.lit(False))
        hit = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, k + 1) | F.when(k > 0, same(k, k - 1)).otherwise(False))
        return F.array_sort(F.transform(hit, lambda k: F.get(s, k)["i"]))

    def covered(at: Column) -> Column:
        step = lambda k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1), F.get(at, k) + WINDOW) - F.get(at, k))
        return F.aggregate(F.sequence(F.lit(0), F.size(at) - 1), F.lit(0).cast("long"), lambda acc, k: acc + step(k))

    def count(h: Column) -> Column:
        marked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(bind(marked, lambda s: bind(places(s), covered)))

    return bind(bind(words, hashes), count)


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """``doc_id`` and the statistics of each whole text; ``keep`` names columns to carry along.

    Null and empty texts have zeros (one line); repeated rows are answered each.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    count = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))).cast("long")
    blank = " \t\n\x0b\f\r"
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c for c in keep if c != "doc_id"], F.filter(F.split(t, f"{SPACE_CLASS}+"), lambda w: w != "").alias("_words"), F.split(t, "\n").alias("_lines"), t.alias("_t"))
    t = F.col("_t")
    words = F.col("_words")
    full = F.filter(F.col("_lines"), lambda x: F.length(F.translate(x, blank, "")) > 0)
    kept = [c for c in keep if c != "doc_id"]
    found = F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.translate(t, blank, "")).cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        bind(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeated(words).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
        count("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        count("0123456789").alias("n_digits"),
        count("!?;:|").alias("n_marks"),
    )
    # The generator keeps later filters from being moved below, which would compute all twice.
    return split.select("doc_id", *kept, F.explode(F.array(found)).alias("_s")).select("doc_id", *kept, "_s.*")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


@dataclass
class Rule:
    """A conjunction of (feature, above, threshold) that rejects."""

    tests: list[tuple[str, bool, float]] = field(default_factory=list)

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, limit in self.tests:
            value = F.expr(FEATURES[name])
            out = out & (value > F.lit(limit) if above else value <= F.lit(limit))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>' if up else '<='} {x:.6g}" for n, up, x in self.tests)


@dataclass
class Learning:
    """``fit_rows`` bounds the labelled rows used (the smallest by hash of doc_id)."""

    fit_rows: int = 20_000
    cuts: int = 24
    max_tests: int = 3
    max_rules: int = 6
    precision: float = 0.95
    least: int = 5


def learn(docs: DataFrame, labels: DataFrame, how: Learning | None = None) -> list[Rule]:
    """An ordered list of rules that reject texts of quality 0.

    ``labels`` has ``doc_id, quality``; rows with a null in either, and base failures,
    take no part.  Without both classes there are no rules.
    """
    how = how or Learning()
    rows = labels.where("doc_id is not null and quality is not null").selectExpr("cast(doc_id as long) _id", "quality = 0 as bad")
    chosen = rows.orderBy(F.xxhash64("_id"), "_id", "bad").limit(how.fit_rows)  # at most fit_rows: safe to broadcast
    # Only two columns of the documents are named, so that no other can clash with the labels'.
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).drop("_id")
    table, path = save(_labelled(picked), "labelled")
    try:
        return _cover(table, how)
    finally:
        drop(docs.sparkSession, path)


def _labelled(picked: DataFrame) -> DataFrame:
    """Features of labelled texts that pass the base, with ``bad`` and ``grow``.

    The statistics are made in the tasks of the scan; their few rows are gathered after it.
    """
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3)) > 0
    return statistics(picked, "bad").where(~base_failed()).select("bad", part.alias("grow"), *[F.expr(e).alias(n) for n, e in FEATURES.items()]).repartition(4)


def _cover(table: DataFrame, how: Learning) -> list[Rule]:
    """Rules over the table of :func:`_labelled`, found on its features' bins.

    A feature's bin is the number of its cuts that lie below the value, so a value is
    above cut ``k`` where its bin is above ``k``.  Bins are written once; each round is
    a grouped count of small integers.
    """
    at = [i / (how.cuts + 1) for i in range(1, how.cuts + 1)]
    cut_rows = table.groupBy("bad").agg(*[F.percentile_approx(n, at).alias(n) for n in FEATURES]).collect()
    if len(cut_rows) < 2:
        return []
    cuts = {n: sorted({float(x) for r in cut_rows for x in r[n]}) for n in FEATURES}
    below = lambda n: F.size(F.filter(F.lit(cuts[n]), lambda c: F.col(n) > c)).cast("short")
    bins, path = save(table.select("bad", "grow", *[below(n).alias(n) for n in FEATURES]), "bins")
    rules: list[Binned] = []
    try:
        while len(rules) < how.max_rules:
            free = bins.where(~_any(rules))
            rule = _grow(free.where("grow"), cuts, how)
            rule = rule and _prune(free.where("not grow"), rule, how)
            if not rule:
                break
            rules.append(rule)
    finally:
        drop(table.sparkSession, path)
    return [Rule([(name, above, cuts[name][k]) for name, above, k in rule]) for rule in rules]


#: A conjunction of (feature, above, number of the cut) over bins.
Binned = list[tuple[str, bool, int]]


def _holds(rule: Binned) -> Column:
    out = F.lit(True)
    for name, above, k in rule:
        out = out & (F.col(name) > k if above else F.col(name) <= k)
    return out


def _any(rules: list[Binned]) -> Column:
    out = F.lit(False)
    for r in rules:
        out = out | _holds(r)
    return out


def _grow(rows: DataFrame, cuts: dict[str, list[float]], how: Learning) -> Binned | None:
    rule: Binned = []
    while len(rule) < how.max_tests:
        bins = [F.struct(F.lit(n).alias("name"), F.col(n).alias("bin")) for n in FEATURES]
        counts = rows.where(_holds(rule)).select("bad", F.explode(F.array(*bins)).alias("b")).groupBy("b.name", "b.bin").agg(F.sum(F.col("bad").cast("long")).alias("p"), F.count(F.lit(1)).alias("n")).collect()
        by: dict[str, dict[int, tuple[int, int]]] = {}
        for r in counts:
            by.setdefault(r["name"], {})[r["bin"]] = (r["p"], r["n"] - r["p"])
        if not by:
            return None
        one = next(iter(by.values()))
        p0, n0 = sum(p for p, _ in one.values()), sum(n for _, n in one.values())
        if not p0 or not n0:
            break
        best = (0.0, "", False, 0.0, 0)
        for name in sorted(by):
            p = n = 0
            for k, limit in enumerate(cuts[name]):
                p, n = p + by[name].get(k, (0, 0))[0], n + by[name].get(k, (0, 0))[1]
                for above, (pp, nn) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                    if pp >= how.least:
                        gain = pp * (log2(pp / (pp + nn)) - log2(p0 / (p0 + n0)))
                        best = max(best, (gain, name, above, limit, k))
        if best[0] <= 0:
            break
        rule.append((best[1], best[2], best[4]))
    return rule or None


def _prune(rows: DataFrame, rule: Binned, how: Learning) -> Binned | None:
    """The rule's best beginning on held-out rows, if it is precise enough there."""
    begun = [rule[:k] for k in range(1, len(rule) + 1)]
    r = rows.agg(*[F.coalesce(F.sum((_holds(x) & (F.col("bad") if bad else ~F.col("bad"))).cast("long")), F.lit(0)).alias(f"{'p' if bad else 'n'}{k}") for k, x in enumerate(begun) for bad in (True, False)]).first()
    score = lambda k: (r[f"p{k}"] - r[f"n{k}"]) / max(1, r[f"p{k}"] + r[f"n{k}"])
    best = max(range(len(begun)), key=lambda k: (score(k), r[f"p{k}"], -k))
    p, n = r[f"p{best}"], r[f"n{best}"]
    return begun[best] if p and p >= how.precision * (p + n) else None


def verdict(rules: list[Rule]) -> Column:
    """Ordered conditional expression over the statistics: true to keep."""
    out = F.when(base_failed(), F.lit(False))
    for rule in rules:
        out = out.when(rule.column(), F.lit(False))
    return out.otherwise(F.lit(True))


def quality_table(docs: DataFrame, labels: DataFrame, how: Learning | None = None) -> DataFrame:
    """Statistics, ``base_failed`` and ``kept`` of every document.

    Null texts count as empty and fail the base; a null doc_id stays null; repeated
    rows are answered each; no documents give no rows; other columns are ignored.
    """
    rules = learn(docs, labels, how)
    return statistics(docs).select("doc_id", *BASE, base_failed().alias("base_failed"), verdict(rules).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, how: Learning | None = None) -> DataFrame:
    """The documents that the rules keep, with their own columns, whatever their names.

    Null and empty texts fail the base and go; repeated rows are judged each; a null
    doc_id takes no part in learning; no documents give no rows, and without labels of
    both classes only the base rejects.
    """
    rules = learn(docs, labels, how)
    columns = [f"`{c}`" for c in docs.columns]
    row = F.struct(*columns).alias("_row")
    return statistics(docs.select("doc_id", "text", row), "_row").where(verdict(rules)).select("_row.*")
