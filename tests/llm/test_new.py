"""Whitening, spelling variants and personal data, against plain loops."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from stratatext.llm import private, spelling, whiten

# -- whitening -------------------------------------------------------------------------


def plain_whitening(vectors, components=4):
    rows = [(k, np.floor(np.array(v, np.float64) * 256).astype(np.int64)) for k, v in vectors if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.unique(np.array([x for _, x in rows]), axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    return n, [(k, int(sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s, strict=True))), ((x - s / n) @ v) / np.sqrt(e)) for k, x in rows], e / (centred**2).sum() * n


def test_whitening(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 12)) @ np.diag(np.linspace(3, 0.2, 12)) @ np.linalg.qr(rng.normal(size=(12, 12)))[0]
    base[:, 7] = 0.5  # no variance in this place
    base[:, 8] = base[:, 2] * 2  # nor in one direction
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(900 + i, rows[0][1]) for i in range(200)] + [(5, rows[7][1]), (None, rows[9][1])]
    odd = [(1000, None), (1001, [1.0, None] + [0.0] * 10), (1002, [float("nan")] + [0.0] * 11), (1003, [float("inf")] + [0.0] * 11), (1004, []), (1005, [0.5])]
    df = spark.createDataFrame([(k, v, "x", 1) for k, v in rows + odd], "vec_id long, embedding array<float>, component string, x int").repartition(5)
    n, want, share = plain_whitening(rows)
    got = defaultdict(list)
    for r in whiten.whiten(df).collect():
        got[r["vec_id"]].append(r)
    assert set(got) == {k for k, *_ in want}
    signs = None
    for k, deviation, w in want:
        mine = sorted(got[k], key=lambda r: r["component"])[:4]
        assert [r["component"] for r in mine][:1] == [1] and all(r["n"] == n for r in mine)
        assert deviation in {r["deviation"] for r in got[k]}
        if k in (5, None) or len(got[k]) != 4:
            continue
        values = np.array([r["whitened"] for r in mine])
        signs = np.sign(values * w) if signs is None else signs
        assert np.allclose(values, w * signs, rtol=1e-9, atol=1e-10)
        assert np.allclose([r["explained"] for r in mine], share, rtol=1e-10) and mine[0]["identity_error"] < 1e-10
    assert len(got[5]) == 8 and len(got[None]) == 4


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    assert whiten.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], schema)).count() == 0
    two = whiten.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 2.0])], schema)).collect()
    assert [r["component"] for r in two] == [1, 1] and sorted(round(r["whitened"], 9) for r in two) == [-1, 1] and two[0]["deviation"] == 256**2


def test_large_deviations_are_exact():
    x = np.array([[1 << 40, 3], [0, 0]], np.int64)
    assert whiten._deviations(x, 5, [1 << 40, 3]) == [None, None]
    assert whiten._deviations(x >> 20, 5, [1 << 20, 3]) == [(4 << 20) ** 2 + 9, (1 << 40) + 9]


def test_triangular_solve():
    rng = np.random.default_rng(1)
    a, b = np.tril(rng.normal(size=(9, 9))) + 5 * np.eye(9), rng.normal(size=(9, 4))
    assert np.allclose(a @ whiten.solve_lower(a, b), b)


# -- spelling variants -----------------------------------------------------------------


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(rows):
    counts = Counter()
    for k, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    form, near = {}, {}
    for w, n in counts.items():
        others = sorted((-counts[o], o) for o in counts if one_edit(w, o))
        near[w] = len(others)
        form[w] = others[0][1] if others and -others[0][0] >= 2 * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, near[w], counts.get(form[w])))
    return out


@pytest.fixture(scope="module")
def variants():
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(list("abcéÿß×"), rng.integers(4, 9))) for _ in range(60)] + ["aaaaaa", "aaaaa", "aaaaaaa", "abababab"]
    many = []
    for w in base:
        many.append(w)
        for _ in range(6):
            at, c = rng.integers(len(w)), rng.choice(list("abcéÉZ"))
            many.append([w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]][rng.integers(3)])
    rows = [(i, " ".join(rng.choice(many, 300) if i % 3 else rng.choice(base, 100))) for i in range(25)]
    return [*rows, (3, rows[3][1]), (None, rows[4][1]), (90, None), (91, ""), (92, "123 -- !"), (93, ("z" * 5000 + " ") * 3 + ("z" * 4999 + " ") * 9), (94, "abcdefg " * 3 + "abcdefh " * 7 + "abcdeih " * 20)]


@pytest.mark.parametrize("limit", [2, 40, 1000])
def test_spelling_groups(spark, variants, limit):
    df = spark.createDataFrame([(k, t, "x", 5) for k, t in variants], "doc_id long, text string, word string, n int").repartition(4)
    got = spelling.spelling_groups(df, block_words=limit)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in got.collect()]
    want = plain_groups(variants)
    assert len(rows) == len(want) and set(rows) == want and any(r[1] and r[2] != r[1] for r in rows)


def test_spelling_of_nothing(spark):
    assert spelling.spelling_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.spelling_groups(spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")).count() == 0


# -- personal data ---------------------------------------------------------------------

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain_spans(text):
    def fits(kind, s):
        digits = [int(c) for c in s if c in "0123456789"]
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            doubled = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))]
            return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    return [(kind, *m.span()) for kind, p in PATTERNS for m in re.finditer(p, text) if fits(kind, m.group())]


def test_base_detectors_equal_plain_patterns():
    rng = np.random.default_rng(8)
    parts = ["a@b.c", "@", ".", "x_y%z", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (626) 555-1660", "+", "12", " ", "-", "é", "00.0.0.0", "@h", "5.6.7.8.9.10.11.12", "4012888888881881", "+49.30)123456 "]
    for _ in range(4000):
        text = "".join(rng.choice(parts, rng.integers(1, 9)))
        assert [(k, *s) for k in private.KINDS for s in private.DETECTORS[k](text)] == plain_spans(text), text


DISGUISED = [
    ("email", "jo.smith＠example.com"), ("email", "jo.smith (at) example (dot) com"), ("email", "jo[at]example[dot]com"), ("email", "jo dot smith at mail dot example dot com"),
    ("email", "jo@exаmple.com"), ("email", "jo&#64;example&#46;com"), ("email", "jo.smith12 at example.com"), ("email", "jo.smith @ example.com"), ("email", "joATexampleDOTcom"), ("email", "jo​@exam­ple.com"),
    ("email", "jo { at } example . com".replace(" . ", " [.] ")), ("email", "ｊｏ＠ｅｘａｍｐｌｅ．ｃｏｍ"), ("email", "jo_s AT example DOT org"), ("email", "jo arroba example punto es"),
    ("ip", "10 dot 0 dot 7 dot 255"), ("ip", "one nine two dot one six eight dot one dot seven"), ("ip", "１０.0.0.7"), ("ip", "10[.]0[.]0[.]7"), ("ip", "10。0。0。7"),
    ("card", "four one one one one one one one one one one one one one one one"), ("card", "4111 1111 1111 ١١١١"), ("card", "4lll 1111 1111 1111"), ("card", "4111 1111‑1111 1111"), ("card", "4O12888888881881"),
    ("phone", "plus one nine zero eight five five five six two five zero"), ("phone", "+1 (626) five five five one six six zero"), ("phone", "＋1 626 555 1660"), ("phone", "+l (626) 555-l66O"), ("phone", "plus four nine, three zero, one two three four five six"),
]


@pytest.mark.parametrize("kind,written", DISGUISED)
def test_disguises_lead_back_to_the_source(kind, written):
    text = f"Éa wörds before. Reach: {written}; and words after, in 1999."
    begin = text.index(written)
    got = private.Transducers().spans(text)
    assert (begin, begin + len(written), False) in got[kind], got
    assert sum(len(v) for v in got.values()) == 1


CLEAN = [
    "We met at noon. Look at example.com for more, or shop at stores.", "Le point de vue est bon; un deux trois soleil, six sept huit.", "Version 1.2.3 at 5.30pm on 2024-01-02, 10 dot 5.", "One two three four five six seven eight nine ten at last.",
    "Привет, это обычный текст с буквами а о е и числом 12345678.", "jo@example.com dot the i. See jo@example.com at once.", "Meet @ 5.30pm. A @ B. Follow @ twitter today.", "100 000 000 000 000 000 l O and I 20 30", "Tel. +1 (848) 555-1373 un des autres; 4111 1111 1111 1111 Un.", "",
]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_gain_nothing(text):
    got = private.Transducers().spans(text)
    assert all(p for spans in got.values() for *_, p in spans)


def test_private_table(spark):
    rows = [(1, None), (2, ""), (None, "a@b.co"), (3, "a@b.co and jo (at) b (dot) co, 1.2.3.4"), (3, "a@b.co and jo (at) b (dot) co, 1.2.3.4"), (4, "x" * 300_000 + "@b.co " + "1" * 200_000 + " " + "+" * 1000 + "1.2.3." * 5000), (5, "nothing")]
    df = spark.createDataFrame([(k, t, "s", 3) for k, t in rows], "doc_id long, text string, spans string, n_ip int").repartition(3)
    got = Counter(tuple(r) for r in private.private_table(df).collect())
    want = Counter()
    for k, t in rows:
        base = plain_spans(t or "") if k != 4 else [(n, *s) for n in private.KINDS for s in private.DETECTORS[n](t)]
        write = lambda s: ",".join(":".join(map(str, x)) for x in s)
        more = [("email", t.index("jo ("), t.index(", 1.2"))] if k == 3 else []
        every = sorted(base + more, key=lambda x: (private.KINDS.index(x[0]), x[1]))
        want[(k, *[sum(x[0] == n for x in base) for n in private.KINDS], hashlib.sha256(write(base).encode()).hexdigest(), write(every))] += 1
    assert got == want
    assert private.private_table(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    hidden = {r["doc_id"]: r["text"] for r in private.masked(df).where("doc_id is not null and doc_id <> 4").collect()}
    assert hidden == {1: "", 2: "", 3: "[email] and [email], [ip]", 5: "nothing"}
