"""Operators on whole texts, against plain loops."""

import hashlib
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from stratatext.llm import bpe, decontaminate, lines, minhash, passages, quality, rans, suffixes

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
COLUMNS = "doc_id long, text string, row string, n int"


def words(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdeXÄé"), 4)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = words(1, 120)
    shared = "This line has far more than forty characters in it, and is shared."
    out = [
        (0, None), (1, ""), (2, "   "), (3, "one"), (4, base), (5, base), (6, base + " extra"), (7, " ".join(base.split()[:-3])),
        (8, words(2, 30_000)), (9, "a\tb  c\n\n" + shared), (None, "no id " + words(3, 30)), (None, None), (20, "<|endoftext|>x <|endoftext|>\r\n 漢字 😀"),
    ]
    out += [(10 + i, f"{words(10 + i, 6)}\n {shared.upper() if i % 2 else shared} \n{words(30 + i, 6)}\n{shared}") for i in range(6)]
    out += [(30, words(40, 40) + "\n" + base[:400] + "\n" + words(41, 40)), (31, words(42, 25)), (31, words(42, 25)), (32, " ".join(["la"] * 90))]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in rows], COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


def got(df):
    return Counter(tuple(r) for r in df.collect())


def test_bpe_equals_library(docs, rows, none):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(PATH)
    want = Counter()
    for k, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        want[k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert got(bpe.encode_digests(docs, PATH)) == want
    assert bpe.encode_digests(none, PATH).count() == 0
    back = bpe.decode_texts(bpe.encode_ids(docs, PATH), PATH)
    assert got(back) == Counter((k, t or "") for k, t in rows)


def test_automaton_on_random_words():
    from tokenizers import Tokenizer

    lib, own, rng = Tokenizer.from_file(PATH), bpe.Encoder(PATH), np.random.default_rng(5)
    letters = list("abehinorst   '\n\t\r.,-#12é漢 \x1c　😀")
    texts = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(3000)]
    for text, packed in zip(texts, own(texts), strict=True):
        assert np.frombuffer(packed, own.kind).tolist() == lib.encode(text, add_special_tokens=False).ids, repr(text)


def test_archive_round_trip(docs, rows, none):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(PATH)
    want, start = Counter(), 0
    for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[k, start, len(ids), zlib.crc32(ids.tobytes())] += 1
        start += len(ids)
    assert got(rans.round_trip(docs, rans.library_encoder(PATH), 50257, 2)) == want
    assert rans.round_trip(none, rans.library_encoder(PATH), 50257, 2).count() == 0


def test_coder_and_damage():
    rng = np.random.default_rng(1)
    ids = (rng.pareto(1.0, 70_000) * 3).astype(np.int64) % 50_000
    table = rans.Table(np.bincount(ids, minlength=50_257))
    for n in (0, 1, 1023, 1024, 1025, 70_000):
        block = rans.pack(np.array([7], "<i8").tobytes(), np.array([n], "<i8").tobytes(), ids[:n].astype("<u2"), 5, table)
        assert (rans.unpack(block, table)[2] == ids[:n]).all()
    hurt = bytearray(block)
    hurt[-100] ^= 1
    with pytest.raises(ValueError):
        rans.unpack(bytes(hurt), table)


def plain_lines(rows, min_chars=40, min_docs=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    where, last = defaultdict(set), {}
    for k, t in rows:
        for x in (t or "").split("\n"):
            if k is not None and len(key(x)) >= min_chars:
                where[key(x)].add(k)
    last = {x: max(ks) for x, ks in where.items() if len(ks) >= min_docs}
    for k, t in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if k is None or last.get(key(x), k) == k]
        yield k, len(all_), len(all_) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()


def test_lines(docs, rows, none):
    assert got(lines.line_table(docs)) == Counter(plain_lines(rows))
    assert lines.line_table(none).count() == 0
    out = lines.without_shared_lines(docs)
    assert out.columns == [*docs.columns, "_n_lines", "_n_dropped"] and out.count() == len(rows)


def shingle_sets(rows, size):
    for k, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        yield k, ({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())


def plain_groups(rows, size):
    sets = list(shingle_sets(rows, size))
    comp = {k: k for k, _ in sets if k is not None}
    changed = True
    while changed:
        changed = False
        for a, x in sets:
            for b, y in sets:
                if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y) and comp[b] < comp[a]:
                    comp[a], changed = comp[b], True
    return Counter((k, len(x), comp.get(k), k is None or comp[k] == k) for k, x in sets)


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, rows, none, size):
    assert got(minhash.near_duplicates(docs, size)) == plain_groups(rows, size)
    if size == 2:
        assert minhash.near_duplicates(none).count() == 0
        kept = minhash.keep_one(docs, size)
        assert kept.columns == docs.columns and kept.where("doc_id in (5, 6, 7)").count() == 0


def test_near_duplicates_in_chains(spark):
    """Links that only a path of documents gives, and a group larger than its neighbours' pairs."""
    base = words(70, 60).split()
    rows = [(i, " ".join(base[i : i + 40])) for i in range(0, 21, 2)] + [(100 + i, " ".join(base[:50] + [f"w{i}"])) for i in range(40)]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], COLUMNS)
    assert got(minhash.near_duplicates(df, 2)) == plain_groups(rows, 2)


def plain_bytes(rows, length):
    seen = Counter((t or "").encode()[i : i + length] for _, t in rows for i in range(len((t or "").encode()) - length + 1))
    for k, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - length + 1):
            if seen[data[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone[1:] < gone[:-1]).sum())
        kept = bytes(b for b, g in zip(data, gone, strict=False) if not g)
        yield k, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()


def test_repeated_bytes(docs, rows, none, monkeypatch):
    assert got(suffixes.byte_table(docs)) == Counter(plain_bytes(rows, 200))
    assert suffixes.byte_table(none).count() == 0


def test_repeated_bytes_at_edges(spark):
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("ab"), 900))
    rows = [(0, text), (1, text[100:299]), (2, "x" + text[100:300]), (3, text[50:400] + "y" + text[399:]), (4, "z" * 500), (5, "q" * 200), (6, "é" * 150), (7, text[300:500] + "é" * 100)]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], COLUMNS)
    assert got(suffixes.byte_table(df)) == Counter(plain_bytes(rows, 200))


def plain_statistics(text):
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    full = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(full) - len(set(full)), len(covered)


def test_quality_statistics(docs, rows, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    want = Counter()
    for k, t in rows:
        s = plain_statistics(t or "")
        bad = s[0] < 20 or 100 * s[4] > 30 * s[0]
        want[(k, *s, bad, not bad)] += 1
    assert got(quality.quality_table(docs, labels)) == want


def test_quality_learns(spark):
    good = [(i, words(200 + i, 40), 1) for i in range(150)]
    bad = [(1000 + i, words(400 + i, 40).replace(" ", "### "), 0) for i in range(60)]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t, _ in good + bad], COLUMNS)
    labels = spark.createDataFrame([(k, q) for k, _, q in good + bad] + [(None, 1), (3, None), (77777, 0)], "doc_id long, quality int")
    out = quality.quality_table(df, labels)
    assert out.where("doc_id < 1000 and not kept").count() == 0
    assert out.where("doc_id >= 1000 and kept").count() == 0
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and kept.count() == 150
    assert quality.keep_good(df.limit(0), labels).count() == 0


def test_decontamination(spark, docs, none):
    items = [(0, words(90, 30)), (1, words(91, 14)), (2, "tiny item"), (3, None), (4, "...")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    w = items[0][1].split()
    swapped = [*w]
    for i in (3, 9, 14, 20, 26):
        swapped[i] = "other"
    texts = [(100, words(95, 50) + " " + items[0][1].upper().replace("Ä", "Ä") + ". " + words(96, 50)), (101, " ".join(swapped)), (102, " ".join(w[:20])), (103, f"x {items[1][1]}!"), (104, "a tiny item"), (105, words(97, 300))]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in texts], COLUMNS).union(docs)
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(df, bench).collect()}
    assert {(101, 0), (103, 1), (104, 2)} <= found and not {d for d, _ in found} - {100, 101, 103, 104}
    assert decontaminate.overlaps(none, bench).count() == 0
    assert decontaminate.overlaps(df, bench.limit(0)).count() == 0
    assert decontaminate.without_leaks(df, bench).columns == df.columns


def plain_overlap(item, text, share=0.8, run=25):
    """Edit distance of the item to the text's nearest stretch, or a run, by plain tables."""
    a, b = decontaminate.tokens(item), decontaminate.tokens(text)
    row, runs, longest = [0] * (len(b) + 1), [0] * (len(b) + 1), 0
    for i, x in enumerate(a):
        new, held = [i + 1], [0]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            held.append(runs[j] + 1 if x == y else 0)
        row, runs, longest = new, held, max(longest, *held)
    return len(a) - min(row) >= share * len(a) or longest >= run


def test_decontamination_of_edited_items(spark):
    """Tokens changed, put in and left out, at every length, and long runs of longer items."""
    rng = np.random.default_rng(12)
    items = [(i, words(3000 + i, n)) for i, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 15, 15, 16, 20, 25, 30, 45, 59, 59])]
    texts = []
    for i, item in items:
        for k in range(12):
            w = item.split()
            for p in sorted(rng.choice(len(w), min(len(w), len(w) // 5 + k // 8), replace=False).tolist(), reverse=True):
                w[p : p + 1] = [["other"], [w[p], "put"], [], ["other"]][(k + p) % 4]
            texts.append((i * 100 + k, f"{words(4000 + i, 12)} {' '.join(w)} {words(4100 + i, 12)}"))
        texts.append((i * 100 + 50, f"{words(4200 + i, 5)} {' '.join(item.split()[5:45])} {words(4300 + i, 5)}"))
        texts.append((i * 100 + 51, " ".join(["other" if len(item.split()) > 3 and p % 4 == 3 and p // 4 < len(item.split()) // 5 else x for p, x in enumerate(item.split())])))
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in texts], COLUMNS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(df, bench).collect()}
    assert found == {(k, i) for k, t in texts for i, item in items if plain_overlap(item, t)}
    assert {(2050, 20), (1351, 13)} <= found


def test_passages(spark, docs, none):
    shared = words(300, 60)
    near = shared.split()
    near[5] = "changed"
    texts = [(100 + i, f"{words(310 + i, 80)} {shared} {words(330 + i, 20)}") for i in range(8)]
    texts += [(200, words(350, 10) + " " + " ".join(near) + " " + words(351, 70)), (201, words(352, 400)), (202, " ".join(shared.split()[:40]) + " " + words(353, 60))]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in texts], COLUMNS)
    pairs = {(r["doc_id"], r["other_id"]) for r in passages.near_passages(df).collect()}
    assert {d for p in pairs for d in p} == {*range(100, 108), 200}
    assert passages.near_passages(none).count() == 0
    assert {4, 5, 6, 7} <= {d for r in passages.near_passages(docs).collect() for d in r[:2]}


def plain_passages(texts, window=passages.WINDOW):
    """Pairs (larger, smaller) of documents with stretches of a similarity of 0.8 or more."""
    rows = {}
    for k, t in texts:
        w = t.lower().split()
        rows[k] = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    sets = {k: [set(r[i : i + window]) for i in range(len(r) - window + 1)] for k, r in rows.items()}
    return {(a, b) for a in sets for b in sets if a > b and any(100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b] if len(x & y) > 30)}


def changed(text, *places):
    w = text.split()
    for i in places:
        w[i] = f"changed{i}"
    return " ".join(w)


def test_passages_in_chains_and_twos(spark):
    """Every link is a row, or both its ends are linked to one smaller document."""
    texts = []
    for i in range(12):  # A-B and B-C agree, A-C does not
        one = words(500 + i, 50)
        texts += [(10 * i, f"{words(600 + i, 10)} {changed(one, 15)} {words(620 + i, 10)}"), (10 * i + 1, f"{words(640 + i, 12)} {one} {words(660 + i, 8)}"), (10 * i + 2, f"{words(680 + i, 9)} {changed(one, 33)} {words(700 + i, 11)}")]
    for i in range(6):  # B has one passage of A, and another one of C that A has in a third form
        one, two = words(720 + i, 50), words(740 + i, 50)
        texts += [(200 + 10 * i, f"{one} {words(760 + i, 9)} {changed(two, 12, 30)}"), (201 + 10 * i, f"{two} {words(780 + i, 9)} {one}"), (202 + 10 * i, f"{words(800 + i, 9)} {changed(two, 30)}")]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in texts], COLUMNS)
    rows = {(r["doc_id"], r["other_id"]) for r in passages.near_passages(df).collect()}
    want = plain_passages(texts)
    assert rows <= want
    near = {k: {b for a, b in rows if a == k} | {k} for k, _ in texts}
    assert not [p for p in want - rows if not (near[p[0]] & near[p[1]])]


def test_changed_forms_of_a_passage_are_paired(spark):
    """Forms that each differ from the smallest document's, and by as much from one another."""
    one = words(2600, 60).split()
    texts = []
    for i in range(7):
        form = " ".join([*one[:30], f"form{i}", *one[31:]])
        texts.append((40 + i, f"{words(2610 + i, 12)} {form} {words(2630 + i, 12)}"))
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in texts], COLUMNS)
    rows = {(r["doc_id"], r["other_id"]) for r in passages.near_passages(df).collect()}
    want = plain_passages(texts)
    assert len(want) == 21 and rows == want


def test_near_stretches_share_a_key():
    missed = 0
    for i in range(500):
        one = words(2000 + i, 50)
        text, key, *_ = passages.candidates([one, changed(one, 20 + i % 10)], passages.WINDOW)
        missed += not set(key[text == 0].tolist()) & set(key[text == 1].tolist())
    assert missed == 0


def test_passages_grow_through_changes():
    one = words(900, 400).split()
    other = changed(" ".join(one), 60, 130, 200).split()
    other[260:260] = ["put", "in"]
    x, y = (passages.shingle_row(" ".join(w)) for w in (one, other))
    got_, agreed = passages.passages(x, y, [(0, 10, 20, 0, 10, 20)], passages.WINDOW)
    assert [g[:3] for g in got_] == [(0, 0, 396)] and len(agreed) == 1


def test_filters_find_every_repeat(spark):
    from stratatext.llm.seen import maybe_repeated, twice_seen

    df = spark.range(0, 3000, 1, 4).selectExpr("id", "id % 1000 as v").union(spark.range(5000, 9000, 1, 4).selectExpr("id", "id as v"))
    mixed = lambda v: minhash.mix(np.asarray(v).astype(np.uint64))
    seen = twice_seen(df, lambda b: mixed(b.column(1)), 20)
    assert maybe_repeated(seen.value, mixed(np.arange(1000))).all()
    assert maybe_repeated(seen.value, mixed(np.arange(5000, 9000))).mean() < 0.05


def test_compact_windows_cover_all_stretches():
    rng = np.random.default_rng(8)
    x = minhash.mix(rng.integers(0, 50, 400).astype(np.uint64))
    at = passages.compact_windows(x, 20)
    assert at.tolist() == [p + int(x[p : p + 20].argmin()) for p in range(381)]


def test_components_by_paths(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(3, 27)], "a long, b long")
    want = {i: 0 if i < 10 or 20 <= i < 30 else i // 10 * 10 for i in range(41)}
    assert {r["id"]: r["comp"] for r in minhash.components(links).collect()} == {k: v for k, v in want.items() if k < 40}


def test_tokens_of_many_texts_are_those_of_each():
    texts = [" A-b\tC!  \x0b\x0c!!! \u00e9\x1cX \x85 y\n", "", "  ", "...", "\u00c4B\u2019 \u201cq\u201d", "a b a-b (A) b", "a"]
    hashes, size = decontaminate.all_token_hashes(pa.array(texts))
    each = [decontaminate.tokens(t) for t in texts]
    assert size.tolist() == [len(ts) for ts in each]
    flat = [t for ts in each for t in ts]
    assert len(hashes) == len(flat)
    assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))
    assert [decontaminate.token_hashes(t).tolist() for t in texts] == [h.tolist() for h in np.split(hashes, np.cumsum(size)[:-1])]


def test_seeds_do_not_cross_from_one_text_to_the_next(spark):
    words = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join(words[:6])), (2, " ".join(words[6:])), (3, ""), (4, "x " + " ".join(words))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    found = decontaminate.overlaps(df, bench).collect()
    assert [(r["doc_id"], r["item_id"], r["n_equal"], r["at"]) for r in found] == [(4, 7, 12, 1)]
