"""Byte-pair encoding and decoding through a tokenization automaton.

The automaton reads tokens and accepts exactly the sequences that the merge list
produces.  It starts as one state with a loop for each byte.  Each merge a+b=c, in
order, adds one gadget: the arcs labelled a get a copy of their target state that
lacks the arc b, and wherever a could be read, c can now be read and leads to where
a and b led.  All arcs with one label share their target, so the gadgets amount to
one new state per merge, kept as (owner label, merge number, state before).

Encoding follows a word's bytes through the table of arcs, longest item first; one
accepted path at most reaches each place, so every place is entered once and the
first path to the end is the only one.  Arcs are entered into the table when first
asked for.  Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stratatext.llm.common import per_process, small, texts
from stratatext.llm.units import CACHE_ENTRIES, Units

#: Fixed values of the byte-level pre-tokenizer: its split pattern.  White space is
#: spelled as the Unicode property, as the library has it.
SPLIT_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in a byte-level vocabulary file.

    Bytes that print stand for themselves; the others take the letters from 256 on.
    """
    prints = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    letters = {chr(b): b for b in prints}
    others = [b for b in range(256) if b not in set(prints)]
    return letters | {chr(256 + i): b for i, b in enumerate(others)}


class Automaton:
    """Merges compiled into a deterministic automaton over the vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        spell = lambda item: bytes(letters[c] for c in item)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.labels: list[bytes] = [b""] * size
        for item, i in vocab.items():
            if item not in self.special:
                self.labels[i] = spell(item)
        for item, i in self.special.items():
            self.labels[i] = item.encode()
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in merges]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int]] = {}  # label: its left part, the merge that made it
        self.owner, self.born, self.before = [-1], [-1], [-1]
        self.after = [0] * size  # state that the arcs of a label lead to
        self.origin = [0] * size  # that state when the label came into being
        usable = {i for i, b in enumerate(self.labels) if len(b) == 1}
        for k, (a, b) in enumerate((vocab[x], vocab[y]) for x, y in pairs):
            if a in usable and b in usable and self._arc(self.after[a], b) >= 0:
                c = vocab[pairs[k][0] + pairs[k][1]]
                self._gadget(k, a, b, c)
                usable.add(c)
        self.arcs: dict[tuple[int, int], int] = {}
        #: Prefixes of vocabulary items: the item's number, or -1 for a mere prefix.
        self.items: dict[bytes, int] = {}
        for i in usable:
            label = self.labels[i]
            for n in range(1, len(label)):
                self.items.setdefault(label[:n], -1)
            self.items[label] = i
        #: The longest item that an item properly begins with, or -1.
        self.shorter = [-1] * size
        for i in usable:
            label = self.labels[i]
            self.shorter[i] = next((t for n in range(len(label) - 1, 0, -1) if (t := self.items.get(label[:n], -1)) >= 0), -1)

    def _gadget(self, k: int, a: int, b: int, c: int) -> None:
        target = self.after[b]  # before the arcs of a are redirected, which matters for a = b
        self.after[c] = self.origin[c] = target
        self.before.append(self.after[a])
        self.owner.append(a)
        self.born.append(k)
        self.after[a] = len(self.owner) - 1
        self.rank[a, b] = k
        self.made[c] = (a, k)

    def _arc(self, state: int, label: int) -> int:
        """Target of the arc, or -1 if ``state`` has none with this label.

        A label made by merge k is readable where its left part was at k; a part is
        unreadable where a gadget up to then took it away.
        """
        x, limit = label, len(self.rank) + len(self.owner)
        while True:
            q = state
            while q:
                a = self.owner[q]
                r = self.rank.get((a, x))
                if r is not None and r <= self.born[q] and r <= limit:
                    return -1
                q = self.origin[a]
            if x not in self.made:
                return self.after[label]
            x, limit = self.made[x]

    def word(self, word: bytes) -> list[int]:
        """Tokens of one pre-split word."""
        items, arcs, n = self.items, self.arcs, len(word)
        whole = items.get(word, -1)
        if whole >= 0:
            return [whole]
        # Longest item first.  A place is reached by one accepted path only, so one
        # that led nowhere is not entered again.
        labels, shorter, dead = self.labels, self.shorter, set()
        path: list[tuple[int, int, int]] = []
        i, p, t = 0, 0, self._longest(word, 0)
        while True:
            while t >= 0:
                j = i + len(labels[t])
                if j not in dead:
                    to = arcs.get((p, t))
                    if to is None:
                        to = arcs[p, t] = self._arc(p, t)
                    if to >= 0:
                        break
                t = shorter[t]
            if t < 0:
                dead.add(i)
                t, i, p = path.pop()
                t = shorter[t]
                continue
            path.append((t, i, p))
            if j == n:
                return [x[0] for x in path]
            i, p = j, to
            rest = items.get(word[i : i + 4])
            if rest is None:
                rest = items.get(word[i : i + 3])
                if rest is None:
                    rest = items.get(word[i : i + 2])
                    t = items[word[i : i + 1]] if rest is None else rest
                else:
                    t = rest
                if t < 0:
                    t = self._longest(word, i)
            else:
                t = self._longest(word, i)

    def _longest(self, word: bytes, i: int) -> int:
        """The longest vocabulary item that ``word`` has at i."""
        get, best = self.items.get, -1
        for j in range(i + 1, len(word) + 1):
            t = get(word[i:j])
            if t is None:
                break
            if t >= 0:
                best = t
        return best

    def decode(self, ids: list[int]) -> bytes:
        """The bytes that the arcs' labels spell."""
        return b"".join(map(self.labels.__getitem__, ids))


class Encoder:
    """Whole texts to packed token ids, in the smallest integer kind that holds them."""

    def __init__(self, path: str):
        import regex

        self.automaton = Automaton(path)
        self.split = regex.compile(SPLIT_PATTERN).findall
        self.words: dict[str, bytes] = {}
        self.kind = "<u2" if len(self.automaton.labels) <= 1 << 16 else "<u4"
        self.units = Units(self._units, self._text)
        self.special = list(self.automaton.special)
        self.between = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def _learn(self, words: list[str]) -> None:
        new = [w for w in set(words) if w not in self.words]
        if len(self.words) + len(new) > CACHE_ENTRIES:
            self.words, new = {}, list(set(words))
        if new:
            word, kind = self.automaton.word, self.kind
            self.words.update((w, np.array(word(w.encode()), kind).tobytes()) for w in new)

    def _text(self, text: str) -> bytes:
        words = self.split(text)
        self._learn(words)
        return b"".join(map(self.words.__getitem__, words))

    def _units(self, units: list[str]) -> list[bytes]:
        words = self.split("".join(units))
        self._learn(words)
        known, out, one = self.words, [], []
        for w in words:
            if w[0] in " \n" and one:
                out.append(b"".join(one))
                one = []
            one.append(known[w])
        if one:
            out.append(b"".join(one))
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        marked = [i for i, t in enumerate(texts) if any(x in t for x in self.special)]
        out = self.units.texts(["" if i in set(marked) else t for i, t in enumerate(texts)] if marked else texts)
        for i in marked:
            parts = [p for p in self.between.split(texts[i]) if p]
            out[i] = b"".join(np.array([self.automaton.special[p]], self.kind).tobytes() if p in self.automaton.special else self._text(p) for p in parts)
        return out


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file, compiled once per process."""
    return per_process(("encoder", path), lambda: Encoder(path))


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
TOKENS = "doc_id long, n_tokens long, ids array<int>"
ROUND_TRIP = "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string"


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode each whole text, decode it again and return digests of both.

    One row per input row: ``doc_id, n_tokens, ids_sha256`` (ids as little-endian
    unsigned 32-bit), ``decoded_sha256``.  Null and empty texts have no tokens; a
    null doc_id stays null; repeated rows are answered each; other columns are
    ignored.  ``path`` is the vocabulary file on every executor.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        decode = encode.automaton.decode
        for batch in small(batches):
            n, ids_sha, text_sha = [], [], []
            for packed in encode(batch.column(1).to_pylist()):
                ids = np.frombuffer(packed, encode.kind)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(decode(ids.tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], schema=schema
            )

    return texts(docs).mapInArrow(run, DIGESTS)


def encode_ids(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` of each whole text; edge cases as in :func:`encode_digests`."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in small(batches):
            ids = [np.frombuffer(x, encode.kind).astype(np.int32) for x in encode(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], schema=schema
            )

    return texts(docs).mapInArrow(run, TOKENS)


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` of each whole text and ``decoded_sha256`` of what the ids decode to.

    Edge cases as in :func:`encode_digests`.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        decode = encode.automaton.decode
        for batch in small(batches):
            ids = [np.frombuffer(x, encode.kind).astype(np.int32) for x in encode(batch.column(1).to_pylist())]
            digests = [hashlib.sha256(decode(x.tolist())).hexdigest() for x in ids]
            columns = batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(digests, pa.string())
            yield pa.RecordBatch.from_arrays(list(columns), schema=schema)

    return texts(docs).mapInArrow(run, ROUND_TRIP)


def decode_texts(tokens: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; bytes that are no UTF-8 become U+FFFD, null ids an empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(path).automaton.decode
        for batch in batches:
            out = [decode(x or []).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], schema=schema)

    return tokens.selectExpr("cast(doc_id as long) doc_id", "ids").mapInArrow(run, "doc_id long, text string")
