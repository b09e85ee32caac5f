"""Personal data, plain and disguised, at its places in the source text.

A chain of transducers rewrites a text into a plainer one: look-alike characters become
ASCII and invisible ones vanish; spelled digits become figures; letters that stand for
figures inside numbers are turned back; written-out at and dot signs become signs.  Each
transducer keeps, for every piece it rewrites, where the piece stood, so a place in the
last text leads back through the chain to the source.  The detectors of the base kinds
run over the source and over the plain text; what the second finds and the first does
not is added, with the span of the source characters that it was made of.

Restraint: a bare word "at" counts only where a disguised dot follows in the same
address or the name before it looks like an account (a figure, point, dash, underscore);
an at sign between spaces counts in these cases and before a common last label; bare dot
words make a longer address of a plain one only before a common last label; a disguised
span that overlaps a plain one of its kind must contain it; spelled figures count in runs
of three and more figures with two and more spelled ones.

Defined results: null texts are empty and have no spans; empty texts too; a null doc_id
stays null; repeated rows are answered each; no documents give no rows; other columns
are ignored.  Texts are taken whole.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratatext.llm.common import per_process, small, texts

KINDS = ["email", "ip", "card", "phone"]

#: The base kinds' patterns.  An address is found from its at sign, so that
#: a long run of letters is read once; the pattern of the part behind it is the base's.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Characters of other scripts that look like the ASCII character before the colon.
LOOK_ALIKES = (
    "A:ΑАᎪ B:ΒВ C:СϹ E:ΕЕ H:ΗН I:ΙІ J:Ј K:ΚК M:ΜМ N:Ν O:ΟО P:ΡР S:Ѕ T:ΤТ X:ΧХ Y:ΥҮ Z:Ζ "
    "a:аɑα b:Ь c:сϲ d:ԁ e:еҽ g:ɡ h:һ i:іıι j:ј k:κ l:ӏ m:м n:ո o:оοօ p:рρ q:ԛ r:г s:ѕ t:т u:υս v:ν w:ԝ x:хχ y:уγ z:ᴢ "
    ".:。․·・∙ -:−‐‑‒–—―﹘ +:＋﬩ @:＠﹫"
)
#: Figures in words.
DIGIT_WORDS = {
    "0": "zero null zéro cero", "1": "one eins un une uno", "2": "two zwei zwo deux dos", "3": "three drei trois tres",
    "4": "four vier quatre cuatro", "5": "five fünf cinq cinco", "6": "six sechs seis", "7": "seven sieben sept siete",
    "8": "eight acht huit ocho", "9": "nine neun neuf nueve",
}
#: Words for signs.
AT_WORDS, DOT_WORDS = "at arroba arobase ät", "dot punkt punto point"
OTHER_SIGNS = {"underscore": "_", "hyphen": "-", "dash": "-"}
ENTITIES = {"&#64;": "@", "&#x40;": "@", "&commat;": "@", "%40": "@", "&#46;": ".", "&#x2e;": ".", "&period;": ".", "%2e": "."}
#: Last labels before which a bare dot word may lengthen a plain address.
LAST_LABELS = "com org net edu gov io info co uk de fr es it nl eu us ch at be ca"
#: Letters that stand for figures inside numbers.
FIGURES = {"O": "0", "o": "0", "l": "1", "I": "1"}

Spans = list[tuple[int, int]]
Edits = list[tuple[int, int, str]]


# -- detectors -----------------------------------------------------------------------


def emails(text: str) -> Spans:
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in LOCAL:
            begin -= 1
        host = DOMAIN.match(text, at + 1) if begin < at else None
        if host:
            free = host.end()
            out.append((begin, free))
        at = text.find("@", max(at + 1, free))
    return out


def ips(text: str) -> Spans:
    small_part = lambda p: len(p := p.lstrip("0")) < 4 and int(p or "0") <= 255
    return [m.span() for m in IP.finditer(text) if all(map(small_part, m.group().split(".")))]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def cards(text: str) -> Spans:
    out = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> Spans:
    return [m.span() for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]


DETECTORS = {"email": emails, "ip": ips, "card": cards, "phone": phones}


# -- transducers ---------------------------------------------------------------------


class Rewritten:
    """A text made by edits of another, and the way back from its places."""

    def __init__(self, text: str, edits: Edits):
        out, at, length = [], 0, 0
        self.at: list[int] = []  # where a piece begins in the new text
        self.old: list[tuple[int, int, bool]] = []  # its place in the old one; whether it is a copy

        def piece(begin: int, end: int, new: str, copied: bool) -> None:
            nonlocal length
            self.at.append(length)
            self.old.append((begin, end, copied))
            out.append(new)
            length += len(new)

        for begin, end, new in edits:
            if begin > at:
                piece(at, begin, text[at:begin], True)
            piece(begin, end, new, False)
            at = end
        if at < len(text) or not edits:
            piece(at, len(text), text[at:], True)
        self.text = "".join(out)

    def back(self, begin: int, end: int) -> tuple[int, int]:
        """The span of the old text that the span (not empty) was made of."""
        k = bisect_right(self.at, begin) - 1
        first, _, copied = self.old[k]
        j = bisect_right(self.at, end - 1) - 1
        start, last, copied_end = self.old[j]
        return (first + begin - self.at[k] if copied else first), (start + end - self.at[j] if copied_end else last)

    def edited(self, begin: int, end: int) -> Iterator[tuple[int, int, str]]:
        """Pieces within the span that aren't copies, as (old begin, old end, new)."""
        k = max(0, bisect_right(self.at, begin) - 1)
        while k < len(self.at) and self.at[k] < end:
            if not self.old[k][2]:
                stop = self.at[k + 1] if k + 1 < len(self.at) else len(self.text)
                yield self.old[k][0], self.old[k][1], self.text[self.at[k] : stop]
            k += 1


class Transducers:
    """The compiled rules; made once per worker process."""

    def __init__(self):
        self.plain = self._characters()
        self.known = frozenset(self.plain)
        self.word = re.compile(r"[^\W\d_]+")
        words = {w: d for d, ws in DIGIT_WORDS.items() for w in ws.split()}
        self.digit = words
        one = "|".join(sorted(map(re.escape, words), key=len, reverse=True))
        token = rf"(?:(?:double|triple)\s)?(?:{one}|[0-9]+)"
        between = rf"(?:[ ,()\-]{{1,3}}|\s(?:{'|'.join(DOT_WORDS.split())})\s|\.)"
        self.number = re.compile(rf"(?<![\w+])(?:(?:plus\s|\+\s?))?{token}(?:{between}{token}){{2,}}(?!\w)", re.I)
        self.part = re.compile(rf"(?P<plus>plus\s|\+\s?)|(?P<times>double|triple)\s(?P<word2>{one})|(?P<word>{one})|(?P<figures>[0-9]+)|(?P<dot>\s(?:{'|'.join(DOT_WORDS.split())})\s)|(?P<gap>[ ,()\-]{{1,3}})", re.I)
        self.figures = re.compile(r"(?<![A-Za-z0-9])[0-9OoIl+(][0-9OoIl() .+-]{6,40}[0-9OoIl](?![A-Za-z0-9])")
        self.group = re.compile("[0-9OoIl]+")
        # Figures are rare, so what starts with one is found fast.
        self.letter_by_figure = re.compile("[0-9+][OoIl]"), re.compile("[0-9](?<=[OoIl].)")
        self.at_words, self.dot_words = frozenset(AT_WORDS.split()), frozenset([*DOT_WORDS.split(), *OTHER_SIGNS])
        signs = {**dict.fromkeys(AT_WORDS.split(), "@"), **dict.fromkeys(DOT_WORDS.split(), "."), **OTHER_SIGNS, "@": "@", ".": "."}
        self.signs = signs
        inner = "|".join(sorted(map(re.escape, signs), key=len, reverse=True))
        self.bracketed = re.compile(rf"[\[({{<]\s?({inner})\s?[\])}}>]", re.I)
        self.entity = re.compile("|".join(map(re.escape, ENTITIES)), re.I)
        ats, dots = "|".join(AT_WORDS.split()), "|".join(DOT_WORDS.split())
        dot = rf"(?: (?:{dots}) |\.(?=[A-Za-z0-9])| ?[\[({{<] ?(?:{dots}|\.))"
        self.capitals = re.compile("(?<=[a-z0-9])(AT|DOT)(?=[a-z0-9])")
        self.bare_at = re.compile(rf"(?<=[A-Za-z0-9]) (?:-?(?:{ats})-?) (?=[A-Za-z0-9-]{{1,63}}{dot})", re.I)
        self.bare_dot = re.compile(rf"(?<=[A-Za-z0-9]) ({dots}|{'|'.join(OTHER_SIGNS)}) (?=[A-Za-z0-9])", re.I)
        self.last = frozenset(LAST_LABELS.split())

    @staticmethod
    def _characters() -> dict[str, str]:
        """Character to its plain form, by Unicode's own tables and the look-alikes."""
        plain: dict[str, str] = {}
        for code in [*range(0x80, 0x20000), *range(0xE0000, 0xE0080)]:  # ideographs beyond look like nothing here
            c = chr(code)
            kind = unicodedata.category(c)
            if kind in ("Cn", "Co", "Cs"):
                continue
            if kind == "Cf":
                plain[c] = ""
            elif kind == "Zs":
                plain[c] = " "
            elif kind == "Nd":
                plain[c] = str(unicodedata.decimal(c))
            elif (kind != "No" or "CIRCLED" in unicodedata.name(c, "")) and len(k := unicodedata.normalize("NFKC", c)) == 1 and "!" <= k <= "~":
                plain[c] = k
        for entry in LOOK_ALIKES.split(" "):
            for c in entry[2:]:
                plain[c] = entry[0]
        return plain

    # Each rule gives the edits of a text.

    def characters(self, text: str, words: set[str]) -> Edits:
        if text.isascii() or not (here := self.known & set(text)):
            return []
        odd = re.compile(f"[{''.join(map(re.escape, sorted(here)))}]")
        return [(m.start(), m.end(), self.plain[m.group()]) for m in odd.finditer(text)]

    def words(self, text: str) -> set[str]:
        return set(self.word.findall(text.lower()))

    def _close(self, text: str) -> bool:
        """Whether a spelled figure stands close to another one."""
        last = -100
        for m in self.word.finditer(text):
            if m.group().lower() in self.digit:
                if m.start() - last <= 24:
                    return True
                last = m.end()
        return False

    def spelled(self, text: str, words: set[str]) -> Edits:
        """Figures for runs of three and more figures of which two and more are words.

        Gaps between two spelled figures go; other gaps stay as they are.
        """
        out: Edits = []
        if not self.digit.keys() & words or not self._close(text):
            return out
        for run in self.number.finditer(text):
            parts = list(self.part.finditer(text, *run.span()))
            if sum(bool(p["word"] or p["word2"]) for p in parts) < 2:
                continue  # one word beside figures is more often an article
            for k, p in enumerate(parts):
                before = parts[k - 1] if k else None
                after = parts[k + 1] if k + 1 < len(parts) else None
                if p["plus"]:
                    out.append((p.start(), p.end(), "+"))
                elif p["word"]:
                    out.append((p.start(), p.end(), self.digit[p["word"].lower()]))
                elif p["word2"]:
                    out.append((p.start(), p.end(), self.digit[p["word2"].lower()] * (2 if p["times"].lower() == "double" else 3)))
                elif p["dot"]:
                    out.append((p.start(), p.end(), "."))
                elif p["gap"] and before and after and (before["word"] or before["word2"]) and (after["word"] or after["word2"]):
                    out.append((p.start(), p.end(), ""))
        return out

    def letters_as_figures(self, text: str, words: set[str]) -> Edits:
        out: Edits = []
        if not any(p.search(text) for p in self.letter_by_figure):
            return out
        for run in self.figures.finditer(text):
            figures = sum(c.isdigit() for c in run.group())
            groups = [g for g in self.group.finditer(text, *run.span()) if any(c.isdigit() for c in g.group()) or text[g.start() - 1 : g.start()] == "+"]
            letters = [k for g in groups for k in range(*g.span()) if text[k] in FIGURES]
            if letters and figures >= 7 and figures >= 2 * len(letters):
                out += [(k, k + 1, FIGURES[text[k]]) for k in letters]
        return out

    def signs_of(self, text: str, words: set[str]) -> Edits:
        """At, dot and a few other signs for their disguises; spaces around them go with them."""
        found: list[tuple[int, int, str, int]] = []
        spaced = lambda b, e: (b - (len(text[max(0, b - 2) : b]) - len(text[max(0, b - 2) : b].rstrip(" "))), e + (len(text[e : e + 2]) - len(text[e : e + 2].lstrip(" "))))
        for m in self.bracketed.finditer(text):
            found.append((*spaced(*m.span()), self.signs[m[1].lower()], 0))
        for m in self.entity.finditer(text):
            found.append((*spaced(*m.span()), ENTITIES[m.group().lower()], 0))
        at = text.find("@")
        while at >= 0:
            if (span := spaced(at, at + 1)) != (at, at + 1):
                found.append((*span, "@", 1))
            at = text.find("@", at + 1)
        if "AT" in text and "DOT" in text:
            found += [(*m.span(), self.signs[m[1].lower()], 4) for m in self.capitals.finditer(text)]
        if self.at_words & words:
            found += [(*m.span(), "@", 2) for m in self.bare_at.finditer(text)]
        if self.dot_words & words:
            found += [(*m.span(), self.signs[m[1].lower()], 3) for m in self.bare_dot.finditer(text)]
        out: Edits = []
        for begin, end, new, _ in sorted(found, key=lambda x: (x[0], x[3])):
            if not out or begin >= out[-1][1]:
                out.append((begin, end, new))
        return out

    def chain(self, text: str) -> list[Rewritten]:
        """The texts of all transducers that changed something, first to last."""
        out: list[Rewritten] = []
        words: set[str] = set()
        for rule in (self.characters, self.spelled, self.letters_as_figures, self.signs_of):
            now = out[-1].text if out else text
            if rule == self.spelled:
                words = self.words(now)
            if edits := rule(now, words):
                out.append(Rewritten(now, edits))
        return out

    def trusted(self, kind: str, chain: list[Rewritten], begin: int, end: int, plain: Spans) -> bool:
        """Whether a disguised find is one: see the module's restraint."""
        if kind != "email":
            return True
        final = chain[-1]
        local, _, host = final.text[begin:end].partition("@")
        label = host.rsplit(".", 1)[-1].lower()
        if not label.isalpha() or len(label) < 2:
            return False
        source = chain[-2].text if len(chain) > 1 else None
        edits = [(b, e, new, (source if source is not None else self.source)[b:e]) for b, e, new in final.edited(begin, end)]
        word = lambda old: old.strip(" -").isalpha()
        ats = [old for *_, new, old in edits if new == "@"]
        dots = [old for *_, new, old in edits if new == "."]
        account = any(c in ".0123456789_%+-" for c in local) or dots
        if any(word(old) for old in ats) and not account:
            return False
        if any(old != "@" and old.strip(" ") == "@" for old in ats) and not account and label not in self.last:
            return False
        if plain and any(word(old) for old in dots) and label not in self.last:
            return False
        return True

    def spans(self, text: str) -> dict[str, list[tuple[int, int, bool]]]:
        """Kind to its spans (begin, end, plain) in order."""
        self.source = text
        base = {kind: find(text) for kind, find in DETECTORS.items()}
        out = {kind: [(b, e, True) for b, e in spans] for kind, spans in base.items()}
        chain = self.chain(text)
        if not chain:
            return out
        for kind, find in DETECTORS.items():
            for begin, end in find(chain[-1].text):
                b, e = begin, end
                for step in reversed(chain):
                    b, e = step.back(b, e)
                if text[b:e] == chain[-1].text[begin:end]:
                    continue  # nothing in it was disguised
                near = base[kind][max(0, bisect_right(base[kind], (b, b)) - 1) :]
                over = []
                for x, y in near:
                    if x >= e:
                        break
                    if y > b:
                        over.append((x, y))
                inside = all(b <= x and y <= e and (x, y) != (b, e) for x, y in over)
                if inside and self.trusted(kind, chain, begin, end, over):
                    out[kind].append((b, e, False))
        return {kind: sorted(spans) for kind, spans in out.items()}


# -- over tables -----------------------------------------------------------------------

SPAN = "struct<kind: string, first: int, last: int, plain: boolean, value: string>"


def private_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): per document its spans by kind, then place, with the source text of each.

    ``first`` and ``last`` count code points, the end exclusive; ``plain`` tells finds of
    the base patterns from disguised ones.
    """
    fields = [("kind", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("plain", pa.bool_()), ("value", pa.string())]
    spans_type = pa.list_(pa.struct(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = per_process("private", Transducers)
        for batch in small(batches):
            found = []
            for text in batch.column(1).to_pylist():
                spans = rules.spans(text)
                found.append([{"kind": k, "first": b, "last": e, "plain": p, "value": text[b:e]} for k in KINDS for b, e, p in spans[k]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, spans_type)], ["doc_id", "spans"])

    return texts(docs).mapInArrow(run, f"doc_id long, spans array<{SPAN}>")


def joined(spans: Column) -> Column:
    """``kind:first:last`` of spans, with commas between."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"], s["last"])), ",")


def private_table(docs: DataFrame) -> DataFrame:
    """Per document the plain finds counted by kind, their digest, and all spans."""
    plain = F.filter("spans", lambda s: s["plain"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["plain"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return private_spans(docs).select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(plain), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def masked(docs: DataFrame) -> DataFrame:
    """(doc_id, text): each text with every found span replaced by its kind in brackets.

    Overlapping spans are one, named by the first of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = per_process("private", Transducers)
        for batch in small(batches):
            out = []
            for text in batch.column(1).to_pylist():
                pieces, at = [], 0
                for b, e, kind in sorted((b, e, k) for k, v in rules.spans(text).items() for b, e, _ in v):
                    if b >= at:
                        pieces += [text[at:b], f"[{kind}]"]
                    at = max(at, e)
                out.append("".join(pieces) + text[at:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return texts(docs).mapInArrow(run, "doc_id long, text string")
