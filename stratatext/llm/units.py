"""Text units: what a byte-level splitter never crosses, encoded once and remembered.

A unit is what stands between two spaces; a line feed opens a new unit and belongs to
it.  With a space before it and no white space at its ends, a unit is split and
encoded alike in any text, so a worker keeps a bounded table of units.  Texts with
other units (doubled spaces, tabs at an end and so on) are encoded as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

#: Entries after which the table starts anew, and the longest unit it keeps.
CACHE_ENTRIES = 800_000
CACHE_LENGTH = 64


class Units:
    """Encodes lists of texts to packed ids.

    ``encode_units`` takes units as they stand in a text, with their leading space or
    line feed, and ``encode_text`` any text.
    """

    def __init__(self, encode_units: Callable[[list[str]], list[bytes]], encode_text: Callable[[str], bytes], limit: int = CACHE_ENTRIES):
        self.encode_units, self.encode_text, self.limit = encode_units, encode_text, limit
        self.known: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}

    def texts(self, some: list[str]) -> list[bytes]:
        split = [t.replace("\n", " \n").split(" ") for t in some]
        heads = [s[0] for s in split]
        for s in split:
            s[0] = "\n-"  # any unit that is known; the head is encoded without a space
        met = set().union(*split)
        new = [u for u in met if u not in self.known]
        whole = {u for u in new if not _plain(u)}
        if len(self.known) + len(new) > self.limit:
            self.known, new = {}, met
        new = [u for u in new if u not in whole]
        known = self.known
        known.update(zip(new, self.encode_units([u if u[0] == "\n" else " " + u for u in new]), strict=True))
        skip = len(known["\n-"])
        out = []
        for text, head, units in zip(some, heads, split, strict=True):
            if not head or head != head.strip() or (whole and not whole.isdisjoint(units)):
                out.append(self.encode_text(text) if text else b"")
            else:
                out.append(self.head(head) + b"".join(map(known.__getitem__, units))[skip:])
        for u in new:
            if len(u) > CACHE_LENGTH:
                del known[u]
        return out

    def head(self, head: str) -> bytes:
        if head not in self.heads:
            if len(self.heads) > self.limit // 8:
                self.heads = {}
            self.heads[head] = self.encode_text(head)
        return self.heads[head]


def _plain(unit: str) -> bool:
    body = unit[1:] if unit[:1] == "\n" else unit
    return bool(body) and body == body.strip()
