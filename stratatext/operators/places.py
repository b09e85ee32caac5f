"""Places of many needles in a text, by one pass of an automaton over it.

The needles of a text become a trie with failure links, and the text is read once
whatever their number.  Works per row inside Spark tasks: a row holds a text and the
needles to seek in it, which a shuffle on the text's key has brought together.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def places(text: str, needles: Iterable[str]) -> dict[str, list[int]]:
    """Ascending starts, in code points, of each non-empty needle that the text holds; overlaps count."""
    import ahocorasick

    trie = ahocorasick.Automaton()
    for needle in set(needles):
        if needle:
            trie.add_word(needle, needle)
    found: dict[str, list[int]] = {}
    if len(trie):
        trie.make_automaton()
        for end, needle in trie.iter(text):
            found.setdefault(needle, []).append(end + 1 - len(needle))
    return found


def first_from(starts: list[int], at: int | None) -> int | None:
    """The first start from ``at`` on, else the first of all; None if there is none."""
    if not starts:
        return None
    k = 0 if at is None else bisect_left(starts, at)
    return starts[k] if k < len(starts) else starts[0]


def seek(rows: DataFrame, text: str, asked: str, keep: list[str]) -> DataFrame:
    """``keep``, each row's ``asked`` entries' ``tag``, and ``at``: where their key stands.

    ``asked`` is an array of structs with ``tag``, ``key`` and ``hint``; ``at`` is the key's
    first place from the hint on, else its first place, else null.  A null text, and a null
    or empty key, have no place.
    """
    types = {f.name: f.dataType for f in rows.schema}
    tag = types[asked].elementType["tag"].dataType
    schema = ", ".join(f"`{c}` {types[c].simpleString()}" for c in keep) + f", tag {tag.simpleString()}, at long"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for held, raw, wanted in zip(frame[keep].itertuples(index=False, name=None), frame[text], frame[asked], strict=True):
                if wanted is None or not len(wanted):
                    continue
                found = places(raw, (w["key"] for w in wanted if w["key"])) if isinstance(raw, str) else {}
                at = [first_from(found.get(w["key"]) or [], w["hint"]) for w in wanted]
                out = pd.DataFrame([held] * len(at), columns=keep)
                yield out.assign(tag=[w["tag"] for w in wanted], at=pd.array(at, dtype="Int64"))

    return rows.select(*keep, text, asked).mapInPandas(run, schema)
