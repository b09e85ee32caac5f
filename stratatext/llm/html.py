"""Main text of web pages by a minimum cut over their text blocks.

A page is cut into blocks of text between block-level tags.  Each block has a cost for
being called content and one for being called boilerplate; the two are its capacities
to the cut's terminals.  Blocks next to each other, and blocks under one parent, are
joined by edges that cost something to cut, more the closer they are in the tree.  The
minimum cut is the labelling of least total cost.

Costs are log odds: fixed ones for the tags that say what a part of a page is, bounded
ones for names, and ones learned over all pages for the look of every block (length,
share of links, own tag, sentence marks), from the blocks that the others decide.  A
part that holds the page's content hands down no evidence against it.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: tags inside a line of text, tags without content, tags whose
#: content is no text of the page, and those that a new one of the same kind closes.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe select option button object canvas math".split())
ALIKE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr"}, "th": {"tr"}}
#: Tags and parts of class, id or role names that tell what they hold, with log odds.
TAGS = {"article": 4.0, "main": 3.0, "nav": -9.0, "header": -6.0, "footer": -9.0, "aside": -9.0, "form": -9.0, "dialog": -9.0, "menu": -9.0, "head": -20.0, "figcaption": -1.0}
NAMES = {
    "content": 2.0, "article": 3.0, "post": 1.0, "entry": 2.0, "story": 2.0, "body": 0.5, "main": 2.0,
    "ad": -9.0, "ads": -9.0, "advert": -9.0, "advertisement": -9.0, "sponsor": -9.0, "sponsored": -9.0, "promo": -9.0, "banner": -9.0,
    "nav": -9.0, "navbar": -9.0, "navigation": -9.0, "menu": -9.0, "breadcrumb": -9.0, "breadcrumbs": -9.0, "header": -6.0, "footer": -9.0,
    "sidebar": -9.0, "side": -6.0, "widget": -9.0, "related": -9.0, "recommended": -9.0, "share": -9.0, "social": -9.0,
    "comment": -9.0, "comments": -9.0, "reply": -9.0, "replies": -9.0, "disqus": -9.0, "respond": -9.0,
    "cookie": -9.0, "cookies": -9.0, "consent": -9.0, "notice": -9.0, "alert": -9.0, "popup": -9.0, "modal": -9.0, "newsletter": -9.0,
    "subscribe": -9.0, "subscription": -9.0, "signup": -9.0, "login": -9.0, "search": -9.0, "copyright": -9.0, "legal": -9.0, "pager": -9.0, "pagination": -9.0, "toolbar": -9.0,
}
#: Costs of cutting between neighbours, and between blocks of one parent.
NEXT, SIBLING = 1.0, 2.0
#: Bound of the names' log odds; a block's edges can outweigh it.
NAME_MOST = 3.0
#: Share of a page's text in a part that holds a title or article, and in any part, from
#: which it is what the page's content stands in.
HOLDS, HOLDS_ALL = 0.5, 0.9
#: Tags that have a look of their own.
LOOKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Evidence at least this strong labels a block for learning.
SURE = 3.0

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_NAME = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_PART = re.compile(r"[a-z]+")


class Block:
    __slots__ = ("text", "parent", "group", "depth", "evidence", "tag", "links")

    def __init__(self, text: str, parent: int, depth: int, evidence: float, tag: str, links: float):
        self.text, self.parent, self.group, self.depth, self.evidence, self.tag, self.links = text, parent, parent, depth, evidence, tag, links


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order, white space within a block made one space."""
    stack = [("", 0)]  # tag, number
    parts = [("", 0, 0.0, 0.0)]  # tag, number of the part above, log odds of tag and of names
    out: list[Block] = []
    text: list[str] = []
    linked = number = 0
    in_link = False

    def close() -> None:
        nonlocal linked
        words = " ".join(entities.unescape("".join(text)).split())
        if words:
            at = next(x for x in reversed(stack) if x[0] not in INLINE)
            out.append(Block(words, at[1], len(stack), 0.0, at[0], min(1.0, linked / len(words))))
        text.clear()
        linked = 0

    def pop_to(tag: str, stop: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == tag:
                del stack[k:]
                return
            if stack[k][0] in stop:
                return

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        run = page[at : m.start() if m else end]
        if run:
            text.append(run)
            linked += len(run) * in_link
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW and not closing:
            stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if m[3].rstrip()[-1:] != "/":
                at = stop.end() if stop else end
            text.append(" ")
            continue
        if tag == "br" or tag in ("img", "wbr"):
            text.append(" " if tag != "wbr" else "")
            continue
        if tag == "a":
            in_link = not closing
        if tag in INLINE:
            continue
        close()
        if tag in VOID:
            continue
        if closing:
            pop_to(tag, set())
        else:
            if stack[-1][0] == "p":  # no block stands inside a paragraph
                stack.pop()
            if tag in ALIKE:
                pop_to(tag, ALIKE[tag])
            named = 0.0
            if "=" in m[3]:
                for names in _NAME.findall(m[3]):
                    named += sum(NAMES.get(p, 0.0) for p in set(_PART.findall(names.lower())))
            number += 1
            parts.append((tag, stack[-1][1], TAGS.get(tag, 0.0), max(-NAME_MOST, min(NAME_MOST, named))))
            stack.append((tag, number))
    close()
    found = evidence(parts, out)
    held = Counter(b.parent for b in out)
    held.update(above for _, above, _, _ in parts[1:])
    for b in out:
        b.evidence = found[b.parent]
        b.group = parts[b.parent][1] if held[b.parent] == 1 else b.parent  # a paragraph stands among its siblings
    return out


def evidence(parts: list[tuple[str, int, float, float]], some: list[Block]) -> list[float]:
    """Log odds of each part's text from the tags and names of it and of what it stands in."""
    n = len(parts)
    never = [False] * n  # in a part whose tag alone says that it is no content; forms can be around pages
    size, titled = [0] * n, [False] * n
    for i, (tag, above, of_tag, _) in enumerate(parts):
        never[i] = never[above] or (of_tag <= -SURE and tag != "form")
        titled[i] = tag in ("article", "main", "h1") and not never[i]
    for b in some:
        if not never[b.parent]:
            size[b.parent] += len(b.text)
    for i in range(n - 1, 0, -1):
        size[parts[i][1]] += size[i]
        titled[parts[i][1]] |= titled[i]
    tags, names = [0.0] * n, [0.0] * n
    for i in range(1, n):
        tag, above, of_tag, named = parts[i]
        around = tag in ("html", "body", "main", "article") or size[i] >= HOLDS_ALL * size[0] > 0 or (titled[i] and size[i] >= HOLDS * size[0] > 0)
        if around and not never[i]:
            of_tag, named = max(0.0, of_tag), max(0.0, named)
        # A part that is no content holds none, whatever is inside it.
        tags[i] = min(tags[above], tags[above] + of_tag) if tags[above] <= -SURE else (of_tag if of_tag <= -SURE else tags[above] + of_tag)
        names[i] = min(names[above], named) if names[above] < 0 else (named or names[above])
    return [t + x if x >= 0 else min(t, 0.0) + x for t, x in zip(tags, names, strict=True)]


def looks(b: Block) -> list[str]:
    """Names of what a block looks like, for the learned costs."""
    n = len(b.text)
    marks = sum(b.text.count(c) for c in ".,;!?")
    return [f"tag {b.tag if b.tag in LOOKS else 'other'}", f"length {min(12, n.bit_length())}", f"links {round(4 * b.links)}", f"marks {min(4, marks)}", f"end {b.text[-1] in '.!?'}"]


def edges(some: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours in order, and neighbours under one parent."""
    out, last = [], {}
    for i, b in enumerate(some):
        if i:
            out.append((i - 1, i, NEXT / (1 + abs(b.depth - some[i - 1].depth))))
        if b.group in last:
            out.append((last[b.group], i, SIBLING))
        last[b.group] = i
    return out


def minimum_cut(costs: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: -costs[i] for calling i content, plus each cut edge's weight.

    Nodes whose own cost outweighs all their edges are settled first, and their edges
    turned into costs of their neighbours; the rest goes to a maximum flow.
    """
    n, costs = len(costs), list(costs)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in links:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(costs[i]) >= sum(near[i].values()):
            label[i] = costs[i] > 0
            for j, w in near[i].items():
                del near[j][i]
                costs[j] += w if label[i] else -w
                queue.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, side in zip(rest, _flow(rest, costs, near), strict=True):
            label[i] = side
    return [bool(x) for x in label]


def _flow(rest: list[int], costs: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Maximum flow by shortest augmenting levels; the nodes still reached are content."""
    source, sink = -1, -2
    cap: dict[int, dict[int, float]] = {i: dict(near[i]) for i in rest}
    cap[source], cap[sink] = {}, {}
    for i in rest:
        a, b = (source, i) if costs[i] > 0 else (i, sink)
        cap[a][b] = abs(costs[i])
        cap[b].setdefault(a, 0.0)
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            u = queue.popleft()
            for v, c in cap[u].items():
                if c > 1e-9 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return [i in level for i in rest]
        path, open_ = [source], {u: iter(list(vs)) for u, vs in cap.items()}
        while path:
            u = path[-1]
            if u == sink:
                push = min(cap[a][b] for a, b in zip(path, path[1:], strict=False))
                for a, b in zip(path, path[1:], strict=False):
                    cap[a][b] -= push
                    cap[b][a] = cap[b].get(a, 0.0) + push
                path = [source]
                open_ = {u: iter(list(vs)) for u, vs in cap.items()}
                continue
            v = next((v for v in open_[u] if cap[u][v] > 1e-9 and level.get(v, -1) == level[u] + 1), None)
            if v is None:
                path.pop()
            else:
                path.append(v)


def learn(pages: DataFrame) -> dict[str, float]:
    """Log odds of each look, from the blocks of all pages that tags and names decide."""
    schema = pa.schema([("look", pa.string()), ("yes", pa.int64()), ("no", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yes: Counter = Counter()
        no: Counter = Counter()
        for batch in batches:
            for text in batch.column(1):
                for b in blocks(text.as_py()):
                    if abs(b.evidence) >= SURE:
                        (yes if b.evidence > 0 else no).update(["all", *looks(b)])
        names = sorted({*yes, *no})
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([yes[x] for x in names], pa.int64()), pa.array([no[x] for x in names], pa.int64())], schema=schema)

    counts = pages.mapInArrow(run, "look string, yes long, no long").groupBy("look").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    # As many rows as there are looks, a fixed number.
    got = {r["look"]: (r["yes"], r["no"]) for r in counts.collect()}
    all_yes, all_no = got.get("all", (0, 0))
    return {k: 0.5 * math.log((y + 1) / (all_yes + 2) * (all_no + 2) / (n + 1)) for k, (y, n) in got.items() if k != "all"}


def main_text(page: str, learned: dict[str, float]) -> str:
    some = blocks(page)
    costs = [b.evidence + sum(learned.get(x, 0.0) for x in looks(b)) for b in some]
    return "\n".join(b.text for b, keep in zip(some, minimum_cut(costs, edges(some)), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each whole page.

    Null and empty html give an empty text; null page_ids and urls stay null;
    repeated rows are answered each; no pages give no rows; other columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("html", F.lit("")).alias("html"), F.col("url").cast("string").alias("url"))
    learned = learn(rows)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(t.as_py(), learned) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], schema=schema)

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
