"""Main text of HTML pages by minimum-cut labelling.

A page is cut into text blocks at block-level tags in one scan from left to
right.  A linear classifier over each block (length, punctuation, share of link
text, kinds and names of its ancestors) gives its log-odds of being content,
``WEIGHTS``; these are its capacities to the two terminals.  Smoothness edges are
on the same scale: between neighbours, the stronger the nearer their containers
are in the tree; between next but one of a container; and between a block of a list, table,
quotation or figure and the last one that the container's parent (or its next ancestor with a block) holds, so a list
hangs on the paragraph before it.  The minimum cut between the terminals, found by maximum flow, is the
labelling of least total cost: a block that the classifier gets wrong (a word
alone in a paragraph, a line of links in the text) goes with its surroundings
unless the evidence against it outweighs its edges.  The edges of a block that is surely content cost it together
less than its evidence, so short lines join an article or are left, but never drag it out.

Each page is labelled alone, in a narrow pass.

Rows: a null page is empty and has an empty text; broken markup is read as far
as it goes: unclosed elements end with their container, an unfinished tag or
comment at the end is dropped; of two labellings of equal cost (ties) the one
with less content is taken; repeated rows are each a row; a very long page is
read whole, in time that grows with its length and its blocks; an empty table
gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.functions.storage import spread
from cladeframe.llm.words import bound_batches

# Element kinds of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content is text of another kind, up to their end tag or the end of the page.
RAW = frozenset("script style textarea iframe noscript noembed noframes xmp".split())
#: Elements that show no text of the page.
SILENT = frozenset("template svg math select button object canvas audio video datalist".split())
CONTAINERS = SILENT | frozenset(
    "article aside blockquote body details dialog dd div dl dt fieldset figure footer form head header main menu nav ol search section "
    "table tbody thead tfoot tr td th ul li p a span title".split()
)
HANGING = frozenset("ul ol dl table thead tbody tfoot tr blockquote figure".split())
INLINE = frozenset("a span".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the left kind ends where one of the right kinds begins.
ENDS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th", "tr"), "th": ("td", "th", "tr"), "tr": ("tr",)}
# Words in names of elements.
BAD = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar "
    "breadcrumb breadcrumbs header masthead footer sidebar aside complementary contentinfo cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended "
    "comment comments disqus replies reply respond widget toolbar pagination pager copyright legal disclaimer form skip".split()
)
#: Those that stay what they are at the end of a longer name, as in ``post-comments``.
BAD_HEADS = frozenset("ad ads advert adverts nav navbar menu breadcrumbs footer sidebar cookies newsletter comments replies pagination".split())
GOOD = frozenset("article content main post entry story body text".split())
PLAIN = frozenset("site page box block wrap wrapper container section area inner outer list item items top bottom left right primary secondary global the my".split())
BAD_TAGS = frozenset("nav footer aside form menu dialog search fieldset".split())

#: Log-odds of content, in nats.  Derivation: text that is an article's runs to hundreds of characters in
#: sentences, so a block without marks breaks even at about 100 characters with a full stop, each doubling
#: of the length counts as much as four to one, and a text of links as fifteen to one against.  An element that
#: HTML defines as no main content (nav, aside, footer, form, dialog), or a name of such words only, counts
#: 10: more than the longest block can weigh up.  ``article`` and ``main`` count 3, twenty to one, and where a
#: page has them, being outside counts 8.  A name that holds such a word among others says little.
WEIGHTS = {
    "bias": -3.2,
    "length": 1.3,  # a doubling of 1 + n / 25, of four at most
    "stop": 0.5,
    "comma": 0.3,  # each, of four at most
    "links": -2.7,
    "main": 3.0,
    "outside": -8.0,
    "bad": -10.0,
    "maybe bad": -0.5,
    "good": 0.5,
    "hidden": -20.0,
    "short": -0.8,  # the least that the length of a block without links and without marks against it can say
}
#: Smoothness: neighbours in one container; it falls with the square of the steps between two containers.
NEAR, NEXT_BUT_ONE, HANGS = 2.0, 1.0, 0.75

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_END = re.compile(r"=\s*[\"']|>")
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z]+")


class Element:
    __slots__ = ("tag", "up", "depth", "mark", "main", "silent")

    def __init__(self, tag: str, up: Element | None, mark: float, main: bool, silent: bool):
        self.tag, self.up, self.mark, self.main, self.silent = tag, up, mark, main, silent
        self.depth = up.depth + 1 if up else 0


class Block:
    __slots__ = ("text", "links", "inside", "mark", "main")

    def __init__(self, text: str, links: int, own: Element):
        self.text, self.links, self.mark, self.main = text, links, own.mark, own.main
        while own.up and own.tag in ("p", "a", "span", "li", "td", "th", "dd", "dt"):  # the container of a block is what holds its own element
            own = own.up
        self.inside = own


def _name_mark(value: str, main: bool) -> float:
    """What the names in an attribute say: the strongest of them."""
    found = [0.0]
    for name in value.split():
        words = [w.lower() for w in _CAMEL.split(name) if w]
        bad = [w for w in words if w in BAD]
        if main and words == ["header"]:
            continue
        if bad and (all(w in BAD or w in PLAIN for w in words) or words[-1] in BAD_HEADS):
            found.append(WEIGHTS["bad"])
        elif bad:
            found.append(WEIGHTS["maybe bad"])
        elif any(w in GOOD for w in words) and all(w in GOOD or w in PLAIN for w in words):
            found.append(WEIGHTS["good"])
    return min(found) if min(found) < 0 else max(found)


def _element(tag: str, attrs: str, up: Element) -> Element:
    """An element with the evidence of its kind and names added to that of its ancestors."""
    main = up.main or tag in ("article", "main")
    mark = up.mark
    if tag in BAD_TAGS or (tag == "header" and not up.main):
        mark += WEIGHTS["bad"]
    elif main and not up.main:
        mark += WEIGHTS["main"]
    if tag == "head":
        mark += WEIGHTS["hidden"]
    names = 0.0
    if attrs and tag not in ("body", "html"):
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id", "role", "aria-label"):
                own = _name_mark(value, up.main)
                names = min(names, own) if own < 0 or names < 0 else max(names, own)
            elif key == "hidden" or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                mark += WEIGHTS["hidden"]
    return Element(tag, up, max(mark + names, -30.0), main, up.silent or tag in SILENT)


def _tag_end(html: str, at: int) -> int:
    """Where the tag ends whose name ends at ``at``: after its ``>``; -1 if it doesn't."""
    while m := _END.search(html, at):
        if m[0] == ">":
            return m.end()
        at = html.find(m[0][-1], m.end()) + 1
        if not at:
            return -1
    return -1


def blocks(html: str) -> list[Block]:
    """The text blocks of a page, in order."""
    out: list[Block] = []
    root = Element("", None, 0.0, False, False)
    here = root
    piece: list[str] = []
    links = in_link = 0
    low: str | None = None
    opened: Counter[str] = Counter()  # elements from the root to here, by kind

    def up_to(top: Element) -> Element:
        """Ends all elements from here up to below ``top``."""
        e = here
        while e is not top:
            opened[e.tag] -= 1
            e = e.up
        return top

    def close() -> None:
        nonlocal links
        if piece:
            text = " ".join(unescape("".join(piece)).split())
            if text:
                out.append(Block(text, links, here))
            piece.clear()
        links = 0

    def say(text: str) -> None:
        nonlocal links
        if text and not here.silent:
            piece.append(text)
            if in_link:
                links += len(text)

    at, size = 0, len(html)
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            say(html[at:])
            break
        say(html[at:lt])
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 2)
            at = end + 3 if end >= 0 else size
            continue
        m = _TAG.match(html, lt)
        if not m:
            if html.startswith(("<!", "<?", "</"), lt):  # a declaration, or an end tag of nothing
                end = html.find(">", lt)
                at = end + 1 if end >= 0 else size
            else:
                say("<")
                at = lt + 1
            continue
        at = _tag_end(html, m.end())
        if at < 0:
            break
        tag, ends, attrs = m[2].lower(), bool(m[1]), html[m.end() : at - 1]
        if tag in RAW and not ends:
            if low is None:
                low = html.lower() if len(html.lower()) == size else re.sub("[A-Z]", lambda c: c[0].lower(), html)
            end = low.find("</" + tag, at)
            at = size if end < 0 else end
            say(" ")
            continue
        if tag in BLOCKS:
            close()
        elif tag == "br":
            say(" ")
        if tag in VOID or tag not in CONTAINERS:
            continue
        if tag == "a":
            in_link = 0 if ends else 1
        if ends:
            if not opened[tag]:
                continue  # the end of nothing
            top = here
            while top.up and top.tag != tag:
                if tag in ("p", "li", "a", "span", "dd", "dt") and top.tag not in ("p", "li", "a", "span", "dd", "dt"):
                    break  # the end of something inside doesn't end what holds it
                if tag in INLINE and top.tag not in INLINE:
                    break
                top = top.up
            if top.up and top.tag == tag:
                here = up_to(top.up)
        elif not (tag in SILENT and attrs.endswith("/")):  # one that ends itself is complete
            if tag in BLOCKS:  # an open paragraph ends where a block begins
                while here.tag in ("p", "a", "span"):
                    here = up_to(here.up)
                if tag in ("li", "dd", "dt", "td", "th", "tr"):
                    top = here
                    while top.tag in ENDS:
                        if tag in ENDS[top.tag]:
                            here = up_to(top.up)
                            break
                        top = top.up
            here = _element(tag, attrs, here)
            opened[tag] += 1
    close()
    return out


def log_odds(b: Block, has_main: bool) -> float:
    """The classifier: the log-odds that a block is content."""
    w, n = WEIGHTS, len(b.text)
    out = w["bias"] + w["length"] * min(4.0, math.log2(1 + n / 25)) + w["comma"] * min(4, b.text.count(","))
    out += w["links"] * min(1.0, b.links / n) + b.mark
    if b.text[-1] in ".!?:;…\"”)":
        out += w["stop"]
    if b.mark >= 0 and b.links * 4 < n:
        out = max(out, w["short"])
    if has_main and not b.main:
        out += w["outside"]
    return out


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple]) -> list[bool]:
    """Which nodes are on the source's side of a minimum cut (Dinic's algorithm).

    An edge (u, v, cost, back) costs ``cost`` with u alone on the source's side and ``back`` with v alone; without ``back`` both are alike.
    """
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    adj: list[list[int]] = [[] for _ in range(n + 2)]

    def link(u: int, v: int, c: float, back: float) -> None:
        adj[u].append(len(to))
        to.append(v)
        cap.append(c)
        adj[v].append(len(to))
        to.append(u)
        cap.append(back)

    for i in range(n):
        if source[i] > sink[i]:
            link(s, i, source[i] - sink[i], 0.0)
        elif sink[i] > source[i]:
            link(i, t, sink[i] - source[i], 0.0)
    for u, v, c, *back in edges:
        link(u, v, c, back[0] if back else c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in adj[u]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                for i, e in enumerate(path):  # back to the first edge that is full
                    if cap[e] <= 1e-9:
                        u = to[e ^ 1]
                        del path[i:]
                        break
                continue
            while turn[u] < len(adj[u]):
                e = adj[u][turn[u]]
                if cap[e] > 1e-9 and level[to[e]] == level[u] + 1:
                    break
                turn[u] += 1
            if turn[u] < len(adj[u]):
                path.append(e)
                u = to[e]
            elif u == s:
                break
            else:
                e = path.pop()
                u = to[e ^ 1]
                turn[u] += 1


def _steps(a: Element, b: Element) -> int:
    """Steps in the tree from one element to another, of which more than 8 are not told apart."""
    n = 0
    while a is not b and n < 8:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
        n += 1
    return n


def smoothness(found: list[Block]) -> list[tuple[int, int, float]]:
    """Edges from adjacency and from nearness in the tree."""
    edges = []
    last: dict[Element, int] = {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, NEAR / (1 + _steps(found[i - 1].inside, b.inside)) ** 2))
        if i > 1 and found[i - 2].inside is b.inside:
            edges.append((i - 2, i, NEXT_BUT_ONE))
        up = b.inside
        while up.tag in HANGING:
            up = up.up
            if up in last:
                edges.append((last[up], i, HANGS))
                break
        last[b.inside] = i
    return edges


#: From this evidence on a block keeps this share of it above its edges; what an edge to a weak neighbour keeps beyond the evidence against that.
SURE, SHARE, SLACK = 1.0, 0.95, 0.5


def weighed(edges: list[tuple[int, int, float]], score: list[float]) -> list[tuple[int, int, float, float]]:
    """Edges with a cost for each direction: what it costs to part a block from those around it, in favour of either.

    The edges from a block that is surely content to those that aren't cost it
    together less than its own evidence: edges to weak neighbours are cut down first,
    to what takes such a neighbour in, then all alike.  So short lines can join an
    article, but none of them, and no number of them, can drag it out.
    """
    sure = [s >= SURE for s in score]
    near: dict[int, list[list]] = {}  # of each sure block: [cost, other block, edge]
    for k, (u, v, c) in enumerate(edges):
        if sure[u] != sure[v]:
            u, v = (u, v) if sure[u] else (v, u)
            near.setdefault(u, []).append([c, v, k])
    both = [[c, c] for _, _, c in edges]
    for u, own in near.items():
        excess = sum(c for c, _, _ in own) - SHARE * score[u]
        for e in sorted(own, key=lambda e: -score[e[1]]):
            less = min(max(excess, 0.0), max(0.0, e[0] - SLACK - max(-score[e[1]], 0.0)))
            e[0] -= less
            excess -= less
        part = min(1.0, SHARE * score[u] / max(sum(c for c, _, _ in own), 1e-9))
        for c, _, k in own:
            both[k][0 if edges[k][0] == u else 1] = c * part
    return [(u, v, *both[k]) for k, (u, v, _) in enumerate(edges)]


def label(html: str | None) -> list[tuple[str, bool, bool]]:
    """(text, whether the classifier alone calls it content, whether the cut does) of each block of a page."""
    found = blocks(html) if html else []
    if not found:
        return []
    has_main = any(b.main and b.mark > WEIGHTS["bad"] / 2 for b in found)
    score = [log_odds(b, has_main) for b in found]
    side = minimum_cut([max(x, 0.0) for x in score], [max(-x, 0.0) for x in score], weighed(smoothness(found), score))
    return [(b.text, x > 0, on) for b, x, on in zip(found, score, side)]


def main_text(html: str | None) -> str:
    """The main text of one page, a line a block."""
    return "\n".join(text for text, _, on in label(html) if on)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    bound_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return spread(rows).mapInArrow(run, "page_id long, url string, text string, n_chars long")
