"""Main text of web pages by minimum-cut labelling.

A page is read into text blocks in page order. A linear classifier over a block's words, links,
marks and the elements around it gives the cost of calling it boilerplate or content; those are
the capacities to the two terminals. Neighbouring blocks, and neighbours under one parent, are
tied by edges that halve with every further step between them in the element tree. The maximum
flow from the content terminal to the other, found by blocking flows over shortest paths, gives
the minimum cut, and the cut separates content from boilerplate. Marks of boilerplate are worth
more than any edges; marks of content are not, so a heading, a date line or a paragraph of links
goes with what stands around it.

Defined cases: a null or empty page has the empty text; unclosed, misnested and cut-off markup
is read as browsers do in the main (a tag that never ends is dropped); pages of any length are
read whole; equal pages get equal texts; an empty table gives an empty table; result columns
replace input columns of the name.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterable
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarry.llm.common import mapped

#: Fixed element names of HTML: without content, not rendered as text, breaking the line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template textarea select option svg math iframe object canvas audio video head title datalist".split())
RAW = frozenset("script style textarea title iframe noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Start tags that leave an open head open; any other, and text, ends it.
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: What an opening tag closes when it is the nearest of these.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)", re.S)
RAW_ENDS = {tag: re.compile(rf"</{tag}\b[^>]*>?", re.I) for tag in RAW}
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=/\"'>]+)")
NAMES = re.compile(r"[a-z]+")

#: Classifier weights in favour of content, by element and by words of class, id and role.
TAGS = {"article": 1.2, "main": 0.8, "nav": -6.0, "footer": -6.0, "aside": -6.0, "form": -6.0, "menu": -6.0, "dialog": -6.0, "button": -6.0, "header": -3.0, "label": -2.0, "address": -1.5}
#: What counts for nothing inside an article: its own parts.
OWN_PARTS = frozenset(("article", "header"))
GOOD = dict.fromkeys("article content entry post story main text body".split(), 0.6)
BAD = dict.fromkeys(
    "nav navbar navigation menu sidebar aside footer header masthead banner ad ads advert advertisement adverts advertising sponsor sponsored promo promotion cookie cookies consent notice notices alert gdpr popup modal overlay newsletter subscribe subscription comment comments disqus reply replies respond related recommended share sharing social breadcrumb breadcrumbs pagination pager widget login signup search toolbar tags legal copyright disclaimer complementary contentinfo skip hidden".split(),
    -6.0,
)
#: What an article's own class may say against it; other words there are about its page.
STRAY = {n: BAD[n] for n in "ad ads advert advertisement sponsored promo comment comments reply replies related recommended".split()}
STOCK = re.compile(r"©|\ball rights reserved\b|\bcopyright\b|\bcookies?\b|\bsign up\b|\blog ?in\b|\bsubscribe\b|\bprivacy policy\b", re.I)
BIAS, PER_WORD, MOST_WORDS, SENTENCE, LINKED, STOCK_WEIGHT = -0.6, 0.06, 30, 0.7, -2.2, -1.6
LEAST_MARKS, MOST_MARKS = -8.0, 2.0
#: Edge weights of neighbours in the page and of neighbours under one parent; steps in the tree between siblings, and steps beyond which an edge is as good as none.
ADJACENT, SIBLINGS, BESIDE, FAR = 0.8, 0.4, 2, 12


@dataclass
class Element:
    tag: str
    parent: Element | None
    depth: int
    weight: float
    unseen: bool
    linked: bool
    story: bool  # in an article


@dataclass
class Block:
    text: str
    linked: int
    element: Element  # where its text begins
    box: Element  # the nearest element around that which breaks lines


def element(tag: str, attributes: str, parent: Element | None) -> Element:
    """An element with the evidence of its name and marks, added to what stands around it."""
    story = parent is not None and parent.story
    weight, unseen = 0.0 if story and tag in OWN_PARTS else TAGS.get(tag, 0.0), tag in UNSEEN
    if attributes.strip():
        for m in ATTRIBUTE.finditer(attributes):
            name = (m[1] or m[5] or "").lower()
            if name in ("class", "id", "role"):
                names = NAMES.findall(unescape(m[2] or m[3] or m[4] or "").lower())
                known = STRAY if tag == "article" else {} if tag in ("body", "html", "main") else BAD
                weight += min((known[n] for n in names if n in known), default=0.0)
                weight += max((GOOD[n] for n in names if n in GOOD), default=0.0)
            elif name == "hidden" or name == "aria-hidden" and "true" in m[0].lower() or name == "style" and re.search(r"display\s*:\s*none", m[0], re.I):
                unseen = True
    if parent is None:
        return Element(tag, None, 0, weight, unseen, tag == "a", tag == "article")
    return Element(tag, parent, parent.depth + 1, parent.weight + weight, unseen or parent.unseen, tag == "a" or parent.linked, story or tag == "article")


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in page order, outside what is never shown."""
    out: list[Block] = []
    parts: list[str] = []
    linked = at = 0
    begun = False
    top = Element("#page", None, 0, 0.0, False, False, False)
    here = owner = top
    open_: Counter[str] = Counter()  # open elements by name, so that a stray end tag costs no walk

    def leave(node: Element) -> None:
        """Close ``node`` and all in it."""
        nonlocal here
        while here is not node.parent:
            open_[here.tag] -= 1
            here = here.parent

    def flush() -> None:
        nonlocal linked, parts, begun
        if begun:
            text = " ".join("".join(parts).split())
            box = owner
            while box.parent is not None and box.tag not in BLOCK:
                box = box.parent
            out.append(Block(text, min(linked, len(text)), owner, box))
        parts, linked, begun = [], 0, False

    def end_head() -> None:
        while here.tag == "head":
            leave(here)

    def say(raw: str) -> None:
        nonlocal linked, owner, begun
        if raw.strip():
            end_head()
        if raw and not here.unseen:
            text = unescape(raw)
            parts.append(text)
            if not begun and text.strip():
                owner, begun = here, True
            if here.linked:
                linked += len(text.strip())

    while (m := TOKEN.search(html, at)) is not None:
        say(html[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if tag in BLOCK:
            flush()
        if m[1] or m[4]:
            if open_[tag]:
                node = here
                while node.tag != tag:
                    node = node.parent
                leave(node)
            continue
        if tag not in HEAD:
            end_head()
        if tag in VOID:
            continue
        if tag in BLOCK and open_["p"]:
            node = here
            while node.tag in ("p", "b", "i", "em", "strong", "span", "a", "u", "font", "small"):
                if node.tag == "p":
                    leave(node)
                    break
                node = node.parent
        if tag in CLOSES and any(open_[t] for t in CLOSES[tag][0]):
            ends, stops = CLOSES[tag]
            node = here
            while node is not top and node.tag not in stops:
                if node.tag in ends:
                    leave(node)
                    break
                node = node.parent
        here = element(tag, m[3] if m[2] else m[6], here)
        open_[tag] += 1
        if tag in RAW:
            close = RAW_ENDS[tag].search(html, at)
            at = close.end() if close else len(html)
            leave(here)
    say(html[at:])
    flush()
    return out


def evidence(block: Block) -> float:
    """The classifier: above 0 for content. The sum of weights, its margin is the capacity."""
    words = block.text.count(" ") + 1
    score = BIAS + PER_WORD * min(words, MOST_WORDS) + LINKED * block.linked / len(block.text)
    if block.text.rstrip("\"'”’»)]")[-1:] in tuple(".!?…:;。！？"):
        score += SENTENCE
    if words <= 25 and STOCK.search(block.text):
        score += STOCK_WEIGHT
    return score + max(LEAST_MARKS, min(MOST_MARKS, block.element.weight))


def nearness(x: Element, y: Element) -> float:
    """1 for one element and for siblings, half of it for every further step between them in the tree."""
    steps = 0
    while x is not y and steps < FAR:
        if x.depth >= y.depth:
            x = x.parent
        else:
            y = y.parent
        steps += 1
    return 0.5 ** max(0, steps - BESIDE)


def smoothness(found: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours in the page, and between neighbours under one parent."""
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, ADJACENT * nearness(found[i - 1].box, b.box)))
        parent = id(b.box.parent or b.box)
        j = last.get(parent)
        if j is not None and j < i - 1:
            edges.append((j, i, SIBLINGS))
        last[parent] = i
    return edges


def labels(scores: list[float], edges: Iterable[tuple[int, int, float]]) -> list[bool]:
    """The minimum cut: which blocks stay with the content terminal. Evidence of one sign needs no flow."""
    if not scores or min(scores) > 0 or max(scores) <= 0:
        return [s > 0 for s in scores]
    ties: dict[int, dict[int, float]] = {i: {} for i in range(len(scores))}
    for i, j, w in edges:
        ties[i][j] = ties[i].get(j, 0.0) + w
        ties[j][i] = ties[j].get(i, 0.0) + w
    content = cut(list(enumerate(scores)), ties)
    return [i in content for i in ties]


def cut(terminals: list[tuple[int, float]], ties: dict[int, dict[int, float]]) -> set[int]:
    """Nodes on the source's side of a minimum cut, by blocking flows over shortest paths."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {source: {}, sink: {}}
    for i, near in ties.items():
        room[i] = dict(near)
    for i, s in terminals:
        if s > 0:
            room[source][i], room[i][source] = s, 0.0
        else:
            room[i][sink], room[sink][i] = -s, 0.0
    tiny = 1e-9
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            i = queue.popleft()
            for j, w in room[i].items():
                if w > tiny and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if sink not in level:
            return {i for i in ties if i in level}
        left = {i: list(room[i]) for i in level}
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                flow = min(room[a][b] for a, b in zip(path, path[1:], strict=False))
                for a, b in zip(path, path[1:], strict=False):
                    room[a][b] -= flow
                    room[b][a] = room[b].get(a, 0.0) + flow
                path = [source]
                continue
            while left[i]:
                j = left[i][-1]
                if room[i][j] > tiny and level.get(j) == level[i] + 1:
                    path.append(j)
                    break
                left[i].pop()
            else:
                path.pop()
                if path:
                    left[path[-1]].pop()


def main_text(html: str | None) -> str:
    """The text of the content blocks, joined in page order by one space."""
    found = blocks(html or "")
    keep = labels([evidence(b) for b in found], smoothness(found))
    return " ".join(b.text for b, k in zip(found, keep, strict=True) if k)


def with_main_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the main text of the html column."""
    at = pages.columns.index(html)

    def row(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([main_text(x) for x in batch.column(at).to_pylist()], pa.string())]

    return mapped(pages, row, [T.StructField(text, T.StringType(), False)])
