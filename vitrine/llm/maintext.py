"""Main text of web pages by a minimum cut.

A page's blocks are the nodes. A small classifier gives each block a cost of
being called content and one of being called boilerplate: log-odds from its
length, punctuation, link share and tag, from whether it stands in or beside the
page's article element, and, bounded, from the tags and class and role words
around it. Those are the capacities of its edges to the two terminals.
Blocks next to each other, and siblings in the DOM, are joined by edges whose
capacity follows how near they are in the tree. The minimum cut between the
terminals is the cheapest labelling; maximum flow finds it. So a short line
among paragraphs is content, a sentence among links isn't.

Pages are independent rows, worked on one at a time in Arrow batches, in time
that follows a page's length; memory follows the longest page.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# possessive, and no tag goes on over another one's beginning, so nothing is read again for each "<"
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^<>]*+>|<(/?)([a-zA-Z][^\s/<>]*+)((?:"[^"]*+"|'[^']*+'|[^<>"'])*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[a-z]+")

#: HTML's elements by what they do.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "textarea", "title", "object", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
FRAME = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "fieldset", "head"}
#: Words of class, id and role that name what is around an article.
FRAME_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification banner popup modal overlay "
    "menu nav navbar navigation breadcrumb breadcrumbs sidebar complementary aside widget footer contentinfo masthead topbar comment comments disqus respond reply replies discussion "
    "share sharing social related recommended newsletter subscribe subscription signup login search pagination pager toolbar skip alert dialog form".split()
)
_PROSE = {"h1", "h2", "h3", "p", "blockquote", "pre"}
ARTICLE_WORDS = {"article", "content", "main", "post", "entry", "story", "body", "text"}


#: Beginnings of class names that tell what an element is laid out with, not what it is.
LAYOUT = {"with", "without", "has", "no", "not", "is"}

#: Log-odds of content.
FRAMED, IN_ARTICLE, BESIDE_ARTICLE, LINKED = -4.5, 1.5, -4.0, -3.0
#: Capacity between siblings that follow each other, and between siblings apart.
NEXT, SIBLINGS = 2.0, 1.0
#: The share of a capacity that is left where only one end is framed, or in the article.
ACROSS = 0.1
#: Share of a page's words from which an article element is the page's article (the largest one always is), and a framed element that holds a headline is a wrapper.
LEAST_ARTICLE, LEAST_WRAPPER = 0.2, 0.5


@dataclass
class Block:
    text: str
    words: int
    linked: float
    element: int
    tag: str
    parent: int
    depth: int
    score: float = 0.0
    #: Whether it is framed, and whether it is in the page's article.
    side: tuple[bool, bool] = (False, False)


@dataclass
class Element:
    name: str
    parent: int
    #: The nearest element that is not inline, itself included, and how many of those it is in.
    block: int
    depth: int
    frame: float
    article: bool
    #: Words before it and in it; whether a main headline or an article is in it.
    words: int = 0
    headline: bool = False


def _kind(name: str, attributes: str) -> tuple[float, bool]:
    """How surely an element is around the article (2 for hidden ones), and whether it is one."""
    frame, article = float(name in FRAME), name in ("article", "main")
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "style" and _HIDDEN.search(value)) or (key == "aria-hidden" and value.lower() == "true"):
            frame = 2.0
        elif key in ("class", "id", "role") and name not in ("html", "body", "main", "article"):
            for one in value.lower().split():
                words = _WORD.findall(one)
                if words and words[0] not in LAYOUT:
                    frame = max(frame, float(not FRAME_WORDS.isdisjoint(words)))
                    article |= not ARTICLE_WORDS.isdisjoint(words)
    return frame, article and not frame


def parsed(html: str) -> tuple[list[Block], list[Element]]:
    """Runs of text between block-level tags, in page order, and the elements."""
    elements = [Element("", 0, 0, 0, 0.0, False)]
    found: list[Block] = []
    stack, open_ = [0], Counter()
    parts: list[str] = []
    linked = at = words = 0
    in_link = False

    def ended() -> None:
        nonlocal linked, words
        text = " ".join(unescape("".join(parts)).split())
        parts.clear()
        share, linked = linked, 0
        if text:
            own = elements[elements[stack[-1]].block]
            n = text.count(" ") + 1
            words += n
            found.append(Block(text, n, min(1.0, share / len(text)), stack[-1], own.name, elements[own.parent].block, own.depth))

    def close(to: int) -> None:
        for number in stack[to:]:
            one = elements[number]
            one.words = words - one.words
            open_[one.name] -= 1
            elements[one.parent].headline |= one.headline or one.name in ("h1", "article", "main")
        del stack[to:]

    length = len(html)
    while at < length:
        tag = _TAG.search(html, at)
        text = html[at : tag.start() if tag else length]
        if text:
            parts.append(text)
            linked += len(text) * in_link
        if not tag:
            break
        at = tag.end()
        if not tag[2]:
            continue
        name, closing = tag[2].lower(), bool(tag[1])
        if name in RAW and not closing:
            if not tag[3].rstrip().endswith("/") or name not in ("svg", "math"):
                end = re.compile(rf"</{re.escape(name)}\b[^<>]*+>", re.I).search(html, at)
                at = end.end() if end else length
            continue
        if name == "a":
            in_link = not closing
        if name not in INLINE:
            ended()
        if closing:
            if open_[name]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if elements[stack[i]].name == name))
        elif name not in VOID:
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and open_[name]:  # an open one ends here
                for i in range(len(stack) - 1, 0, -1):
                    other = elements[stack[i]].name
                    if other == name:
                        close(i)
                        break
                    if other not in INLINE and other not in ("p", "td", "th", "dt", "dd"):
                        break
            above = elements[stack[-1]]
            number = len(elements)
            frame, article = _kind(name, tag[3])
            inline = name in INLINE
            elements.append(Element(name, stack[-1], above.block if inline else number, above.depth + (not inline), frame, article, words))
            stack.append(number)
            open_[name] += 1
    ended()
    close(1)
    elements[0].words = words
    return found, elements


def scored(html: str) -> list[Block]:
    """A page's blocks with the log-odds that they are content, by themselves."""
    found, elements = parsed(html)
    total = max(1, elements[0].words)
    least = min(LEAST_ARTICLE * total, max((e.words for e in elements if e.article), default=0))
    # what an element inherits: frames, whether it is in an article, in a header
    frame, inside, header = ([0.0] * len(elements) for _ in range(3))
    for i, e in enumerate(elements[1:], 1):
        own = e.frame
        if own == 1 and e.name not in FRAME and e.headline and e.words > LEAST_WRAPPER * total:
            own = 0.25  # a wrapper of the article, whatever its class says
        article = e.article and e.words >= least
        inside[i] = float(article or (inside[e.parent] and own < 1))
        header[i] = float(not inside[i] and (header[e.parent] or e.name == "header"))
        frame[i] = max(frame[e.parent], own, header[i])
    some = any(inside[b.element] for b in found)
    for b in found:
        at = b.element
        b.side = (frame[at] >= 1, inside[at] > 0)
        b.score = min(2.0, max(-1.0, 0.8 * log2(b.words / 8))) + 0.5 * (b.text[-1] in ".!?…:;\"'»”)") + 1.1 * (b.tag in _PROSE)
        b.score += LINKED * b.linked + FRAMED * frame[at] + (IN_ARTICLE * inside[at] or BESIDE_ARTICLE * some)
    return found


def _edges(found: list[Block]) -> Iterator[tuple[int, int, float]]:
    last_of: dict[int, int] = {}
    for i, b in enumerate(found):
        before = last_of.get(b.parent)
        if i:
            near = found[i - 1]
            apart = abs(near.depth - b.depth) + 2 * (near.parent != b.parent)
            yield i - 1, i, NEXT / (1 + apart / 2) * (ACROSS if near.side != b.side else 1)
        if before is not None and before != i - 1:
            yield before, i, SIBLINGS * (ACROSS if found[before].side != b.side else 1)
        last_of[b.parent] = i


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that cost least: a node pays ``-gain`` if true and ``gain`` if false (where that is positive), an edge its capacity if its ends differ.

    Shortest augmenting paths in level graphs; nodes that the flow leaves on the source's side are true.
    """
    n = len(gain)
    source, sink = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def join(a: int, b: int, forth: float, back: float) -> None:
        graph[a].append(len(to))
        to.append(b)
        room.append(forth)
        graph[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, g in enumerate(gain):
        join(source, i, g, 0.0) if g > 0 else join(i, sink, -g, 0.0)
    for a, b, c in edges:
        join(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in graph[u]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        turn = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(i for i, e in enumerate(path) if room[e] <= 1e-9)
                u = to[path[cut] ^ 1]
                del path[cut:]
            while turn[u] < len(graph[u]):
                e = graph[u][turn[u]]
                if room[e] > 1e-9 and level[to[e]] == level[u] + 1:
                    path.append(e)
                    u = to[e]
                    break
                turn[u] += 1
            else:
                if not path:
                    break
                u = to[path.pop() ^ 1]
                turn[u] += 1


def labels(found: list[Block]) -> list[bool]:
    """Which blocks are content."""
    gains = [b.score for b in found]
    if all(g > 0 for g in gains) or not any(g > 0 for g in gains):
        return [g > 0 for g in gains]
    return minimum_cut(gains, list(_edges(found)))


def main_text(html: str | None) -> str:
    """Content blocks in page order, joined by one space."""
    found = scored(html or "")
    return " ".join(b.text for b, keep in zip(found, labels(found), strict=True) if keep)


def extracted(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id_col`` and ``text``, a row for each row of ``pages``.

    Null or empty html, and html without content, give the empty text. Broken
    markup is read as far as it goes. Repeated rows give repeated results;
    other columns are neither read nor returned.
    """
    field = pages.schema[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[field.name, "text"])

    schema = T.StructType([T.StructField(field.name, field.dataType), T.StructField("text", T.StringType())])
    return pages.select(F.col(f"`{id_col}`"), F.col(f"`{html_col}`")).mapInArrow(run, schema)
