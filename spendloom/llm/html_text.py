"""Main text of web pages by minimum-cut labelling.

A page is read into text blocks with their place in the element tree.  Each
block is a node of a flow network.  A linear classifier over its elements, class
names, link share and length gives it a cost for either label: the capacities
of its edges to the two terminals.  Neighbouring blocks, and blocks of the same
container, are joined by smoothness edges that weigh less with their distance in
the tree.  The minimum cut, found by maximum flow, is the labelling with the
least total cost; blocks on the content side are the text.

Plain evidence (a menu, a footer, an advert) outweighs all neighbours.  Blocks
that say little of themselves, such as a short line or a division without a
telling name, cost about as much as an edge, so their neighbours decide.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendloom.llm.common import slices

_SKIP = frozenset("script style noscript template iframe svg math head title select textarea button object canvas video audio".split())
_BLOCK = frozenset(
    "html body main article section header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
    "caption blockquote pre form fieldset figure figcaption address details summary dialog center hr legend menu".split()
)
_VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
_P_ENDS = _BLOCK - {"html", "body", "td", "th", "tr"}
_BOILERPLATE_TAGS = frozenset("nav footer aside form dialog menu".split())
_BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal "
    "overlay sidebar side widget menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer copyright legal comment comments "
    "reply replies discussion disqus respond share sharing social related recommended newsletter subscribe signup login search pagination pager "
    "toolbar tags skip complementary contentinfo".split()
)
#: Words that name a place rather than a kind of text, where they follow a word of _CONTENT.
_PLACES = frozenset("header masthead topbar side".split())
_SAYS_WHAT_IS_THERE = frozenset("has have no not with without is show hide".split())
_CONTENT = frozenset("article content main post entry story body text".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(?P<close>/?)(?P<tag>[A-Za-z][A-Za-z0-9-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S
)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_QUOTED = re.compile("\"[^\"]*\"|'[^']*'")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=]|$)", re.I)
_HIDING = re.compile(r"""aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none""", re.I)
_WORD = re.compile("[a-z]+")

#: Weights of the classifier: its sum is above 0 for content.
W_ARTICLE, W_BOILERPLATE, W_PLACE, W_CONTENT_NAME, W_LINKS, W_TEXT_TAG, W_WORDS, W_BASE = 5.0, -14.0, -2.0, 2.0, -4.0, 1.0, 0.05, -1.0
#: Smoothness of neighbours (a third of it between siblings) and of blocks of one container.
NEAR, SAME = 3.0, 0.5


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with columns text and n_chars (code points).

    White space inside a block is one space, blocks are joined by a line feed.
    A null or empty page has the empty text.
    """

    @F.arrow_udf("string")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            found = []
            for part in slices(pa.record_batch([column], ["text"]), "text"):
                found += [main_text(h or "") for h in part.column("text").to_pylist()]
            yield pa.array(found, pa.string())

    return pages.withColumn("text", run(F.col(html_col))).withColumn("n_chars", F.char_length("text").cast("long"))


def main_text(page: str) -> str:
    found = blocks(page)
    if not found:
        return ""
    labels = minimum_cut([score(b) for b in found], smoothness(found))
    return "\n".join(b.text for b, content in zip(found, labels) if content)


class Block:
    """A run of text between block elements; path holds the elements around it, outermost first."""

    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: tuple, linked: int) -> None:
        self.text, self.path, self.linked = text, path, linked


class _Element:
    __slots__ = ("tag", "names")

    def __init__(self, tag: str, names: tuple[bool, bool, bool]) -> None:
        self.tag, self.names = tag, names


def blocks(page: str) -> list[Block]:
    found, stack, parts, linked = [], [], [], 0
    in_link = False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append(Block(text, tuple(stack), linked))
            parts.clear()
        linked = 0

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else end]
        if text:
            parts.append(text)
            if in_link:
                linked += len(text)
        if not m:
            break
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in _SKIP or (not m["close"] and tag not in _VOID and _hidden(m["attrs"])):
            if not m["close"]:
                at = _behind(page, tag, at)
                if tag in _BLOCK:
                    flush()
            continue
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = not m["close"]
        elif tag in _BLOCK:
            flush()
            if m["close"]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        in_link = False
                        break
            else:
                if stack and stack[-1].tag == "p" and tag in _P_ENDS or stack and stack[-1].tag == tag and tag in ("li", "dt", "dd", "td", "th", "tr", "p"):
                    stack.pop()
                if tag not in _VOID:
                    stack.append(_Element(tag, _names(m["attrs"])))
    flush()
    return found


def _hidden(attrs: str) -> bool:
    return bool(attrs) and bool(_HIDDEN.search(_QUOTED.sub('""', attrs)) or _HIDING.search(attrs))


def _behind(page: str, tag: str, at: int) -> int:
    """The end of an element whose content is no text; elements of its name may nest, but for raw text."""
    depth = 1
    raw = tag in ("script", "style", "textarea")
    for m in re.compile(rf"<(/?){tag}\b[^>]*>", re.I).finditer(page, at):
        depth += -1 if m[1] else 0 if raw or m[0].endswith("/>") else 1
        if not depth:
            return m.end()
    return len(page) if raw else at


def _names(attrs: str) -> tuple[bool, bool, bool]:
    """What classes, id and role say: boilerplate, a place that may be either, content."""
    if "=" not in attrs:
        return False, False, False
    tokens = [t for m in _NAMES.finditer(attrs) for t in (m[1] or m[2] or m[3] or "").lower().split()]
    found = [_told_by(t) for t in tokens]
    return any(f[0] for f in found), any(f[1] for f in found), any(f[2] for f in found)


@lru_cache(10_000)
def _told_by(token: str) -> tuple[bool, bool, bool]:
    """The same of one name.

    "has-sidebar" tells of a neighbour.  A name that begins with a word of
    content is what its last word says ("article-comments", but not
    "article-comment-analysis"); in others any word of boilerplate counts.
    """
    words = _WORD.findall(token)
    if not words or words[0] in _SAYS_WHAT_IS_THERE:
        return False, False, False
    content = not _CONTENT.isdisjoint(words)
    if words[0] not in _CONTENT:
        return not _BOILERPLATE.isdisjoint(words), False, content
    place = words[-1] in _PLACES
    return words[-1] in _BOILERPLATE and not place, place and words[-1] in _BOILERPLATE, content


def score(block: Block) -> float:
    """The classifier: above 0 for content.  Boilerplate outweighs an article around it."""
    total, inside, boilerplate, place, named = W_BASE, False, False, False, False
    for element in block.path:
        inside |= element.tag in ("article", "main")
        boilerplate |= element.tag in _BOILERPLATE_TAGS or element.tag == "header" and not inside
        says_boilerplate, says_place, says_content = element.names
        boilerplate |= says_boilerplate and element.tag not in ("html", "body", "main", "article")
        place |= says_place
        named |= says_content
    total += W_ARTICLE * inside + W_BOILERPLATE * boilerplate + W_PLACE * place + W_CONTENT_NAME * named
    total += W_LINKS * min(1.0, block.linked / len(block.text))
    if block.path and block.path[-1].tag in ("p", "h1", "h2", "h3", "h4", "blockquote", "pre"):
        total += W_TEXT_TAG
    return total + W_WORDS * min(60, block.text.count(" ") + 1)


def smoothness(found: list[Block]) -> list[tuple[int, int, float]]:
    """Edges of each block to the one before it and to the last one of its container's container."""
    edges, last = [], {}
    for i, block in enumerate(found):
        if i:
            a, b = found[i - 1].path, block.path
            shared = 0
            for x, y in zip(a, b):
                if x is not y:
                    break
                shared += 1
            edges.append((i - 1, i, NEAR / (1 + len(a) + len(b) - 2 * shared)))
        container = id(block.path[-2]) if len(block.path) > 1 else 0
        before = last.get(container, i - 1)
        if before < i - 1:
            edges.append((before, i, SAME))
        last[container] = i
    return edges


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) of least cost: scores against a label are paid, and edges cut.

    The terminals' capacities are the scores' parts above and below 0.  Shortest
    augmenting paths lead from a node with content surplus to the nearest one
    that takes it; what can still be reached from a surplus is content.  Nodes
    from which no such path is left never get one again and are not searched
    twice, so a long page costs little more than its length.
    """
    surplus = list(scores)
    out: list[dict[int, float]] = [{} for _ in scores]
    for a, b, weight in edges:
        out[a][b] = out[a].get(b, 0.0) + weight
        out[b][a] = out[b].get(a, 0.0) + weight
    tiny = 1e-9
    cut_off = [False] * len(scores)
    for source in range(len(scores)):
        while surplus[source] > tiny and not cut_off[source]:
            came, queue, sink = {source: source}, [source], -1
            for node in queue:
                if surplus[node] < -tiny:
                    sink = node
                    break
                for other, room in out[node].items():
                    if room > tiny and other not in came and not cut_off[other]:
                        came[other] = node
                        queue.append(other)
            if sink < 0:
                for node in queue:
                    cut_off[node] = True
                break
            flow, node = min(surplus[source], -surplus[sink]), sink
            while node != source:
                flow = min(flow, out[came[node]][node])
                node = came[node]
            node = sink
            while node != source:
                out[came[node]][node] -= flow
                out[node][came[node]] += flow
                node = came[node]
            surplus[source] -= flow
            surplus[sink] += flow
    reached = [i for i, s in enumerate(surplus) if s > tiny]
    seen = set(reached)
    for node in reached:
        for other, room in out[node].items():
            if room > tiny and other not in seen:
                seen.add(other)
                reached.append(other)
    return [i in seen for i in range(len(scores))]
