"""Main text of web pages by composite text density.

Each page is parsed leniently into nodes. Menus, headers, adverts, forms and the like go
first, by element and by the words of class, id and role. What such a word marks comes
back if it holds most of the page and nothing like an article is left without it. Every remaining node gets a
density: its characters per tag, lowered where many of them are link text; inline
formatting belongs to its block. The block whose children's densities have the largest sum
is the core of the article. The least density on the way from it to the body is the
threshold: the core grows to a node on that way where a neighbour comes near the
threshold, whatever the elements are called, and link lists below it go.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element and attribute names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot "
    "th thead tr ul html head".split())
DROPPED = frozenset(
    "head script style noscript template iframe object embed applet canvas svg math audio video map nav footer aside form "
    "button select textarea input label fieldset dialog menu search title".split())
#: Words of class, id or role that mark what is not the article.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner sponsor sponsored sponsors promo promotion promoted "
    "nav navbar navigation menu submenu breadcrumb breadcrumbs masthead topbar footer sidebar aside complementary contentinfo "
    "widget widgets related recommended recommendations share sharing social cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login comment comments disqus respond replies pagination pager "
    "toolbar search skip copyright disclaimer paywall".split())
#: A name that begins or ends so says how the page is set up, not what the element is.
STATE_FIRST, STATE_LAST = frozenset("no not with without has".split()), frozenset("enabled disabled".split())
PAGE_HEADER = frozenset(("header", "siteheader", "pageheader"))
#: A new element of the key closes an open one of the values, up to a container.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
CONTAINERS = frozenset("ul ol dl table div article section main body select aside nav footer header blockquote form figure".split())

_TAG = re.compile(r"""<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[!?/][^>]*>)""")
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


ELEMENT, NAMED = 2, 1
#: Part of the threshold that a neighbour of the core must reach: short sections of an article are less dense.
MARGIN = 1 / 3


def _marked(name: str, attributes: str, in_article: bool) -> int:
    """Whether an element is boilerplate as such or hidden (ELEMENT), by a word of class, id or role (NAMED), or not (0)."""
    if name in DROPPED or name == "header" and not in_article:
        return ELEMENT
    if not attributes or name in ("html", "body", "article", "main"):
        # A reader's comment may be an article of its own.
        return ELEMENT * (name == "article" and in_article and "comment" in attributes.lower())
    mark = 0
    for key, value in _NAMES.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return ELEMENT
        if key == "style":
            if "display:none" in value.replace(" ", "").lower():
                return ELEMENT
        elif key in ("class", "id", "role"):
            names = [[w.lower() for w in _WORD.findall(x)] for x in value.split()]
            words = {w for x in names if x and x[0] not in STATE_FIRST and x[-1] not in STATE_LAST for w in x}
            if words & BOILERPLATE or not in_article and words & PAGE_HEADER:
                mark = NAMED
    return mark


class Page:
    """Nodes of a page (parent before child) and its text pieces and breaks in page order."""

    def __init__(self, source: str):
        self.name, self.parent, self.mark, self.link, self.article = ["#root"], [-1], [0], [False], [False]
        self.pieces: list[tuple[int, str | None]] = []  # (node, text), or (node, None) for a break
        stack, at, size = [0], 0, len(source)
        while at < size:
            found = _TAG.search(source, at)
            end = found.start() if found else size
            if end > at:
                self.pieces.append((stack[-1], source[at:end]))
            if not found:
                break
            at = found.end()
            if found[1]:
                stop = source.find("-->", at)
                at = size if stop < 0 else stop + 3
                continue
            name = (found[3] or found[6] or "").lower()
            if not name:
                continue
            if found[2] or found[5]:
                self._end(stack, name)
                continue
            self._start(stack, name, found[4] or found[7] or "")
            if name in RAW:
                stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                at = stop.start() if stop else size

    def _break(self, name: str, node: int) -> None:
        if name in BLOCKS:
            self.pieces.append((node, None))
        elif name == "br":
            self.pieces.append((node, " "))

    def _start(self, stack: list[int], name: str, attributes: str) -> None:
        if name in BLOCKS and name not in ("html", "head"):
            self._close(stack, ("p",), CONTAINERS)
        if name in CLOSES:
            self._close(stack, CLOSES[name], CONTAINERS)
        if name == "body":
            self._close(stack, ("head",), frozenset())
        up = stack[-1]
        node = len(self.name)
        self.name.append(name)
        self.parent.append(up)
        self.article.append(self.article[up] or name in ("article", "main"))
        self.link.append(self.link[up] or name == "a")
        self.mark.append(_marked(name, attributes, self.article[up]))
        self._break(name, node)
        if name not in VOID:
            stack.append(node)

    def _close(self, stack: list[int], names: tuple[str, ...], until: frozenset) -> None:
        """End the highest open element of the names above the next container, and all in it."""
        last = None
        for k in range(len(stack) - 1, 0, -1):
            if self.name[stack[k]] in names:
                last = k
            elif self.name[stack[k]] in until:
                break
        if last is not None:
            self._break("p", stack[last])
            del stack[last:]

    def _end(self, stack: list[int], name: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if self.name[stack[k]] == name:
                self._break(name, stack[k])
                del stack[k:]
                return
            if name not in BLOCKS and self.name[stack[k]] in CONTAINERS:
                return  # an inline end does not close a container

    def _under(self, least: int) -> list[bool]:
        """Whether each node is, or is within, one of that mark or more."""
        out = [self.mark[0] >= least]
        for k in range(1, len(self.name)):
            out.append(out[self.parent[k]] or self.mark[k] >= least)
        return out

    def text(self) -> str:
        own, gone = [0] * len(self.name), self._under(ELEMENT)
        for node, piece in self.pieces:
            if piece and not gone[node] and not self.link[node]:
                own[node] += len(piece) - piece.count(" ") - piece.count("\n")
        held = list(own)
        for k in range(len(own) - 1, 0, -1):
            held[self.parent[k]] += held[k]
        while True:
            self.dropped = self._under(NAMED)
            text = self._text()
            # Nodes with most of the page are within each other, the outermost first.
            most = [k for k in range(len(own)) if self.mark[k] == NAMED and not gone[k] and 2 * held[k] > held[0]]
            if not most or not self._wraps(most[0], own, held, text):
                return text
            for k in most:
                if held[k] == held[most[0]]:
                    self.mark[k] = 0

    def _wraps(self, node: int, own: list[int], held: list[int], text: str) -> bool:
        """Whether a named node has the article: what is left without it is short, without long pieces, article or main."""
        if 4 * sum(map(len, text.split())) >= held[node]:
            return False
        inside = [False] * len(own)
        for k in range(node, len(own)):
            inside[k] = k == node or inside[self.parent[k]]
        rest = [k for k in range(len(own)) if not self.dropped[k]]
        return (2 * max((own[k] for k in rest), default=0) < max(x for k, x in enumerate(own) if inside[k])
                and not any(held[k] and self.name[k] in ("article", "main") for k in rest))

    def _text(self) -> str:
        n = len(self.name)
        chars, links, tags, link_tags = [0] * n, [0] * n, [1] * n, [0] * n
        for node, piece in self.pieces:
            if piece and not self.dropped[node]:
                count = len(piece) - piece.count(" ") - piece.count("\n")
                chars[node] += count
                links[node] += count * self.link[node]
        # Inline formatting is part of its block: no tag, no node of its own.
        blocks = [k == 0 or self.name[k] in BLOCKS or self.name[k] in ("html", "body") for k in range(n)]
        home = [0] * n  # the nearest block around a node
        for k in range(1, n):
            up = self.parent[k]
            home[k] = up if blocks[up] else home[up]
            link_tags[k] = int(self.name[k] == "a")
            tags[k] = int(blocks[k] or self.name[k] == "a")
        for k in range(n - 1, 0, -1):
            if not self.dropped[k]:
                up = self.parent[k]
                for values in (chars, links, tags, link_tags):
                    values[up] += values[k]
        body = next((k for k in range(n) if self.name[k] == "body"), 0)
        if not chars[body]:
            body = 0
        ratio = links[body] / max(1, chars[body])
        density = [_density(chars[k], links[k], tags[k], link_tags[k], ratio) for k in range(n)]
        total = [0.0] * n
        for k in range(n - 1, 0, -1):
            if not self.dropped[k] and blocks[k]:
                total[home[k]] += density[k]
        within = [False] * n
        for k in range(n):
            within[k] = k == body or (k > 0 and within[self.parent[k]])
        if not chars[body]:
            return ""
        core = max((k for k in range(n) if within[k] and blocks[k] and not self.dropped[k]), key=lambda k: (total[k], chars[k], -k))
        path = [core]
        while path[-1] != body:
            path.append(home[path[-1]])
        threshold = min(density[k] for k in path)
        # The widest node on the way to the body that joins the core with a neighbour about as dense.
        children: dict[int, list[int]] = {up: [] for up in path[1:-1]}
        for k in range(1, n):
            if blocks[k] and home[k] in children and not self.dropped[k] and chars[k]:
                children[home[k]].append(k)
        chosen = core
        for below, up in pairwise(path[:-1]):
            if any(k != below and density[k] >= MARGIN * threshold for k in children[up]):
                chosen = up
        keep = [False] * n
        for k in range(n):
            inside = k == chosen or k > 0 and keep[self.parent[k]]
            listing = k != chosen and 2 * links[k] > chars[k] and density[k] < threshold and self.name[k] in BLOCKS
            keep[k] = inside and not self.dropped[k] and not listing
        return "\n\n".join(self._blocks(keep))

    def _blocks(self, keep: list[bool]) -> Iterator[str]:
        parts: list[str] = []
        for node, piece in self.pieces:
            if piece is None:
                if block := " ".join("".join(parts).split()):
                    yield block
                parts = []
            elif keep[node]:
                parts.append(html.unescape(piece))
        if block := " ".join("".join(parts).split()):
            yield block


def _density(chars: int, links: int, tags: int, link_tags: int, ratio: float) -> float:
    """Composite density: characters per tag, scaled by how little of the node is links."""
    if not chars:
        return 0.0
    plain = max(1, chars - links)
    base = math.log(chars / plain * links + ratio * chars + math.e)  # 1 or more
    gain = math.log(chars / max(1, links) * max(1, tags) / max(1, link_tags) + 1.0)
    return chars / max(1, tags) * gain / math.log(base + 1.0)


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each page: blocks joined by two line ends.

    Character references are decoded, white space within a block becomes one space. A
    null, empty or textless page has an empty text; nothing is cut or capped. Repeated
    rows and null ids are answered like any other; other columns are ignored.
    """

    def task(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html")).mapInArrow(
        task, "page_id long, url string, text string, n_chars long")
