"""The main text of web pages, by composite text density of the nodes of the page's tree.

The density of a node is its characters by tag, lowered the more of them are in links. Content lies under the node whose
children's densities sum to most; the least density between it and the body is the threshold that other parts must reach.
Blocks of text right beside that node or one that holds it (``TEXT``) are kept whatever their length, unless most is in links.
Parts that are never an article (see the fixed values) are left out first: by element, by role, as hidden, or by a class or id
that is one of ``MARKS`` or begins with one. A class or id never takes out the page's article; see ``Page._drop_marked``.
Inline markup makes no nodes.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from railbird.llm.text import annotate, texts

# Elements by what they are on a page.
RAW = "script style noscript template textarea title iframe svg math object select".split()
OUTSIDE = "nav footer aside form button dialog menu label fieldset head".split()
INLINE = (
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q ruby rb rp rt s samp small span strike strong "
    "sub sup time tt u var wbr"
).split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
CLOSES_PARAGRAPH = (
    "address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre section summary table ul"
).split()
# blocks that hold the text of an article and not its layout
TEXT = "p blockquote pre h1 h2 h3 h4 h5 h6 ul ol dl table figure".split()
# an open element of the key's kind is ended by the next of these
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th", "tr"), "th": ("td", "th", "tr")}
CLOSED_BY |= {"option": ("option",)}
MARKS = (
    "ad ads advert adverts advertisement advertising adslot adbox banner breadcrumb breadcrumbs comment comments commentlist consent "
    "cookie cookies copyright disclaimer disqus footer gdpr legal menu modal nav navbar navigation newsletter notice notices popup "
    "promo promoted promotion recommended related reply replies respond share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription teaser toolbar widget"
).split()
ROLES = "navigation banner contentinfo complementary search form alert dialog".split()

_RAW, _OUTSIDE, _INLINE, _VOID = map(frozenset, (RAW, OUTSIDE, INLINE, VOID))
_ENDS_P, _MARKS, _ROLES, _TEXT = map(frozenset, (CLOSES_PARAGRAPH, MARKS, ROLES, TEXT))
_KEPT = frozenset(("html", "body", "article", "main"))
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>"""
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*|[^>]*)>""",
    re.S,
)
_COMMENT = re.compile(r"<!--.*", re.S)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_LEADING = re.compile(r"[a-z0-9]+")
ASIDE, MARKED = 1, 2


def _aside(tag: str, attrs: str, in_article: bool) -> int:
    """``ASIDE`` for an element that is no part of an article by its name, role or style, ``MARKED`` for one by class or id."""
    if tag in _OUTSIDE or tag == "header" and not in_article:
        return ASIDE
    if not attrs.strip() or tag in _KEPT:
        return 0
    marked = 0
    for name, value in _NAMED.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return ASIDE
        if name == "style" and "display:none" in value.replace(" ", ""):
            return ASIDE
        if name == "role" and value in _ROLES:
            return ASIDE
        if name in ("class", "id") and any((m := _LEADING.match(x)) and m[0] in _MARKS for x in value.split()):
            marked = MARKED
    return marked


class Page:
    """The block elements of a page in order, each with its parent, and the pieces of text with their element."""

    def __init__(self, source: str):
        self.tags, self.parents, self.dropped = ["html"], [0], [False]
        self.marked = [False]  # by class or id, which do not drop an element yet
        self.links = [0]  # links in the element itself, not below
        self.pieces: list[tuple[int, str, bool]] = []  # element, text, whether in a link
        self.open: list[tuple[str, int]] = [("html", 0)]  # all open elements, inline ones with the block they are in
        self.places: dict[str, list[int]] = defaultdict(list)  # of each tag, where in the list above; that of html is left out
        self.blocks: list[int] = []  # the places of those that are not inline
        self.anchors = 0
        self._read(source)
        self._drop_marked()

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        last = source.rfind(">")
        while at < n:
            # where no tag can end any more, only a comment is markup
            token = (_TOKEN if at <= last else _COMMENT).search(source, at)
            stop = token.start() if token else n
            if stop > at:
                self._text(source[at:stop])
            if not token:
                break
            at = token.end()
            tag = token["tag"] if token.re is _TOKEN else None
            if not tag:
                continue
            tag = tag.lower()
            if token["end"]:
                self._close(tag)
            elif tag in _RAW and not token["attrs"].endswith("/"):
                # what is inside is no markup
                end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                at = end.end() if end else n
                self._gap()
            else:
                self._open(tag, token["attrs"])

    def _block(self) -> int:
        return self.open[-1][1]

    def _gap(self) -> None:
        self.pieces.append((self._block(), " ", False))

    def _text(self, raw: str) -> None:
        self.pieces.append((self._block(), entities.unescape(raw) if "&" in raw else raw, self.anchors > 0))

    def _open(self, tag: str, attrs: str) -> None:
        if tag in _ENDS_P:
            self._end_open("p", ("td", "th", "table", "button", "caption"))
        for kind, closers in CLOSED_BY.items():
            if tag in closers:
                self._end_open(kind, ("ul", "ol", "dl", "table", "select"))
        if tag in ("body", "html"):
            return
        if tag in _VOID:
            if tag in ("br", "hr"):
                self._gap()
            return
        block, in_article = self._block(), bool(self.places["article"] or self.places["main"])
        aside = _aside(tag, attrs, in_article)
        if tag in _INLINE and not aside:
            if tag == "a":
                self.anchors += 1
                self.links[block] += 1
            self._push(tag, block)
            return
        if tag not in _INLINE:
            self._gap()
        self.tags.append(tag)
        self.parents.append(block)
        self.dropped.append(aside == ASIDE or self.dropped[block])
        self.marked.append(aside == MARKED)
        self.links.append(0)
        self._push(tag, len(self.tags) - 1)

    def _push(self, tag: str, block: int) -> None:
        self.places[tag].append(len(self.open))
        if tag not in _INLINE:
            self.blocks.append(len(self.open))
        self.open.append((tag, block))

    def _place(self, tag: str) -> int:
        """Where the innermost open element of a tag is, 0 if there is none."""
        places = self.places.get(tag)
        return places[-1] if places else 0

    def _end_open(self, tag: str, scope: tuple[str, ...]) -> None:
        place = self._place(tag)
        if place and all(place > self._place(kind) for kind in scope):
            self._cut(place)

    def _close(self, tag: str) -> None:
        place = self._place(tag)
        # an inline end does not close blocks
        if place and not (tag in _INLINE and self.blocks and self.blocks[-1] > place):
            self._cut(place)

    def _cut(self, place: int) -> None:
        gap = bool(self.blocks) and self.blocks[-1] >= place
        anchors = 0
        while len(self.open) > place:
            tag, _ = self.open.pop()
            self.places[tag].pop()
            anchors += tag == "a"
        while self.blocks and self.blocks[-1] >= place:
            self.blocks.pop()
        self.anchors = max(0, self.anchors - anchors)
        if gap:
            self._gap()

    def _drop_marked(self) -> None:
        """Drop the marked elements with all below them, but for those that hold the page's article.

        These are the ones with an article or main in them where there is none outside marked elements, and the ones with
        more than half of the page's text; the latter not beside an article or main that is in no marked element.
        """
        if True not in self.marked:
            return
        n = len(self.tags)
        chars, holds, within, under = [0] * n, [False] * n, [False] * n, [False] * n
        for node, piece, _ in self.pieces:
            chars[node] += sum(map(len, piece.split()))
        for i in range(1, n):
            up = self.parents[i]
            within[i] = within[up] or self.tags[up] in ("article", "main")
            under[i] = under[up] or self.marked[i]
        for i in range(n - 1, 0, -1):
            if not self.dropped[i]:
                chars[self.parents[i]] += chars[i]
                holds[self.parents[i]] |= holds[i] or bool(chars[i]) and self.tags[i] in ("article", "main")
        said = any(
            t in ("article", "main") and chars[i] and not under[i] and not self.dropped[i] for i, t in enumerate(self.tags)
        )
        for i in range(1, n):
            if self.marked[i] and not self.dropped[i]:
                most = 2 * chars[i] > chars[0] and (not said or within[i] or holds[i])
                self.dropped[i] = not (most or holds[i] and not said)
            self.dropped[i] = self.dropped[i] or self.dropped[self.parents[i]]

    def main_text(self) -> str:
        n = len(self.tags)
        chars, linked, tags, links, last = [0] * n, [0] * n, [0] * n, list(self.links), list(range(n))
        for node, piece, in_link in self.pieces:
            size = sum(map(len, piece.split()))
            chars[node] += size
            if in_link:
                linked[node] += size
        for i in range(n - 1, 0, -1):
            up = self.parents[i]
            last[up] = max(last[up], last[i])
            if not self.dropped[i]:
                chars[up] += chars[i]
                linked[up] += linked[i]
                tags[up] += tags[i] + 1
                links[up] += links[i]
        shown = [i for i in range(n) if not self.dropped[i]]
        density = dict.fromkeys(shown, 0.0)
        for i in shown:
            density[i] = composite(chars[i], linked[i], tags[i] + links[i], links[i], chars[0], linked[0])
        sums = dict.fromkeys(shown, 0.0)
        for i in shown[1:]:
            sums[self.parents[i]] += density[i]
        content = self._content(shown, density, sums, last, chars, linked)
        kept = [piece for node, piece, _ in self.pieces if not self.dropped[node] and content[node]]
        return " ".join("".join(kept).split())

    def _content(
        self, shown: list[int], density: dict, sums: dict, last: list[int], chars: list[int], linked: list[int]
    ) -> list[bool]:
        best = max(shown, key=lambda i: (sums[i], density[i], chars[i], i))
        path, i = [best], best
        while i:
            i = self.parents[i]
            path.append(i)
        threshold = min(density[i] for i in path)
        # where the page says what its article is, that is all of it, else the node and what is as dense elsewhere
        named = [i for i in path if self.tags[i] == "article"] or [i for i in path if self.tags[i] == "main"]
        roots = [named[-1]] if named else [best]
        if not named:
            above, on_path = set(path[1:]), set(path)
            parts = [density[i] for i in shown[1:] if self.parents[i] == best and chars[i]]
            # a block without others is as dense as the content if it is as dense as the content's own are on average
            usual = min(threshold, sums[best] / max(1, len(parts)))
            holders = {self.parents[i] for i in shown[1:]}
            for i in shown[1:]:
                if i in on_path or not chars[i]:
                    continue
                beside = self.parents[i] in above
                text = beside and self.tags[i] in _TEXT and 2 * linked[i] <= chars[i]
                if text or density[i] >= (usual if beside and i not in holders else threshold):
                    roots.append(i)
            # titles before the content, which are too short to be dense
            roots += [i for i in shown if self.tags[i] == "h1" and i < best]
        if not sums[best]:  # no blocks at all
            return [True] * len(self.tags)
        edges = [0] * (len(self.tags) + 1)
        for root in roots:
            edges[root] += 1
            edges[last[root] + 1] -= 1
        return [depth > 0 for depth in accumulate(edges[:-1])]


def composite(chars: int, linked: int, tags: int, links: int, all_chars: int, all_linked: int) -> float:
    """Characters by tag, times a logarithm that falls as links take up more of the characters and of the tags."""
    if not chars:
        return 0.0
    plain = max(1, chars - linked)
    base = math.log(chars / plain * linked + all_linked / max(1, all_chars) * chars + math.e)
    value = chars / max(1, linked) * max(1, tags) / max(1, links)
    # a base of e at least: it is 1 on a page without links
    return chars / max(1, tags) * math.log(max(1.0, value)) / max(1.0, math.log(base))


def main_text(source: str) -> str:
    return Page(source).main_text()


def main_texts(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add ``text``, the main text of each page (empty if there is none), and ``n_chars``, its code points.

    Blocks are joined in the order of the page by one space, white space within a block becomes one space, and character
    references are decoded. A null is an empty page; equal pages give equal texts; added columns replace others so named.
    """

    def work(batch: pa.RecordBatch) -> list:
        found = [main_text(x.decode("utf-8", "replace")) for x in texts(batch.column(html))]
        return [pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())]

    return annotate(pages, "text string, n_chars long", work)
