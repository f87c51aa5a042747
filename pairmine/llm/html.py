"""Operator 4: the main text of a web page by tag-path ratios.

A page is cut into text nodes, each under its path of open elements from the root to the leaf. Per path, the length of
the text, its punctuation and its link text are added up over the nodes; the ratios of text and of punctuation to nodes
are smoothed over neighbouring paths of the page, fused by their product (less by the share of link text), and
paths above a threshold of the page are content. The element that holds nearly all the content, or the article
around it, is the article; its blocks in page order are the text. Without an article or main element, blocks of content outside it
are text too, with the headings before them and what stands between them, but for links. Elements that are known to be
something else (menus, footers, forms, adverts, comments, …) are left out by tag, role, class or id; a class or id does not
leave out an element that holds most of the page's text, unless it is of comments and there is other text.

Pages do not depend on each other, so a page is read where it is stored: one pass and no shuffle.

Defined results: a null or empty html gives an empty text; markup that is never closed is closed by what follows; a
page of any length is read whole, in time that grows with its length however it is nested; a quote without an end is a character
of its tag, and a tag without an end is text; a page without a path above the threshold uses its whole body; rows that
repeat others get equal texts; an empty table gives an empty table. Other columns of the input are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmine.llm.common import whole

#: A path is content if its fused ratio is at least this share of the page's largest.
THRESHOLD = 0.1
#: The article holds this share of the content's text.
HELD = 0.9

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_PLAIN = re.compile(r"[^>\"']*")
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=/\"']+)")
#: Elements of HTML by what they do.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
_BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split()
)
_OUT = frozenset(
    """head nav footer aside form script style textarea title noscript template iframe button select option menu svg canvas object
    embed applet audio video map dialog input label fieldset legend xmp noembed noframes""".split()
)
_CLOSES_P = _BLOCK - {"html", "body"}
_CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]),
}
_SCOPE = frozenset("ul ol dl table article section main div body td th blockquote".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_HINTS = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|topbar|footer|foot|header"
    r"|masthead|comments?|disqus|replies|respond|cookies?|consent|gdpr|notice|alert|popup|modal|newsletter|subscribe|subscription"
    r"|share|sharing|social|related|recommend\w*|recirc\w*|widget|toolbar|pagination|pager|login|signup|search|tags|legal|copyright|disclaimer)"
    r"(?:$|[-_\s]|\d)",
    re.IGNORECASE,
)
_TALK = re.compile(r"(?:^|[-_\s])(?:comments?|disqus|replies|respond)(?:$|[-_\s]|\d)", re.IGNORECASE)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PUNCTUATION = re.compile(r"[.,;:!?。，、；：！？…]")
_ARTICLES = frozenset(["article", "main"])


#: What an end of these is looked for in, when an element of the set begins: the sets of _CLOSED_BY, and paragraphs.
_SETS = (*dict.fromkeys(_CLOSED_BY.values()), frozenset(["p"]))
_SET_OF = {tag: _SETS.index(closed) for tag, closed in _CLOSED_BY.items()}
_MARKED = _SCOPE.union(*_SETS)


class _Element:
    """An open element. What depends on its ancestors is taken from its parent, so that no text node climbs them."""

    __slots__ = ("tag", "parent", "number", "out", "link", "path", "depth", "article", "heading", "hint", "hinted", "hard", "held", "weight", "marks", "near")

    def __init__(self, tag: str, parent: _Element | None, page: _Page, marks: str = "", hidden: bool = False) -> None:
        self.tag, self.parent, self.marks = tag, parent, marks
        above = parent
        self.number = len(page.elements)
        page.elements.append(self)
        self.article = tag in _ARTICLES or (above is not None and above.article)
        named = tag == "header" and not (above is not None and above.article)
        self.hint = tag not in ("html", "body", "article", "main") and _HINTS.search(marks) is not None
        self.hinted = self.hint or (above is not None and above.hinted)
        self.hard = (above is not None and above.hard) or tag in _OUT or named or hidden
        self.out = False  # told when the whole page is read
        self.heading = tag in _HEADINGS or (above is not None and above.heading)
        self.held, self.weight = 0, -1.0
        self.link = tag == "a" or (above is not None and above.link)
        # equal paths from the root have equal numbers
        self.path = page.paths.setdefault((above.path if above else -1, tag, marks), len(page.paths))
        self.depth = above.depth + 1 if above else 0
        # for each of _SETS the innermost open element of the set that no scope lies around
        if above is None:
            self.near: tuple[_Element | None, ...] = (None,) * len(_SETS)
        elif tag in _MARKED:
            self.near = tuple(
                self if tag in one else None if tag in _SCOPE else near for one, near in zip(_SETS, above.near, strict=True)
            )
        else:
            self.near = above.near


class _Page:
    """The elements of a page, parents before children; the open ones; the numbers of its paths."""

    def __init__(self) -> None:
        self.elements: list[_Element] = []
        self.paths: dict[tuple[int, str, str], int] = {}
        self.open = [_Element("", None, self)]
        self.count: dict[str, int] = {}
        self.nodes: list[tuple[_Element, int, str]] = []

    def push(self, tag: str, marks: str, hidden: bool) -> None:
        self.open.append(_Element(tag, self.open[-1], self, marks, hidden))
        self.count[tag] = self.count.get(tag, 0) + 1

    def pop_to(self, element: _Element | None = None, tag: str = "") -> None:
        """Close elements up to ``element``, or up to one of ``tag``, which is open."""
        while True:
            gone = self.open.pop()
            self.count[gone.tag] -= 1
            if gone is element or (element is None and gone.tag == tag):
                return


class _Tags:
    """The tags of a page from left to right, in time that grows with the page even if tags and quotes are never closed."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.last = page.rfind(">")
        self.none = {"'": len(page), '"': len(page)}  # from here on there is no such quote
        self.failed: list[tuple[int, list[int], list[int]]] = []  # scans that met no end, and where quotes began and ended in them

    def _ends(self, at: int) -> int:
        """The place of the ``>`` that ends what begins at ``at``, outside quotes; -1 for none. A quote without an end is a character."""
        for start, opened, closed in self.failed:
            k = bisect_right(opened, at) - 1
            if at >= start and (k < 0 or at >= closed[k]):
                return -1  # the same scan as one that has failed
        pos, opened, closed = at, [], []
        while True:
            pos = _PLAIN.match(self.page, pos).end()
            if pos >= len(self.page) or pos > self.last:
                self.failed.append((at, opened, closed))
                return -1
            mark = self.page[pos]
            if mark == ">":
                return pos
            end = self.page.find(mark, pos + 1) if pos + 1 < self.none[mark] else -1
            if end < 0:
                self.none[mark] = min(self.none[mark], pos + 1)
                pos += 1
            else:
                opened.append(pos + 1)
                closed.append(end + 1)
                pos = end + 1

    def next(self, at: int) -> tuple[int, int, str, str] | None:
        """(start, end, name with / if it closes, attributes) of the next tag, or comment (without a name)."""
        page = self.page
        while True:
            start = page.find("<", at)
            if start < 0:
                return None
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, "", ""
            if start > self.last:
                at = page.find("<!--", start)  # only a comment needs no end
                if at < 0:
                    return None
                continue
            if page.startswith("<![CDATA[", start) and not self.none.get("]]>"):
                end = page.find("]]>", start)
                if end >= 0:
                    return start, end + 3, "", ""
                self.none["]]>"] = 1
            if page.startswith(("<!", "<?"), start):
                return start, page.index(">", start) + 1, "", ""
            name = _NAME.match(page, start + 1)
            if name is not None and (end := self._ends(name.end())) >= 0:
                return start, end + 1, name.group(), page[name.end() : end]
            at = start + 1


def _attributes(raw: str) -> tuple[str, bool]:
    """Class, id and role of an element, and whether it is hidden."""
    found = {}
    for name, double, single, bare, alone in _ATTRIBUTE.findall(raw):
        found[(name or alone).lower()] = html.unescape(double or single or bare)
    hidden = "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower()
    role = found.get("role", "").lower()
    hidden = hidden or found.get("aria-hidden", "").lower() == "true" or role in _ROLES
    return " ".join(x for x in (found.get("class", ""), found.get("id", "")) if x), hidden


def read_page(page: str) -> _Page:
    """The elements of a page, and (innermost element, number of the block, decoded text) of every text node, in page order."""
    read, tags, block, at = _Page(), _Tags(page), 0, 0
    found = read.nodes
    while True:
        token = tags.next(at)
        text = page[at : token[0] if token else len(page)]
        if text:
            found.append((read.open[-1], block, html.unescape(text)))
        if token is None:
            _leave_out(read)
            return read
        _, at, name, rest = token
        closing, tag = name.startswith("/"), name.lstrip("/").lower()
        if not tag:
            continue
        if tag == "br":
            found.append((read.open[-1], block, " "))
            continue
        if tag in _BLOCK:
            block += 1
        if closing:
            if read.count.get(tag):
                read.pop_to(tag=tag)
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in _VOID:
            continue
        if tag in _CLOSES_P and (paragraph := read.open[-1].near[-1]) is not None:
            read.pop_to(paragraph)
        if tag in _SET_OF and (before := read.open[-1].near[_SET_OF[tag]]) is not None:
            read.pop_to(before)
        if not rest.rstrip().endswith("/") or tag in _BLOCK:
            read.push(tag, *_attributes(rest))


def _leave_out(page: _Page) -> None:
    """Tells of every element whether it is out."""
    total = free = 0
    for element, _, text in page.nodes:
        size = 0 if element.hard else len(text.strip())
        total += size
        element.held += size
        free += 0 if element.hinted else size
    for element in reversed(page.elements):
        if element.parent is not None:
            element.parent.held += element.held
    for one in page.elements:
        most = 2 * one.held > total and not (10 * free >= total and _TALK.search(one.marks))
        one.out = one.hard or (one.hint and not most) or (one.parent is not None and one.parent.out)


def path_scores(nodes: list[tuple[_Element, int, str]]) -> dict[int, float]:
    """The smoothed and fused ratio of every path that is not known to be something else."""
    sums: dict[int, list[float]] = {}
    for element, _, text in nodes:
        if element.out:
            continue
        size = len(text.strip())
        if size:
            own = sums.setdefault(element.path, [0.0, 0.0, 0.0, 0.0])
            own[0] += size
            own[1] += len(_PUNCTUATION.findall(text))
            own[2] += size if element.link else 0
            own[3] += 1
    if not sums:
        return {}
    size, marks, links, n = np.array(list(sums.values())).T
    kernel = np.array([0.1, 0.8, 0.1])
    smooth = [np.convolve(np.pad(x / n, 1, mode="edge"), kernel, mode="valid") for x in (size, marks)]
    fused = np.maximum(smooth[0], size / n) * (1.0 + np.maximum(smooth[1], marks / n)) * (1.0 - links / size)
    return dict(zip(sums, fused.tolist(), strict=True))


def main_text(page: str) -> str:
    """The article of a page: its blocks in page order, joined by one space."""
    read = read_page(page)
    scores = path_scores(read.nodes)
    if not scores:
        return ""
    least = THRESHOLD * max(scores.values())
    total = 0.0
    content: set[int] = set()
    for element, block, text in read.nodes:
        if element.out or scores.get(element.path, 0.0) < least or not least:
            continue
        size = len(text.strip())
        total += size
        if size:
            content.add(block)
        element.weight = max(element.weight, 0.0) + size
    for element in reversed(read.elements):  # -1 is the weight of an element without content
        if element.parent is not None and element.weight >= 0:
            element.parent.weight = max(element.parent.weight, 0.0) + element.weight
    holders = [e for e in read.elements if e.weight >= max(HELD * total, 0.0)]
    article = max(holders, key=lambda e: e.depth) if holders else None
    up = article
    while up is not None:  # the article or main element around it, or the block it is in
        if up.tag in _ARTICLES:
            article = up
        up = up.parent
    while article is not None and article.tag not in _SCOPE and article.parent is not None:
        article = article.parent
    around = article
    if article is not None and not article.article:
        around = max((e for e in read.elements if e.weight >= max(total, 0.0)), key=lambda e: e.depth)
        while around.tag not in _SCOPE and around.parent is not None:
            around = around.parent
    inside, beside = _inside(read, article), _inside(read, around)
    first, final = min(content, default=0), max(content, default=0)
    blocks: list[list[str]] = []
    last = None
    for element, block, text in read.nodes:
        if element.out or not beside[element.number]:
            continue
        between = first < block < final and not element.link
        if not (inside[element.number] or block in content or between or (element.heading and block < final)):
            continue
        if block != last:
            blocks.append([])
            last = block
        blocks[-1].append(text)
    return " ".join(t for t in (" ".join("".join(b).split()) for b in blocks) if t)


def _inside(page: _Page, article: _Element | None) -> list[bool]:
    """For every element whether it is ``article`` or lies in it; all do if there is none."""
    found: list[bool] = []
    for e in page.elements:
        found.append(article is None or e is article or (e.parent is not None and found[e.parent.number]))
    return found


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", whole("html").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
