"""Main text of web pages by text-to-tag ratios (after CETR).

The standard library's parser streams its events into lines, one for each
block of text, with the tags seen on it.  A line's ratio of text to tags, on a
log scale, is smoothed with a Gaussian along the page, and clusters of lines
above a threshold mark the content region.  The region is the innermost element
around all of them, so that short lines of the article stay; where they share
none, an article element decides, and else the stretch from the first to the
last.  Parts of a region that are mostly tagged words, such as lists of links,
and have low smoothed ratios are dropped.  Lines inside menus, headers, footers, adverts, comments and the like
count nothing and are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.store import read_table

#: HTML elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template iframe object svg math head title canvas audio video select option datalist textarea".split())
BOILERPLATE = frozenset("nav header footer aside form menu button dialog fieldset".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: Words of a class, id or role that mark what isn't the article; of those, the words that may also stand on what holds it or heads it.
MARKS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer footer header menu modal nav navbar navigation newsletter notice notices popup promo promoted related replies share sharing sidebar skip social sponsor sponsored subscribe toolbar widget widgets complementary contentinfo search".split())
WEAK = frozenset("banner header modal notice notices promo related search share sharing social toolbar widget widgets".split())
HEADS = frozenset({"header", "banner"})
OWN = frozenset("article content entry headline post story title".split())
UNLESS_AFTER = frozenset("has no with without".split())
#: Elements that hold an article, and those that show where it is.
HOLDERS = frozenset({"article", "main"})
LANDMARKS = HOLDERS | {"h1"}
#: Elements that are one block of text, or part of a list or table.
PIECES = frozenset("p li h1 h2 h3 h4 h5 h6 blockquote ul ol dl dt dd pre td th tr table tbody thead tfoot figure figcaption".split())

#: Tags on a line from which on its words are tagged themselves: a block's own begin and end are two.
LINKED = 3

_NAME = re.compile(r"[A-Za-z0-9]+")
_WHITE = re.compile(r"\s+")
_NOT, _BY_TAG, _STRONG, _WEAK = range(4)


class _Lines(HTMLParser):
    """Turns parser events into lines (text, tags, element), and a tree of elements by their numbers."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # element 0 is around the whole page
        self.tag, self.parent, self.mark, self.unseen, self.held = [""], [-1], [_NOT], [False], [False]
        self.stack, self.open = [0], Counter()
        self.lines: list[tuple[str, int, int]] = []
        self.parts: list[str] = []
        self.tags = 0

    def _flush(self) -> None:
        text = _WHITE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.lines.append((text, self.tags, self.stack[-1]))
            self.tags = 0
        self.parts = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in BLOCKS:
            self._flush()
            if tag in CLOSES_P:
                self._close("p", CLOSES_P - {"p"})
            for also, within in _CLOSED_BY.get(tag, ()):
                self._close(also, within)
        if tag in VOID or tag not in BLOCKS and tag not in UNSEEN and tag not in BOILERPLATE:
            return
        if tag in BOILERPLATE:
            self._flush()  # what stands before it isn't part of it
        above = self.stack[-1]
        self.tag.append(tag)
        self.parent.append(above)
        self.held.append(self.held[above] or tag in HOLDERS)
        self.unseen.append(self.unseen[above] or tag in UNSEEN)
        self.mark.append(_mark(tag, attrs, self.held[above]))
        self.stack.append(len(self.tag) - 1)
        self.open[tag] += 1

    def _pop_to(self, k: int) -> None:
        for node in self.stack[k:]:
            self.open[self.tag[node]] -= 1
        del self.stack[k:]

    def _close(self, tag: str, within: frozenset[str]) -> None:
        """Ends the innermost open `tag`, unless one of `within` stands between."""
        if not self.open[tag]:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            name = self.tag[self.stack[k]]
            if name == tag:
                self._flush()
                self._pop_to(k)
                return
            if name in within or name in UNSEEN:
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS or tag in BOILERPLATE:
            self._flush()
        if self.open[tag]:
            k = len(self.stack) - 1
            while self.tag[self.stack[k]] != tag:
                k -= 1
            self._pop_to(k)

    def parse_starttag(self, i: int) -> int:
        """A tag that nothing closes takes the rest of the page, which a browser drops."""
        return len(self.rawdata) if self.rawdata.find(">", i) < 0 else super().parse_starttag(i)

    def parse_html_declaration(self, i: int) -> int:
        """So does a declaration."""
        return len(self.rawdata) if self.rawdata.find(">", i) < 0 else super().parse_html_declaration(i)

    def parse_comment(self, i: int, report: bool = True) -> int:
        """And so does a comment."""
        end = super().parse_comment(i, report)
        return len(self.rawdata) if end < 0 else end

    def handle_data(self, data: str) -> None:
        if not self.unseen[self.stack[-1]]:
            self.parts.append(data)

    def read(self, html: str) -> None:
        self.feed(html)
        self.close()
        self._flush()


_LIST, _CELLS, _TABLE, _DL = (frozenset(x.split()) for x in ("ul ol menu", "tr table", "table", "dl"))
_CLOSED_BY = {"li": [("li", _LIST)], "td": [("td", _CELLS), ("th", _CELLS)], "th": [("td", _CELLS), ("th", _CELLS)], "tr": [("tr", _TABLE)], "dt": [("dt", _DL), ("dd", _DL)], "dd": [("dt", _DL), ("dd", _DL)]}


def _mark(tag: str, attrs: list[tuple[str, str | None]], held: bool) -> int:
    """What marks an element as no part of the article; held: it is inside an article or main element."""
    if tag in ("html", "body"):
        return _NOT
    if tag in BOILERPLATE and not (tag == "header" and held):  # a header of the article itself is part of it
        return _BY_TAG
    mark = _NOT
    for key, value in attrs:
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return _STRONG
        if key not in ("class", "id", "role") or not value:
            continue
        for name in value.lower().split():
            words = _NAME.findall(name)
            if tag in HOLDERS and name not in MARKS and words[:1] != ["comment"] and words[-2:-1] != ["comment"]:
                continue  # themes put many words on an article
            for k, word in enumerate(words):
                if word not in MARKS or k and words[k - 1] in UNLESS_AFTER or word in HEADS and (held or not OWN.isdisjoint(words)):
                    continue
                if word not in WEAK:
                    return _STRONG
                mark = _WEAK
    return mark


def _under(parent: list[int], own: list[bool]) -> list[bool]:
    """For each element, whether it or one around it has `own`."""
    out = own[:1]
    for k in range(1, len(own)):
        out.append(own[k] or out[parent[k]])
    return out


def _boilerplate(page: _Lines) -> list[bool]:
    """For each element, whether its text is left out.

    A class on an element that holds all the page's landmarks, or all its
    paragraphs, is the page's own name for the article; so is a form around it.
    """
    n = len(page.tag)
    lifted = [False] * n
    for names, liftable in ((LANDMARKS, (_STRONG, _WEAK)), (frozenset({"p"}), (_WEAK,))):
        out = _under(page.parent, [page.mark[k] != _NOT and not lifted[k] for k in range(n)])
        those = [k for k in range(n) if page.tag[k] in names and page.mark[k] == _NOT]
        if names is not LANDMARKS and any(not out[k] for _, _, k in page.lines):
            return out
        if any(not out[k] for k in those):
            continue
        stuck = _under(page.parent, [page.mark[k] not in (_NOT, *liftable) and page.tag[k] != "form" for k in range(n)])
        k = next((k for k in those if not stuck[page.parent[k]]), 0)
        while k > 0 and (k := page.parent[k]) > 0:
            lifted[k] = page.mark[k] != _NOT
    return _under(page.parent, [page.mark[k] != _NOT and not lifted[k] for k in range(n)])


def smoothed_ratios(size: np.ndarray, tags: np.ndarray, usable: np.ndarray, sigma: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """By line, the log of 1 + characters of text for each tag, alone and under a Gaussian; boilerplate lines count nothing."""
    ratio = np.where(usable, np.log1p(size / np.maximum(1, tags)), 0.0)
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(ratio, kernel)[reach : reach + len(ratio)]
    return ratio, total / np.convolve(np.ones(len(ratio)), kernel)[reach : reach + len(ratio)]


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The article's blocks joined by blank lines; empty if there is none."""
    if not html:
        return ""
    page = _Lines()
    page.read(html)
    lines, out = page.lines, _boilerplate(page)
    usable = np.array([not out[k] for _, _, k in lines], bool)
    if not usable.any():
        return ""
    ratio, smooth = smoothed_ratios(np.array([len(t) for t, _, _ in lines]), np.array([n for _, n, _ in lines]), usable, sigma)
    # the threshold is the spread of the ratios, as far as some line passes it
    threshold = min(float(np.std(smooth)), float(smooth[usable].max()))
    # a line beside boilerplate is smoothed towards nothing, so its own ratio counts too
    high = usable & (np.maximum(smooth, ratio) >= threshold)
    # short lines that only stand beside long ones don't tell where the text is
    core = usable & (ratio >= threshold)
    return "\n\n".join(lines[k][0] for k in np.flatnonzero(usable & _region(page, high, core if core.any() else high, smooth)).tolist())


def _region(page: _Lines, high: np.ndarray, core: np.ndarray, smooth: np.ndarray) -> np.ndarray:
    """Which lines lie in the content region of the high ones, of which the core ones choose the element."""
    at = [k for _, _, k in page.lines]
    root = _innermost_around(page, [k for k, top in zip(at, core, strict=True) if top])
    if root is not None:
        inside = _under(page.parent, [k == root for k in range(len(page.tag))])
        return np.array([inside[k] for k in at]) & ~_poor(page, root, core, smooth)
    # the high lines share no element: those in articles decide, with what articles stand beside them
    holder = [-1]  # the outermost article around each element
    for k in range(1, len(page.tag)):
        holder.append(holder[page.parent[k]] if holder[page.parent[k]] >= 0 else k if page.tag[k] in HOLDERS else -1)
    held = np.array([holder[k] for k in at])
    strong = {page.parent[h] for h in held[high & (held >= 0)].tolist()}
    if strong:
        return np.array([h >= 0 and page.parent[h] in strong for h in held.tolist()])
    first, last = np.flatnonzero(high)[[0, -1]]
    return (np.arange(len(at)) >= first) & (np.arange(len(at)) <= last)


def _poor(page: _Lines, root: int, core: np.ndarray, smooth: np.ndarray) -> np.ndarray:
    """Which lines lie in a part of the region that is mostly tagged words, such as links, and has less than half the smoothed ratio of the core lines.

    A part is what stands directly below the region's element; an article
    element is taken as it is, as its author marked what belongs to it.
    """
    if page.tag[root] == "article":
        return np.zeros(len(page.lines), bool)
    part = [0] * len(page.tag)
    for k in range(1, len(part)):
        part[k] = k if page.parent[k] == root else part[page.parent[k]]
    of = np.array([part[k] for _, _, k in page.lines])
    tagged = of[np.array([n for _, n, _ in page.lines]) >= LINKED]
    n_lines = np.bincount(of, minlength=len(part))
    poor = (np.bincount(tagged, minlength=len(part)) * 2 > n_lines) & (np.bincount(of, smooth, len(part)) < n_lines * smooth[core].mean() / 2)
    return (poor & (n_lines > 2))[of] & (of > 0)


def _innermost_around(page: _Lines, nodes: list[int]) -> int | None:
    """The innermost element around all nodes that is more than a block of text, widened to the article it is in; None if that is the whole page."""
    below = [0] * len(page.tag)
    for k in nodes:
        below[k] += 1
    for k in range(len(below) - 1, 0, -1):
        below[page.parent[k]] += below[k]
    root = max(k for k, n in enumerate(below) if n == len(nodes))
    while page.tag[root] in PIECES:
        root = page.parent[root]
    k = root
    while k > 0 and page.tag[k] not in HOLDERS:
        k = page.parent[k]
    root = k or root
    heads = [k for _, _, k in page.lines if page.tag[k] == "h1" and page.mark[k] == _NOT]
    if k == 0 and root > 0 and len(heads) == 1:  # the heading may stand beside the text
        wider = _innermost_shared(page, root, heads[0])
        root = root if page.tag[wider] in ("", "html", "body") else wider
    return None if page.tag[root] in ("", "html", "body") else root


def _innermost_shared(page: _Lines, a: int, b: int) -> int:
    above = {a}
    while a > 0:
        above.add(a := page.parent[a])
    while b not in above:
        b = page.parent[b]
    return b


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            some = batch.slice(at, 256)
            texts = [main_text(h) for h in some.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (page_id, url, text, n_chars), one for each row of pages.

    White space inside a block is one space, blocks are trimmed, empty ones
    dropped and the rest joined by blank lines in page order.  Null, empty and
    contentless pages give an empty text; null and repeated ids come through;
    other columns are not read.  One pass, no shuffle.
    """
    return pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html")).mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op2_text_tag_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all `pages`."""
    return extract_main_text(read_table(spark, sf_dir, "pages"))
