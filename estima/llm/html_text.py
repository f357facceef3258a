"""Main text of web pages: markup is stripped to lines, and the line-block distribution finds where text stands."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# Elements by their meaning in HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
IN_HEAD = RAW | {"base", "link", "meta", "head"}
OUT = {
    "nav", "footer", "aside", "form", "button", "select", "option", "input", "label", "fieldset", "menu", "dialog",
    "svg", "math", "canvas", "audio", "video", "object", "embed", "head", "datalist", "search", "map",
}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dir", "div", "dl",
    "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup",
    "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td",
    "tfoot", "th", "thead", "tr", "ul",
}
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
LIST = {"ul", "ol", "dl", "table"}
# A start tag that closes an open element whose end tag may be left out, as far as the next boundary.
CLOSES_P = BLOCK - {"body", "html", "caption", "legend", "summary", "tbody", "td", "tfoot", "th", "thead", "tr"}
P_SCOPE = {"table", "td", "th", "caption", "button", "object"}
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
#: Beyond these an end tag closes nothing but what belongs to the table.
CELL = {"table", "td", "th", "caption"}
TABLE = {"table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"}
# Words of class, id and role names that mark what isn't the article.
NOISE = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs",
    "comment", "comments", "commentlist", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "gdpr",
    "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination",
    "popup", "promo", "promoted", "recommended", "related", "reply", "replies", "respond", "share", "sharing", "sidebar",
    "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "widget", "widgets", "search", "signup",
    "complementary", "alert", "overlay", "copyright", "skip", "topbar", "login", "disclaimer",
}
# After a word of NOISE these say no more than what part of a page it is ("comment-list").
PART = {
    "area", "articles", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "card", "cards", "column",
    "container", "content", "form", "group", "header", "heading", "holder", "icon", "icons", "inner", "item", "items",
    "left", "link", "links", "list", "menu", "message", "outer", "panel", "policy", "post", "posts", "primary", "right",
    "row", "secondary", "section", "slot", "stories", "text", "thread", "title", "top", "unit", "widget", "wrap", "wrapper",
}
# Names that begin with these say how a page is laid out, not what an element is ("no-sidebar").
STATE = {"no", "has", "with", "without", "is", "not", "layout", "hide", "show", "js", "page", "theme", "body"}
#: Beside "header" in a name, these say that it is the header of the article and no page header.
OWN_HEADER = {"article", "content", "entry", "post", "story"}

# Attributes by the rules of HTML: a quote opens a value only after =, elsewhere it is a character like others. One that
# is never closed opens none.
ATTRIBUTES = r"""(?>[\s/]+|=|[^\s/>=]+(?>\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]*))?)*+"""
TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({ATTRIBUTES})(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>]+)(?>\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")


def _names_noise(name: str) -> bool:
    """Whether one name of a class, id or role says that an element isn't the article: its only or last word does, or
    its first, followed by nothing but names of parts of a page."""
    words = [w.lower() for w in NAME.findall(name)]
    if not words or words[0] in STATE:
        return False
    if words[-1] == "header":
        return not OWN_HEADER & set(words)
    return words[-1] in NOISE or (words[0] in NOISE and PART.issuperset(words[1:]))


def _noise(tag: str, attributes: str) -> bool:
    """Whether an element is a menu, notice, advert, form or the like by its class, id or role, or hidden."""
    if not attributes or tag in ("body", "html"):
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value[1:-1] if value[:1] in "\"'" and value[-1:] == value[:1] else value
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return True
        if name in ("class", "id", "role") and any(map(_names_noise, value.split())):
            return True
    return False


class Line:
    """A block of text: its characters and how many of them stand in links, the element it is in, the nearest article or
    main element (0: none), and whether it is in a heading or in a list or table."""

    __slots__ = ("text", "linked", "element", "scope", "heading", "listed", "marks")

    def __init__(self, text: str, linked: int, element: int, scope: int, heading: bool, listed: bool, marks: tuple):
        self.text, self.linked, self.element, self.scope, self.heading, self.listed, self.marks = text, linked, element, scope, heading, listed, marks


class Page:
    """The blocks of text of a page, in page order, and its tree of block elements: the parent of each, and of each
    article or main element the tag and the scope that it stands in. One pass, in time linear in the page's length."""

    def __init__(self, page: str):
        self.lines: list[Line] = []
        self.parent, self.scopes = [0], {0: ("", 0)}
        #: Elements that a name marks, but which hold the page's main element or an article, and so aren't noise.
        self.wide: set[int] = set()
        self._parts: list[str] = []
        self._linked = 0
        #: Open elements: (tag, number of the innermost block element, its scope, whether it is skipped, marked).
        self._stack: list[tuple[str, int, int, bool, bool]] = []
        self._at: dict[str, list[int]] = {}
        self._marks: list[int] = []
        self._link = 0  # depth at which a link was opened, plus 1
        self._read(page)
        self._flush()
        by_name = [x for x in self.lines if self.wide.issuperset(x.marks)]
        self.lines = by_name or self.lines

    def _flush(self) -> None:
        if self._parts:
            text = SPACE.sub(" ", entities.unescape("".join(self._parts))).strip()
            if text:
                _, element, scope, _, _ = self._stack[-1] if self._stack else ("", 0, 0, False, False)
                heading, listed = (any(self._at.get(t) for t in tags) for tags in (HEADING, LIST))
                self.lines.append(Line(text, self._linked, element, scope, heading, listed, tuple(self._marks)))
            self._parts.clear()
        self._linked = 0

    def _last(self, tags) -> int:
        """The place of the innermost open element of these tags, -1 if there is none."""
        return max((own[-1] for t in tags if (own := self._at.get(t))), default=-1)

    def _pop_to(self, size: int) -> None:
        while len(self._stack) > size:
            tag, _, _, _, marked = self._stack.pop()
            self._at[tag].pop()
            if marked:
                self._marks.pop()
        if self._link > len(self._stack) + 1:
            self._link = 0

    def _text(self, raw: str) -> None:
        if self._at.get("head") and not raw.isspace():
            self._pop_to(self._last(["head"]))
        if not (self._stack and self._stack[-1][3]):
            self._parts.append(raw)
            if self._link:
                self._linked += len(raw.strip())

    def _open(self, tag: str, attributes: str) -> None:
        _, element, scope, skipped, _ = self._stack[-1] if self._stack else ("", 0, 0, False, False)
        marked = False
        if tag in BLOCK or tag in OUT:
            self.parent.append(element)
            element = len(self.parent) - 1
        if not skipped:
            own = tag in ("article", "main")
            named = _noise(tag, attributes)
            if own and not named:
                self.wide.update(self._marks)
            if (tag in OUT and tag != "form") or (tag == "header" and not self.scopes[scope][0]):
                skipped = True
            elif named or tag == "form":
                if tag not in BLOCK:  # an inline element has a number of its own only if it is marked
                    self.parent.append(element)
                    element = len(self.parent) - 1
                marked = True
                self._marks.append(element)
            if own:
                self.scopes[element] = (tag, scope)
                scope = element
        self._at.setdefault(tag, []).append(len(self._stack))
        self._stack.append((tag, element, scope, skipped, marked))
        if tag == "a":
            self._link = len(self._stack)

    def _read(self, page: str) -> None:
        at, size = 0, len(page)
        while at < size:
            found = TOKEN.search(page, at)
            if not found:
                self._text(page[at:])
                return
            if found.start() > at:
                self._text(page[at : found.start()])
            at, tag = found.end(), (found[2] or "").lower()
            if not tag:
                continue
            if tag in BLOCK:
                self._flush()
            if found[1]:
                place = self._last([tag])
                # An end tag of a block closes all within it, though not beyond its table cell; one of other elements
                # only what stands in the same block.
                bound = -1 if tag in TABLE else self._last(CELL if tag in BLOCK or tag in OUT else BLOCK)
                if place > bound:
                    self._pop_to(place)
                continue
            if self._at.get("head") and tag not in IN_HEAD:
                self._pop_to(self._last(["head"]))
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else size
                continue
            if tag == "br":
                self._text(" ")
            if tag in VOID or (found[3].rstrip().endswith("/") and tag in OUT - BLOCK):
                continue
            if tag in CLOSES_P and (p := self._last(["p"])) > self._last(P_SCOPE):
                self._pop_to(p)
            elif tag in CLOSES and (own := self._last(CLOSES[tag][0])) > self._last(CLOSES[tag][1]):
                self._pop_to(own)
            elif tag == "a" and self._last(["a"]) > self._last(BLOCK):
                self._pop_to(self._last(["a"]))
            self._open(tag, found[3])


def line_blocks(lengths: np.ndarray, width: int) -> np.ndarray:
    """The sum of text lengths in each window of width lines, by the line that it begins at."""
    total = np.concatenate([[0], np.cumsum(lengths)])
    return total[np.minimum(np.arange(len(lengths)) + width, len(lengths))] - total[:-1]


def surges(lengths: np.ndarray, width: int, least: int) -> list[tuple[int, int]]:
    """(from, to) of each rise of the distribution, from its surge point to its dive point: the lines of the windows that
    reach least, each window without the lines at its ends that it doesn't need for that."""
    total = np.concatenate([[0], np.cumsum(lengths)])
    starts = np.flatnonzero(line_blocks(lengths, width) >= least)
    ends = np.searchsorted(total, total[starts] + least)
    needed = total[ends] - total[starts + 1] < least
    out: list[tuple[int, int]] = []
    for a, b in zip(starts[needed].tolist(), ends[needed].tolist()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


#: How much a line counts for being in an article or in a main element.
WEIGHT = {"article": 3, "main": 2, "": 1}


def main_text(page: str | None, width: int = 3, least: int = 60, max_linked: float = 0.5) -> str:
    """The article of a page; see extract()."""
    return "\n".join(x.text for x in main_lines(Page(page or ""), width, least, max_linked))


def main_lines(page: Page, width: int, least: int, max_linked: float) -> list[Line]:
    by_scope: dict[int, list[Line]] = {}
    for x in page.lines:
        by_scope.setdefault(x.scope, []).append(x)
    # Lines that are mostly links don't raise the distribution; between its surge and its dive they stay.
    lengths = {k: np.array([0 if x.linked > max_linked * len(x.text) else len(x.text) for x in own]) for k, own in by_scope.items()}
    for low in (least, 1):
        rises = {k: surges(n, width, low) for k, n in lengths.items()}
        weight = {k: WEIGHT[page.scopes[k][0]] * sum(int(lengths[k][a:b].sum()) for a, b in own) for k, own in rises.items()}
        if any(weight.values()):
            break
    else:
        return [x for x in page.lines if x.scope]  # nothing but links: those of an article or main element, if there is one
    best = max(weight, key=lambda k: (weight[k], -k))
    if not best:
        return _unmarked(page, by_scope[0], lengths[0], rises[0])
    # What stands in the chosen element stays to the last line. Articles beside it, and the main element around it or
    # articles in it, belong to the text if they rise half as much.
    tag, around = page.scopes[best]
    chosen = {best}
    for k, (own, above) in page.scopes.items():
        beside = own == "article" and k and page.parent[k] == page.parent[best]
        nested = above in chosen  # scopes are numbered from the outside in
        if nested and tag == "article" or (beside or nested or (k == around and own == "main")) and 2 * weight.get(k, 0) >= weight[best]:
            chosen.add(k)
    out = [x for x in page.lines if x.scope in chosen]
    # A heading in the main element just before its article is the article's.
    at = page.lines.index(out[0])
    while at and page.lines[at - 1].heading and page.scopes[page.lines[at - 1].scope][0] == "main":
        at -= 1
        out.insert(0, page.lines[at])
    return out


def _unmarked(page: Page, lines: list[Line], lengths: np.ndarray, rises: list[tuple[int, int]]) -> list[Line]:
    """Of a page that marks no article: the lines from the first surge to the last dive within the innermost element
    that holds two thirds of all that rises."""
    weight = np.zeros(len(page.parent), np.int64)
    for a, b in rises:
        for x, n in zip(lines[a:b], lengths[a:b].tolist()):
            weight[page.parent[x.element]] += n  # that around its paragraph or item, in which its neighbours are too
    total = int(weight.sum())
    for k in range(len(weight) - 1, 0, -1):
        weight[page.parent[k]] += weight[k]
    holder = int(np.flatnonzero(3 * weight >= 2 * total).max())
    inside = np.zeros(len(weight), bool)
    for k in range(len(weight)):
        inside[k] = k == holder or (k > 0 and inside[page.parent[k]])
    kept = [i for a, b in rises for i in range(a, b) if inside[lines[i].element]]
    first, last = kept[0], kept[-1] + 1
    while first and lines[first - 1].heading:
        first -= 1
    # After the last dive: the rest of a list or table that isn't of links, and sentences.
    while last < len(lines) and lengths[last] and (lines[last].listed or lines[last].text[-1] in ".!?…。！？\"”»)"):
        last += 1
    return lines[first:last]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: the id, the url, text and n_chars (code points of text).

    Scripts, styles, comments, titles and elements that tag, class, id or role mark as menus, headers of the page,
    footers, sidebars, notices, adverts, forms or readers' comments go with all they hold; a name counts as a whole,
    and not on an element that holds the main element or an article. What is left are lines, one a block
    element; character references are decoded, and white space and line breaks within a line are one space.

    Over windows of 3 lines the text lengths are summed, for the lines of each article element, of each main element
    and of the rest of the page. A surge point is where a window begins to reach 60 characters, a dive point where the
    last does. The text comes from where most rises between the two, a line in an article counting three times and in a
    main element twice. From an article or main element every line is kept, however short or linked; from the rest of a
    page all that lies between the first surge and the last dive in the innermost element that holds two thirds of
    what rises, with headings before it and list items and sentences after it. Where no window reaches 60, any
    text makes a rise.

    A null or empty html gives an empty text. Tags that are never closed end with the page, quotes that are never closed
    with their tag. Rows may repeat and keep their number; other columns are not read; an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "url", "text", "n_chars"])

    small_batches(pages.sparkSession)
    source = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("h"))
    return source.mapInArrow(run, "id long, url string, text string, n_chars long").withColumnRenamed("id", id_col)
