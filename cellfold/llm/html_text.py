"""Main text of web pages by composite text density.

Each element of a page gets a density: its characters per tag, times a logarithm that falls
with the share of characters and tags that belong to links. The sum of its children's
densities is highest for the element that directly holds the article's blocks. Elements
that say what they are (menus, adverts, comments, ...) leave the tree before that. One
narrow pass over the pages: nothing is shuffled.
"""

from __future__ import annotations

import re
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellfold.llm.shared import bounded_batches, unused

SPACE = r"\t\n\f\r "
#: A tag with its attributes; a quote only counts after "=". Possessive, so that no text takes more than one try.
TAG = re.compile(rf"<(/?)([A-Za-z][^{SPACE}/>]*+)((?:[^>=]++|=[{SPACE}]*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+)>")
ATTRIBUTE = re.compile(rf"([^{SPACE}=/>\"']++)(?:[{SPACE}]*+=[{SPACE}]*+(?:\"([^\"]*+)\"|'([^']*+)'|([^{SPACE}>\"']*+)))?")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Fixed values of HTML.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = {name: re.compile(rf"</{name}(?=[{SPACE}/>])", re.I) for name in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead tr ul xmp br".split()
)
#: Elements that end an open paragraph.
ENDS_P = BLOCKS - frozenset("br caption body html legend optgroup option tbody td tfoot th thead tr".split())
#: Elements that end others of their own kind, up to the given borders.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select", "datalist")), "a": (("a",), ("table", "td", "th")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)), "thead": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
}
P_BORDERS = frozenset("applet button caption html marquee object table td template th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("p blockquote pre ul ol dl table figure".split())

# What is no article, by element, role, and words of class and id.
DROPPED = frozenset("nav footer aside form script style title textarea noscript template button select iframe object applet svg canvas audio video dialog menu search datalist noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
#: Wherever they stand in a name.
ALWAYS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion promoted cookie cookies consent gdpr comment comments commentlist disqus newsletter".split())
#: Where they end a name, or begin one that doesn't end in a word of ``CONTENT``.
OFTEN = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer masthead topbar copyright banner sidebar sidebars aside widget widgets related recommended "
    "recommendations trending notice notices notification notifications popup modal overlay subscribe subscription paywall share sharing social form search login signup respond reply replies reactions".split()
)
CONTENT = frozenset("article articles body content entry main page layout post story text".split())
NEGATED = frozenset("no not has have with without".split())


def attributes(tag: str) -> dict[str, str]:
    """Names in lower case and values of a tag's attributes; the first of a name counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(tag):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def says_no_article(tag: str, found: dict[str, str]) -> bool:
    """Whether an element's role, class or id names something beside the article."""
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        return True
    if found.get("role", "").strip().lower() in ROLES:
        return True
    own = tag in HEADINGS or tag in ("article", "main")
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        parts = [p.lower() for p in WORDS.findall(name)]
        if not parts or parts[0] in NEGATED:
            continue
        if not ALWAYS.isdisjoint((parts[0], parts[-1])):
            return True
        if not own and (parts[-1] in OFTEN or parts[0] in OFTEN and parts[-1] not in CONTENT):
            return True
        if not own and "header" in (parts[0], parts[-1]) and not CONTENT & set(parts):
            return True
    return False


class Page:
    """The elements of a page in order, with what their own text holds. Element 0 is the body."""

    def __init__(self, html: str, named: bool = True):
        self.tags, self.parent, self.chars, self.in_link = ["body"], [-1], [0], [False]
        self.pieces: list[str] = []
        self.first, self.last = [0], [0]
        #: Whether an article was inside something that says it is none.
        self.lost = False
        # Open elements: number (-1 inside what is dropped), tag, what was dropped from here on, nearest open p.
        self.stack = [(0, "body", False, -1)]
        self.open = {"body": 1}
        self.named = named
        self._read(html)
        while self.stack:
            self._pop()

    def _read(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            start = html.find("<", at)
            if start < 0:
                start = size
            if start > at:
                self._text(html[at:start])
            if start == size:
                return
            follows = html[start + 1 : start + 2]
            if m := TAG.match(html, start):
                at = m.end()
                name = m[2].lower()
                if m[1]:
                    self._end(name)
                elif name in RAW:
                    at = self._after_raw(html, at, name)
                elif name == "plaintext":
                    self._text(html[at:], raw=True)
                    return
                else:
                    self._start(name, m[3])
            elif follows == "!" or follows == "?" or follows == "/" and html[start + 2 : start + 3]:
                if html.startswith("<!--", start):
                    at = _after_comment(html, start + 4)
                elif follows == "/" and html[start + 2].isascii() and html[start + 2].isalpha():
                    return  # the page ends inside a tag
                else:
                    closed = html.find(">", start)
                    at = size if closed < 0 else closed + 1
            elif follows.isascii() and follows.isalpha():
                return  # the page ends inside a tag
            else:
                self._text("<")
                at = start + 1

    def _after_raw(self, html: str, at: int, name: str) -> int:
        """Where the content of an element without markup ends; it holds no text of the article, but for xmp."""
        end = RAW[name].search(html, at)
        if name == "script" and (comment := html.find("<!--", at)) >= 0 and end and comment < end.start():
            inner = re.compile(rf"<script(?=[{SPACE}/>])", re.I).search(html, comment, end.start())
            if inner and "-->" not in html[comment : end.start()]:
                end = RAW[name].search(html, end.end()) or end
        stop = end.start() if end else len(html)
        if name == "xmp":
            self._start(name, "")
            self._text(html[at:stop], raw=True)
            self._end(name)
        if not end:
            return len(html)
        closed = html.find(">", stop)
        return len(html) if closed < 0 else closed + 1

    def _text(self, text: str, raw: bool = False) -> None:
        number, _, dropped, _ = self.stack[-1]
        if dropped:
            return
        if not raw and "&" in text:
            text = unescape(text)
        self.pieces.append(text)
        self.chars[number] += sum(map(len, text.split()))

    def _break(self) -> None:
        self.pieces.append(" ")

    def _start(self, tag: str, rest: str) -> None:
        if tag in ("html", "head", "body", "frameset"):
            return
        if tag in BLOCKS:
            self._break()
            if tag in ENDS_P and self.stack[-1][3] >= 0:
                self._pop_to(self.stack[-1][3])
        if tag in SIBLINGS:
            self._end_sibling(*SIBLINGS[tag])
        if tag in VOID:
            number, _, dropped, _ = self.stack[-1]
            if not dropped:
                self._add(tag, number)
            return
        number, _, dropped, p = self.stack[-1]
        if tag in ("article", "main") and dropped:
            self.lost = True
        if not dropped:
            found = attributes(rest) if rest and self.named else {}
            dropped = tag in DROPPED or tag == "header" and not (self.open.get("article") or self.open.get("main")) or bool(found) and says_no_article(tag, found)
        number = -1 if dropped else self._add(tag, number)
        p = len(self.stack) if tag == "p" else -1 if tag in P_BORDERS else p
        self.stack.append((number, tag, dropped, p))
        self.open[tag] = self.open.get(tag, 0) + 1

    def _add(self, tag: str, parent: int) -> int:
        self.tags.append(tag)
        self.parent.append(parent)
        self.chars.append(0)
        self.in_link.append(tag == "a" or self.in_link[parent])
        self.first.append(len(self.pieces))
        self.last.append(len(self.pieces))
        return len(self.tags) - 1

    def _pop(self) -> None:
        number, tag, _, _ = self.stack.pop()
        self.open[tag] -= 1
        if tag in BLOCKS:
            self._break()
        if number >= 0:
            self.last[number] = len(self.pieces)

    def _pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            self._pop()

    def _end_sibling(self, ended: tuple[str, ...], borders: tuple[str, ...]) -> None:
        if not any(self.open.get(t) for t in ended):
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[depth][1]
            if tag in ended:
                return self._pop_to(depth)
            if tag in borders or tag in ("div", "section", "article", "td", "th", "table"):
                return None
        return None

    def _end(self, tag: str) -> None:
        if tag == "br" or tag == "p" and not self.open.get("p"):
            self._break()
        elif tag not in ("html", "head", "body") and self.open.get(tag):
            # An end tag of an inline element doesn't close the block around it.
            for depth in range(len(self.stack) - 1, 0, -1):
                if self.stack[depth][1] == tag:
                    return self._pop_to(depth)
                if tag not in BLOCKS and self.stack[depth][1] in BLOCKS:
                    return None
        return None

    def text(self, number: int) -> str:
        """The text of an element: blocks in page order, white space as single spaces."""
        return " ".join("".join(self.pieces[self.first[number] : self.last[number]]).split())


def _after_comment(html: str, at: int) -> int:
    if html.startswith(">", at):
        return at + 1
    if html.startswith("->", at):
        return at + 2
    end = re.compile(r"--!?>").search(html, at)
    return end.end() if end else len(html)


def densities(page: Page) -> tuple[list[float], list[float]]:
    """Composite text density of each element, and the sum of its children's."""
    n = len(page.tags)
    chars, tags, links, link_tags = page.chars[:], [0] * n, [c if a else 0 for c, a in zip(page.chars, page.in_link, strict=True)], [0] * n
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        chars[p] += chars[i]
        links[p] += links[i]
        tags[p] += tags[i] + 1
        link_tags[p] += link_tags[i] + (page.tags[i] == "a")
    share = links[0] / max(chars[0], 1)
    density, total = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        if c := chars[i]:
            t, lc, lt = max(tags[i], 1), max(links[i], 1), max(link_tags[i], 1)
            density[i] = c / t * log(c / lc * t / lt) / log(log(c / max(c - links[i], 1) * lc + share * c + e))
        if i:
            total[page.parent[i]] += density[i]
    return density, total


def main_element(page: Page) -> int:
    """The element that holds the article.

    The lowest density on the path from the densest element to the body is the threshold; of
    the elements that reach it, that with the highest sum of children's densities is chosen.
    It grows to the article (or main) element around it, or while all that its parent has
    beside it are headings, and prose or groups of elements that reach the threshold; if it holds a
    single article with at least half of its characters, it shrinks to that.
    """
    density, total = densities(page)
    at = max(range(len(density)), key=density.__getitem__)
    threshold = density[at]
    while at:
        at = page.parent[at]
        threshold = min(threshold, density[at])
    chosen = max((i for i in range(len(density)) if density[i] >= threshold), key=total.__getitem__, default=0)
    if total[chosen] <= 0:
        chosen = 0
    around, named = chosen, []
    while around >= 0:
        if page.tags[around] in ("article", "main"):
            named.append(around)
        around = page.parent[around]
    if named:
        return next((i for i in reversed(named) if page.tags[i] == "article"), named[-1])
    children: dict[int, list[int]] = {}
    for i in range(1, len(density)):
        children.setdefault(page.parent[i], []).append(i)
    beside = lambda i: i == chosen or page.tags[i] in HEADINGS or not density[i] or density[i] >= threshold and (total[i] > 0 or page.tags[i] in PROSE)
    while chosen and all(map(beside, children[page.parent[chosen]])):
        chosen = page.parent[chosen]
    for kind in ("article", "main"):
        inside = [i for i in range(chosen + 1, len(density)) if page.tags[i] == kind and page.first[chosen] <= page.first[i] and page.last[i] <= page.last[chosen]]
        if len(inside) == 1 and 2 * len(page.text(inside[0])) >= len(page.text(chosen)):
            return inside[0]
    return chosen


def main_text(html: str | None) -> str:
    """The main text of a page; empty where there is none."""
    page = Page(html or "")
    found = page.text(main_element(page))
    if not found and page.lost:
        page = Page(html or "", named=False)
        found = page.text(main_element(page))
    return found


def extract_text(pages: DataFrame, html_col: str = "html", text_col: str = "text", chars_col: str = "n_chars", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``pages`` (all but the html) with each page's main text and its code points.

    Null and empty pages give an empty text. Whole pages are read, however long; a page
    that ends inside a tag or comment loses what browsers lose. Repeated rows stay, an empty table gives an empty result. A
    kept column that has the name of an output column is an error.
    """
    keep = [c for c in pages.columns if c != html_col] if keep is None else keep
    if clash := {text_col, chars_col} & set(keep):
        raise ValueError(f"output column {sorted(clash)[0]!r} already exists")
    bounded_batches(pages.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [main_text(html.as_py()) for html in batch.column(len(keep))]
            columns = [*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, text_col, chars_col])

    inner = unused(keep, "html")["html"]
    rows = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").cast("string").alias(inner))
    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep), f"`{text_col}` string", f"`{chars_col}` long"])
    return rows.mapInArrow(run, schema)
