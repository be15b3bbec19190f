"""Main text of HTML pages by line-block distribution.

Markup is stripped to lines: an element that breaks lines ends one, an element that
groups blocks also leaves an empty one. Each line weighs its characters outside
links. For every line the weights of the ``WINDOW`` lines from it on are summed; a
surge is a sum above ``SURGE`` (half the greatest sum, on pages of little text), a
dive is a sum of nothing. The text between a surge and the dive after it is kept,
together with headings that lead up to it.

What the markup says beforehand enters as weights. Page furniture (``nav``,
``aside``, ``form``, scripts and so on, elements whose role or class names say so,
and hidden ones) has no lines. Where a page declares its article (``article``, else
``main``, else an element named so that holds half of the text or more), lines inside
weigh more than a surge, so all of them stay however short, and lines outside weigh
nothing; where it declares none, lengths decide.

One page is one string in, one string out, inside a task; the work is linear in its
length. Defined cases: null html is the empty page, with empty text; unclosed and
crossing tags close with their parents; an unclosed comment, tag or script reaches to
the end of the page; unknown character references stay as they are; a page of
furniture only has empty text; repeated rows and ids are extracted each for itself;
an empty table gives an empty result; other columns are kept as they are, and the
two added ones replace columns of their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 86

#: Comments, declarations and tags. Quoted attribute values may hold ``>``.
_MARK = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>`]+)))?""")
_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")

# Fixed values of HTML: elements without content, with raw text, and how elements lay out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
DIVISIONS = frozenset("div section article main body td".split())
IN_HEAD = frozenset("title meta link style script base noscript template".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements that a new element of the key closes, if nothing but ``LEAVES`` is open above them.
SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    **{h: {"h1", "h2", "h3", "h4", "h5", "h6"} for h in ("h1", "h2", "h3", "h4", "h5", "h6")},
}
LEAVES = frozenset("p li dt dd tr td th option h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Elements, roles and words of class names and ids that mark page furniture.
FURNITURE = frozenset("head nav aside footer header form script style title template noscript button select textarea input fieldset legend dialog menu iframe object embed applet audio video canvas svg map xmp noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist status".split())
NAMES = frozenset(
    """ad ads adsense advert adverts advertisement advertisements advertising adbox adslot sponsor sponsors sponsored promo promos promotion promotions banner banners
    cookie cookies consent gdpr notice notices notification notifications alert popup popups modal overlay lightbox
    nav navbar navigation menu menus submenu breadcrumb breadcrumbs toolbar topbar masthead header footer copyright colophon
    sidebar sidebars aside widget widgets related recommended recommendations trending teaser teasers
    comment comments commentlist disqus respond reply replies responses discussion discussions feedback guestbook
    share sharing social follow newsletter subscribe subscription signup login signin search pagination pager skip tags
    announcement announcements disclaimer topnav bottombar toast paywall outbrain taboola""".split()
)
#: Class names and ids by which a page that has no element for it names its main text.
DECLARING = frozenset(
    """content main maincontent main-content main_content page-content site-content article article-body article-content article-text articlebody articletext
    post post-body post-content entry entry-content story story-body body-text bodytext text-body""".split()
)
#: Words beside which a name above says how a page is laid out, not what the element is.
LAYOUT = frozenset("no not has have with without layout enabled disabled open".split())
REMARKS = frozenset("comment comments commentlist reply replies disqus teaser related".split())
WHOLE = frozenset("html body main".split())
RIGHTS = re.compile(r"^\s*(?:©|\(c\)\s|copyright\b)|\ball rights reserved\b", re.I)


class Line(NamedTuple):
    text: str
    weight: int
    declared: int  # 3 inside an article, 2 inside main, 1 inside an element named so, 0 elsewhere
    heading: bool


EMPTY = Line("", 0, 0, False)


class Element(NamedTuple):
    name: str
    furniture: bool
    declared: int
    divisions: int


def _attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)}


def _is_furniture(name: str, values: dict[str, str], inside: bool) -> bool:
    """Whether a start tag opens page furniture; ``inside`` a declared article a header belongs to it."""
    if name in FURNITURE:
        return not (name == "header" and inside)
    if not values or name in ("html", "body"):
        return False
    if "hidden" in values or values.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style", "")):
        return True
    if values.get("role", "").strip().lower() in ROLES:
        return True
    called = [*f"{values.get('class', '')} {values.get('id', '')}".split(), values.get("aria-label", "")]
    if name in ("main", "article"):
        return name == "article" and not REMARKS.isdisjoint(c.lower() for c in called)
    for c in called:
        words = [w.lower() for w in _WORD.findall(c)]
        if not NAMES.isdisjoint(words) and LAYOUT.isdisjoint(words) and not (inside and "header" in words):
            return True
    return False


def _declares(name: str, values: dict[str, str]) -> int:
    """How surely a start tag opens the page's main text."""
    if name == "article" or "articlebody" in values.get("itemprop", "").lower():
        return 3
    if name == "main" or values.get("role") == "main":
        return 2
    return int(name in ("div", "section", "td") and not DECLARING.isdisjoint(f"{values.get('class', '')} {values.get('id', '')}".lower().split()))


class _Strip:
    """Strips one page to its lines."""

    def __init__(self) -> None:
        self.lines: list[Line] = []
        self.open: list[Element] = []
        self.counts: dict[str, int] = {}
        self.furniture: list[int] = []  # places of furniture in ``open``
        self.parts: list[str] = []
        self.weight = 0
        self.link: int | None = None  # how many elements were open when the link began
        self.divided, self.divisions = False, 0  # since the last line with text

    @property
    def top(self) -> Element:
        return self.open[-1] if self.open else Element("", False, 0, 0)

    def text(self, raw: str) -> None:
        if not self.furniture and raw:
            shown = html.unescape(raw) if "&" in raw else raw
            self.parts.append(shown)
            if self.link is None:
                self.weight += len(shown) - shown.count(" ") - shown.count("\n")

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            if self.divided:
                self.lines += [EMPTY] * (1 + min(WINDOW, abs(self.top.divisions - self.divisions)))
            self.divided, self.divisions = False, self.top.divisions
            self.lines.append(Line(text, self.weight, self.top.declared, any(e.name in HEADINGS for e in self.open[-2:])))
        self.parts, self.weight = [], 0

    def pop(self, to: int) -> None:
        """Close all elements from place ``to`` on."""
        self.flush()
        while len(self.open) > to:
            e = self.open.pop()
            self.counts[e.name] -= 1
            self.divided |= e.name in DIVISIONS
            if e.furniture:
                self.furniture.pop()
        if self.link is not None and self.link > to:
            self.link = None

    def push(self, name: str, furniture: bool, declared: int) -> None:
        self.flush()
        if furniture:
            self.furniture.append(len(self.open))
        self.divided |= name in DIVISIONS
        self.open.append(Element(name, furniture, max(declared, self.top.declared), self.top.divisions + (name in DIVISIONS)))
        self.counts[name] = self.counts.get(name, 0) + 1

    def last(self, names: set[str] | frozenset[str]) -> int | None:
        """The place of an open element of these names below nothing but leaves."""
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at].name in names:
                return at
            if self.open[at].name not in LEAVES:
                return None
        return None

    def start(self, name: str, rest: str) -> None:
        if self.counts.get("head") and name not in IN_HEAD:
            self.pop(next(at for at, e in enumerate(self.open) if e.name == "head"))
        for closed in ({"p"} if name in CLOSES_P else None, SIBLINGS.get(name)):
            if closed and (at := self.last(closed)) is not None:
                self.pop(at)
        if name in INLINE and (not rest or name == "wbr" or name == "img"):
            if self.furniture and self.top.name == name:
                self.push(name, False, 0)
            return
        values = _attributes(rest) if rest else {}
        if name == "a" and "href" in values and self.link is None:
            self.link = len(self.open)
        if name in VOID:
            if name in ("br", "hr"):
                self.flush()
            return
        furniture = _is_furniture(name, values, self.top.declared > 1)
        if name in INLINE:
            # only inline furniture, and its namesakes within, need to be kept track of
            if furniture or (self.furniture and self.top.name == name):
                self.push(name, furniture, 0)
            return
        declared = 0 if furniture else _declares(name, values)
        if declared > 1 and self.furniture and self.open[at := self.furniture[-1]].name == "form":
            self.furniture.pop()  # a form around the whole page
            self.open[at] = self.open[at]._replace(furniture=False)
        self.push(name, furniture, declared)

    def end(self, name: str) -> None:
        if name == "a":
            self.link = None
        if name == "br":
            self.flush()
        if name in INLINE:
            if self.counts.get(name) and self.top.name == name:
                self.pop(len(self.open) - 1)
        elif self.counts.get(name):
            at = len(self.open) - 1
            while self.open[at].name != name:
                at -= 1
            self.pop(at)


def strip_markup(page: str) -> list[Line]:
    """The page's lines, without furniture."""
    state, at = _Strip(), 0
    while m := _MARK.search(page, at):
        state.text(page[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if m["end"] or m["end2"]:
            state.end(name)
            continue
        rest = (m["rest"] or m["rest2"] or "").strip()
        if name in RAW:
            found = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = found.end() if found else len(page)
        else:
            state.start(name, rest)
    state.text(page[at:])
    state.flush()
    return state.lines


def surges(weights: list[int]) -> list[tuple[int, int]]:
    """Runs from a surge to the next dive of the windows' sums."""
    sums = [sum(weights[i : i + WINDOW]) for i in range(len(weights))]
    bar = min(SURGE, max(sums, default=0) / 2)
    out, i = [], 0
    while i < len(sums):
        if sums[i] > bar:
            start = i
            while i < len(sums) and sums[i] > 0:
                i += 1
            out.append((start, i))
        else:
            i += 1
    return out


def main_text(page: str | None) -> str:
    """The main text of a page, blocks joined by one space."""
    lines = strip_markup(page or "")
    declared = max((x.declared for x in lines), default=0)
    if declared == 1 and 2 * sum(x.weight for x in lines if x.declared) < sum(x.weight for x in lines):
        declared = 0
        lines = [x._replace(declared=0) for x in lines]
    lines = [x if x.declared == declared else EMPTY for x in lines]
    weights = [max(x.weight, SURGE + 1) if declared and x.text else x.weight for x in lines]
    out = []
    for start, stop in surges(weights):
        while not weights[start]:
            start += 1
        while not weights[stop - 1] or (not declared and stop - 1 > start and RIGHTS.search(lines[stop - 1].text)):
            stop -= 1
        before = start
        while before and (lines[before - 1].heading or not lines[before - 1].text):
            before -= 1
            start = before if lines[before].heading else start
        out += [x.text for x in lines[start:stop] if x.text]
    return " ".join(out)


def extract_main_text(pages: DataFrame, html_col: str = "html", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``pages`` with the main text and its length in code points, in place of the markup."""

    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(main_text, na_action=None)

    text = F.pandas_udf(extract, "string")(F.coalesce(html_col, F.lit("")))
    kept = [c for c in pages.columns if c not in (html_col, text_col, length_col)]
    return pages.select(*kept, text.alias(text_col)).withColumn(length_col, F.length(text_col).cast("long"))
