"""HTML columns: visible text, links, interstitials."""

from __future__ import annotations

import re
from collections import Counter
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveworks.constants import CHALLENGES, PAGE_CHARS, SKIPPED_TAGS
from sieveworks.functions.text import blank, contains_any

_VOID = {"meta", "img", "link", "input", "br", "hr", "area", "base", "col", "embed", "source", "track", "wbr"}
#: Elements that start tags of others end: list items, table cells and rows, options, terms, paragraphs, the head.
_ROWS, _CELLS = {"tr", "tbody", "thead", "tfoot"}, {"td", "th"}
_BLOCKS = {"p", "div", "ul", "ol", "dl", "table", "section", "article", "header", "footer", "nav", "form", "h1", "h2", "h3", "h4", "h5", "h6", "main", "aside", "pre", "blockquote"}
_IN_HEAD = {"title", "meta", "link", "script", "style", "base", "noscript", "template", "head"}
_ENDED = {"li": {"li"}, "option": {"option", "optgroup"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": _ROWS - {"thead", "tbody", "tfoot"} | _CELLS, "td": _CELLS, "th": _CELLS}
#: An end tag does not reach over an element that outranks it.
_RANK = {"div": 1, "td": 2, "th": 2, "tr": 3, "thead": 4, "tbody": 4, "tfoot": 4, "table": 5, "head": 6, "body": 6, "html": 7}


class _Visible(HTMLParser):
    """A stack of open elements; text counts while none of them is skipped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.images = [], []
        self.open: list[str] = []
        self.count: Counter[str] = Counter()
        self.skipped = 0

    def _pop(self) -> str:
        tag = self.open.pop()
        self.count[tag] -= 1
        self.skipped -= tag in SKIPPED_TAGS
        return tag

    def handle_starttag(self, tag, attrs):
        if tag == "img":
            self.images += image_line(dict(attrs))
        if self.count["head"] and tag not in _IN_HEAD:
            while self._pop() != "head":
                pass
        if self.open and (self.open[-1] in _ENDED.get(tag, ()) or (self.open[-1] == "p" and tag in _BLOCKS)):
            self._pop()
            if tag == "tr" and self.open and self.open[-1] == "tr":  # a row that ends its cell ends itself, too
                self._pop()
        if tag not in _VOID:
            self.open.append(tag)
            self.count[tag] += 1
            self.skipped += tag in SKIPPED_TAGS

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML

    def handle_endtag(self, tag):
        if tag in _VOID or not self.count[tag]:
            return
        rank = _RANK.get(tag, 0)
        for held in reversed(self.open):
            if held == tag:
                break
            if _RANK.get(held, 0) > rank:
                return
        while self._pop() != tag:
            pass

    def handle_data(self, data):
        if not self.skipped:
            self.lines += [line.strip() for line in data.splitlines() if line.strip()]


def image_line(have: dict) -> list[str]:
    """What an image tells: its alt, its title and its file's name, each once."""
    alt, title, src = ((have.get(k) or "").strip() for k in ("alt", "title", "src"))
    said = list(dict.fromkeys(x for x in (alt, title, src.rsplit("/", 1)[-1].rsplit("?", 1)[0]) if x))
    return [f"[image: {' | '.join(said)}]"] if said else []


#: An ampersand, with all of the reference that it starts if that ends in its semicolon.
_REFERENCE = re.compile(r"&(?:#[0-9]+;|#[xX][0-9a-fA-F]+;|([A-Za-z][A-Za-z0-9]*;))?")


def visible(html: str | None, size: int = PAGE_CHARS, loose: bool = True) -> str:
    """The text that a page shows, a line for each piece, then its images; at most ``size`` characters.

    ``loose``: a reference may lack its semicolon, as browsers allow (``&amp``); else only whole ones are read, the others are text.
    """
    html = html or ""
    page = _Visible()
    if loose or "&" not in html:
        page.feed(html)
        page.close()
        return "\n".join(page.lines + page.images)[:size]
    # A sign that the page lacks stands for every ampersand that is text, so that the parser reads none of them.
    sign = next(s for s in map(chr, range(0xE000, 0xF900)) if s not in html)
    page.feed(_REFERENCE.sub(lambda m: m[0] if m[0] != "&" and (m[1] is None or m[1] in html5) else sign + m[0][1:], html))
    page.close()
    return "\n".join(page.lines + page.images)[:size].replace(sign, "&")


def visible_text(html: Column, loose: bool = True) -> Column:
    """``visible`` as a column."""

    @F.pandas_udf(T.StringType())
    def shown(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: visible(page, loose=loose))

    return shown(html)


def is_challenge(html: Column) -> Column:
    """Whether a page is a security check in place of its content."""
    return contains_any(F.lower(F.substring(blank(html), 1, 4000)), CHALLENGES)


def title(html: Column) -> Column:
    """What stands in the title tag."""
    return F.regexp_extract(blank(html), r"(?is)<title[^>]*>(.*?)</title>", 1)


def links(html: Column) -> Column:
    """Array of struct<href, text>: anchors in their order; texts lose their tags."""
    anchor = r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
    hrefs = F.regexp_extract_all(blank(html), F.lit(anchor), F.lit(1))
    texts = F.regexp_extract_all(blank(html), F.lit(anchor), F.lit(2))
    return F.zip_with(hrefs, texts, lambda h, t: F.struct(F.trim(h).alias("href"), F.trim(F.lower(F.regexp_replace(t, "<[^>]*>", ""))).alias("text")))
