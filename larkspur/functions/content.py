"""The text of a page's content area, found by element names and classes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import BLANKS

# an ampersand that no name or number and semicolon follow
_OPEN = re.compile(r"&(?!(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)")
_BLANK = re.compile(f"[ \t\n\x0b\f\r{BLANKS}]+")
# Elements whose text is never content.
REMOVED = ("script", "style", "nav", "header", "footer")


class _Area(HTMLParser):
    """One pass over a page. An element is open until its end tag, past as many of its own name as begin inside of it."""

    def __init__(self, names: frozenset[str], classes: frozenset[str]):
        super().__init__()
        self.names, self.classes = names, classes
        self.removed: list = []  # name and number of open elements, of the kinds below too
        self.area: list = []
        self.main: list = []
        self.head: list = []
        self.done = self.found = False
        self.in_area: list[str] = []
        self.in_main: list[str] = []
        self.in_body: list[str] = []

    def _matches(self, tag: str, attrs: list) -> bool:
        if tag in self.names:
            return True
        said = next((v for k, v in attrs if k == "class" and v), "") if self.classes else ""
        return bool(said) and not self.classes.isdisjoint(said.split())

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.removed:
            self.removed[1] += tag == self.removed[0]
            return
        if tag in REMOVED:
            self.removed = [tag, 1]
            return
        if tag == "body":
            self.head = []
        elif tag == "head" and not self.head:
            self.head = [tag, 1]
        if self.area:
            self.area[1] += tag == self.area[0]
        elif not self.done and not self.head and self._matches(tag, attrs):
            self.area, self.found = [tag, 1], True
        if self.main:
            self.main[1] += tag == "main"
        elif tag == "main":
            self.main = [tag, 1]

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes no element

    def handle_endtag(self, tag: str) -> None:
        if self.removed:
            self._end(self.removed, tag)
            return
        if self.area and self._end(self.area, tag):
            self.done = True
        self._end(self.main, tag)
        self._end(self.head, tag)

    @staticmethod
    def _end(what: list, tag: str) -> bool:
        if what and what[0] == tag:
            what[1] -= 1
            if not what[1]:
                what.clear()
                return True
        return False

    def handle_data(self, data: str) -> None:
        if self.removed or self.head:
            return
        self.in_body.append(data)
        if self.area:
            self.in_area.append(data)
        if self.main:
            self.in_main.append(data)


def _said(html: str | None, names: frozenset[str], classes: frozenset[str], main: bool, most: int | None, ended: bool) -> str | None:
    if html is None:
        return None
    page = _Area(names, classes)
    page.feed(_OPEN.sub("&amp;", html) if ended else html)
    page.close()
    text = "".join(page.in_area) if page.found else main and "".join(page.in_main) or "".join(page.in_body)
    return _BLANK.sub(" ", text).strip(" ")[:most] or None


def content_area(html: Column, selectors: tuple[str, ...], main: bool = False, most: int | None = 2000, ended: bool = False) -> Column:
    """The text of the first element, in page order, that one of the selectors names: `name` or `.class`.

    Without one it is that of all main elements, if main and they have any, else that of the body. Scripts, styles,
    menus, headers and footers don't count, blanks are one, and an empty text is null. most: how many characters are kept, as
    the sources' descriptions have it; None keeps the whole text. ended: character references without their semicolon, such
    as texts that are cut have, stay as they are; browsers take some of them for references.
    """
    names = frozenset(s for s in selectors if not s.startswith("."))
    classes = frozenset(s[1:] for s in selectors if s.startswith("."))

    @F.pandas_udf("string")
    def said(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda h: _said(h, names, classes, main, most, ended))

    return said(html)
