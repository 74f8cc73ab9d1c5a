"""Pages as small trees of elements: what needs parents and siblings, inside Arrow functions."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_ENDS = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
_ENDED_BY = {k: frozenset(v.split()) for k, v in _ENDS.items()}
_BLOCKS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SILENT = ("script", "style")
_DATE = re.compile(r"(20\d{2}-\d{2}-\d{2})")


class Element:
    """A tag with its attributes; children are elements and strings."""

    __slots__ = ("after", "attrs", "children", "last", "parent", "tag")

    def __init__(self, tag: str, attrs: Mapping[str, str | None], parent: Element | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.after = self.last = None  # the next sibling element, the last child element
        if parent is not None:
            parent.children.append(self)
            if parent.last is not None:
                parent.last.after = self
            parent.last = self

    def walk(self) -> Iterator[Element]:
        """All elements below, in page order, whatever the depth."""
        todo = [c for c in reversed(self.children) if isinstance(c, Element)]
        while todo:
            e = todo.pop()
            yield e
            todo.extend(c for c in reversed(e.children) if isinstance(c, Element))

    def strings(self) -> Iterator[str]:
        """The stripped texts below, without scripts and styles."""
        todo = list(reversed(self.children))
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                if c := c.strip():
                    yield c
            elif c.tag not in _SILENT:
                todo.extend(reversed(c.children))

    def text(self, between: str = " ") -> str:
        return between.join(self.strings())

    def has_class(self, name: str) -> bool:
        return name in (self.attrs.get("class") or "").split()

    def following(self) -> Element | None:
        """The next sibling element."""
        return self.after

    def above(self, tag: str) -> Element | None:
        e = self.parent
        while e is not None and e.tag != tag:
            e = e.parent
        return e


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)

    def handle_starttag(self, tag, attrs):
        if self.at.tag in _ENDED_BY.get(tag, ()) or (tag in _BLOCKS and self.at.tag == "p"):
            self.at = self.at.parent
        e = Element(tag, dict(attrs), self.at)
        if tag not in _VOID:
            self.at = e

    def handle_startendtag(self, tag, attrs):
        Element(tag, dict(attrs), self.at)

    def handle_endtag(self, tag):
        e = self.at
        while e is not None and e.tag != tag:
            e = e.parent
        if e is not None and e.parent is not None:
            self.at = e.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(page: str) -> Element:
    own = _Builder()
    own.feed(page)
    own.close()
    return own.root


#: Pages of plain tags only: lower-case names, quoted attributes, no references, comments or declarations.
_PLAIN = r'<(/?)([a-z][a-z0-9]*+)((?: ++[a-z-]++="[^"<>&]*+")*+)>([^<&]*+)'
_PLAIN_TAG, _PLAIN_PAGE = re.compile(_PLAIN), re.compile(f"([^<&]*+)(?:{_PLAIN})*+")
_ATTRIBUTE = re.compile('([a-z-]+)="([^"]*)"')
#: Elements in which the parser reads text in other ways.
_RAW = frozenset("iframe noembed noframes noscript plaintext script style textarea title xmp".split())


def _plain_tokens(page: str) -> list[tuple[str, str, str, str]] | None:
    """(slash, tag, attributes, text after it) of all tags of a page of plain tags; null for any other page."""
    if not _PLAIN_PAGE.fullmatch(page):
        return None
    found = _PLAIN_TAG.findall(page)
    for i, (slash, tag, attrs, _) in enumerate(found):
        if slash:
            if attrs:
                return None
        elif tag in _RAW and (i + 1 == len(found) or found[i + 1][:2] != ("/", tag)):
            return None
    return found


class _Flat(HTMLParser):
    """A page in one pass of events: its texts in order, and for each element by number which of them are its own.

    Elements end where ``_Builder`` ends them. Element 0 is the page.
    """

    def __init__(self, labels: Mapping[str, str], item: str):
        super().__init__(convert_charrefs=True)
        self.labels, self.item, self.name_class, self.value_class = labels, item, f"{item}-name", f"{item}-value"
        self.tags, self.parents, self.starts, self.ends, self.after, self.last = [""], [-1], [0], [-1], [0], [0]
        self.texts: list[str] = []
        self.at, self.silent = 0, 0
        self.marked: dict[int, list[int]] = {}  # items: the first name and value in each
        self.hits: list[tuple[int, str]] = []
        self.firsts: dict[str, int] = {}

    def read(self, page: str) -> None:
        """All events of a page; those of plain pages, which are most, come from one pattern, to the same effect."""
        tokens = _plain_tokens(page)
        if tokens is None:
            self.feed(page)
            self.close()
            return
        at = page.find("<")
        self.handle_data(page if at < 0 else page[:at])
        for slash, tag, attrs, after in tokens:
            if slash:
                self.handle_endtag(tag)
            else:
                self.handle_starttag(tag, _ATTRIBUTE.findall(attrs) if attrs else ())
            if after:
                self.handle_data(after)

    def _open(self, tag: str, attrs: Sequence) -> int:
        n, parent = len(self.tags), self.at
        self.tags.append(tag), self.parents.append(parent), self.starts.append(len(self.texts)), self.ends.append(-1), self.after.append(0), self.last.append(0)
        if before := self.last[parent]:
            self.after[before] = n
        self.last[parent] = n
        if tag in ("title", "h1") and tag not in self.firsts:
            self.firsts[tag] = n
        for key, value in attrs:
            if key == "class" and value and self.item in value:
                classes = value.split()
                if self.item in classes:
                    self.marked[n] = [0, 0]
                for place, name in enumerate((self.name_class, self.value_class)):
                    if name in classes:
                        self._mark(n, place)
                break
        return n

    def _mark(self, n: int, place: int) -> None:
        above = self.parents[n]
        while above >= 0:
            if (own := self.marked.get(above)) is not None and not own[place]:
                own[place] = n
            above = self.parents[above]

    def _leave(self) -> None:
        self.ends[self.at] = len(self.texts)
        self.silent -= self.tags[self.at] in _SILENT
        self.at = self.parents[self.at]

    def handle_starttag(self, tag, attrs):
        if self.tags[self.at] in _ENDED_BY.get(tag, ()) or (tag in _BLOCKS and self.tags[self.at] == "p"):
            self._leave()
        n = self._open(tag, attrs)
        if tag in _VOID:
            self.ends[n] = self.starts[n]
        else:
            self.at = n
            self.silent += tag in _SILENT

    def handle_startendtag(self, tag, attrs):
        n = self._open(tag, attrs)
        self.ends[n] = self.starts[n]

    def handle_endtag(self, tag):
        e = self.at
        while e > 0 and self.tags[e] != tag:
            e = self.parents[e]
        if e > 0:
            while self.at != e:
                self._leave()
            self._leave()

    def handle_data(self, data):
        if own := data.strip():
            if not self.silent:
                self.texts.append(own)
            if own in self.labels:
                self.hits.append((self.at, own))

    def text(self, n: int, between: str = " ") -> str:
        end = self.ends[n]
        return between.join(self.texts[self.starts[n] : len(self.texts) if end < 0 else end])

    def first(self, tag: str, between: str = " ") -> str | None:
        return self.text(self.firsts[tag], between) if tag in self.firsts else None

    def values(self, enough: int = 5) -> dict[str, str]:
        """Values by column: those of the elements of class ``item`` (with ``-name`` and ``-value`` in them); if they are
        fewer than ``enough``, also those beside any text that is a label: the next element, else the rest of the parent's."""
        found = {}
        for name, value in self.marked.values():
            if name and value and (own := self.text(name)) in self.labels:
                found[self.labels[own]] = self.text(value)
        if len(found) >= enough:
            return found
        for n, own in sorted(self.hits, key=lambda hit: hit[0]):
            column = self.labels[own]
            if column in found:
                continue
            value = self.text(self.after[n]) if self.after[n] else ""
            if not value and self.parents[n] >= 0:
                value = self.text(self.parents[n]).replace(own, "", 1).strip()
            if value:
                found[column] = value
        return found


def listing(page: Column, labels: Mapping[str, str], item: str) -> Column:
    """(title, h1, text, values map) of a listing page; null for a null page."""
    kinds = pa.struct([("title", pa.string()), ("h1", pa.string()), ("text", pa.string()), ("values", pa.map_(pa.string(), pa.string()))])

    def run(pages: pa.Array) -> pa.Array:
        columns: list[list] = [[], [], [], []]
        for p in pages:
            own = None
            if p.is_valid:
                own = _Flat(labels, item)
                own.read(p.as_py())
            told = (None,) * 4 if own is None else (own.first("title", ""), own.first("h1"), own.text(0), list(own.values().items()))
            for column, value in zip(columns, told, strict=True):
                column.append(value)
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], fields=list(kinds))

    return F.arrow_udf(run, "title string, h1 string, text string, values map<string,string>")(page)


def _date_near(a: Element) -> str | None:
    """The first date in the list item around a link, else in the element after that item."""
    item = a.above("li")
    for e in (item, item and item.following()):
        if e is not None and (m := _DATE.search(e.text())):
            return m[1]
    return None


def links(page: Column, base: Column) -> Column:
    """The links of a page: (url joined to ``base``, text, date near it)."""

    def run(pages: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([[] if p is None else [{"url": urljoin(b or "", e.attrs["href"] or ""), "text": e.text(""), "date": _date_near(e)} for e in tree(p).walk() if e.tag == "a" and "href" in e.attrs] for p, b in zip(pages, bases, strict=True)])

    return F.pandas_udf(run, "array<struct<url:string,text:string,date:string>>")(page, base)


def _body(root: Element, selectors: Sequence[tuple[str, str, str]], least: int, paragraph: int) -> str | None:
    for tag, kind, name in selectors:
        e = next((x for x in root.walk() if x.tag == tag and (x.has_class(name) if kind == "class" else x.attrs.get("id") == name)), None)
        if e is not None and len(text := e.text("\n")) > least:
            return text
    long = [t for e in root.walk() if e.tag == "p" and len(t := e.text()) > paragraph]
    return "\n".join(long) or None


def detail(page: Column, selectors: Sequence[tuple[str, str, str]], least: int = 80, paragraph: int = 20) -> Column:
    """(meta map, text by line, body) of an article page; the body is the first of ``selectors`` (tag, class or id, name)
    with more than ``least`` letters, else the paragraphs of more than ``paragraph``; meta has the first of a name."""

    def run(pages: pd.Series) -> pd.DataFrame:
        rows = []
        for p in pages:
            root = None if p is None else tree(p)
            meta: dict[str, str] = {}
            for e in () if root is None else root.walk():
                if e.tag == "meta" and e.attrs.get("name") and e.attrs.get("content"):
                    meta.setdefault(e.attrs["name"], e.attrs["content"].strip())
            rows.append({"meta": None if root is None else meta, "text": root and root.text("\n"), "body": root and _body(root, selectors, least, paragraph)})
        return pd.DataFrame(rows, columns=["meta", "text", "body"])

    return F.pandas_udf(run, "meta map<string,string>, text string, body string")(page)
