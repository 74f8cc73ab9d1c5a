"""Fields of web pages: standard-library parser events inside Arrow functions."""

from __future__ import annotations

import html as entities
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = "struct<title:string,h1:string,description:string,paragraphs:array<string>,links:array<struct<href:string,text:string>>,labels:map<string,string>>"
_WHITE = re.compile(r"\s+")
_SILENT = ("script", "style", "noscript", "template")
_CAUGHT = ("title", "h1", "p", "a", "dt", "dd", "th", "td")


class _Fields(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.silent, self.open, self.out = 0, [], {k: [] for k in _CAUGHT}
        self.links, self.meta, self.href = [], {}, None

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        if tag in _SILENT:
            self.silent += 1
        elif tag == "meta" and values.get("name"):
            self.meta.setdefault(values["name"].lower(), values.get("content") or "")
        elif tag in _CAUGHT:
            for group in (("p",), ("dt", "dd"), ("th", "td")):
                if tag in group and any(t in group for t, _ in self.open):
                    self._close(next(t for t, _ in reversed(self.open) if t in group))
            self.open.append((tag, []))
            if tag == "a":
                self.href = values.get("href")

    def _close(self, tag):
        while any(t == tag for t, _ in self.open):
            name, parts = self.open.pop()
            text = _WHITE.sub(" ", "".join(parts)).strip()
            self.out[name].append(text)
            if name == "a" and self.href is not None:
                self.links.append({"href": self.href, "text": text})
                self.href = None
            if name == tag:
                return

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in _CAUGHT:
            self._close(tag)

    def handle_data(self, data):
        if not self.silent:
            for _, parts in self.open:
                parts.append(data)


def _fields(page: str | None) -> dict | None:
    if page is None:
        return None
    own = _Fields()
    own.feed(page)
    own.close()
    for tag in [t for t, _ in reversed(own.open)]:
        own._close(tag)
    first = lambda k: next((x for x in own.out[k] if x), None)
    labels = dict(zip(own.out["dt"], own.out["dd"], strict=False)) | dict(zip(own.out["th"], own.out["td"], strict=False))
    return {"title": first("title"), "h1": first("h1"), "description": own.meta.get("description"), "paragraphs": [x for x in own.out["p"] if x], "links": own.links, "labels": labels}


def _page_fields(pages: pd.Series) -> pd.DataFrame:
    rows = [_fields(x) or dict.fromkeys(("title", "h1", "description", "paragraphs", "links", "labels")) for x in pages]
    return pd.DataFrame(rows, columns=["title", "h1", "description", "paragraphs", "links", "labels"])


def page_fields(page: Column) -> Column:
    """Title, first heading, meta description, paragraphs, links and label-value pairs of a page."""
    return F.pandas_udf(_page_fields, FIELDS)(page)


def tags_stripped(page: Column) -> Column:
    """The text of a page without scripts, styles and tags, white space collapsed, common entities decoded."""
    text = F.regexp_replace(page, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(text, "(?s)<[^>]*>", " ")
    decode = F.pandas_udf(lambda s: s.map(lambda x: None if x is None else _WHITE.sub(" ", entities.unescape(x)).strip()), "string")
    return decode(text)


def body_text(fields: Column, least_body: int = 80, least_paragraph: int = 20) -> Column:
    """The first paragraph longer than ``least_body``, else all longer than ``least_paragraph`` by line, else the description."""
    long = F.try_element_at(F.filter(fields["paragraphs"], lambda p: F.length(p) > least_body), F.lit(1))
    some = F.nullif(F.array_join(F.filter(fields["paragraphs"], lambda p: F.length(p) > least_paragraph), "\n"), F.lit(""))
    return F.coalesce(long, some, fields["description"], F.lit(""))
