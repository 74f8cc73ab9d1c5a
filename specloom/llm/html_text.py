"""Main text of web pages: parser events, text-to-tag ratios per line, Gaussian smoothing, threshold clustering."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Elements that begin and end a line of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
#: Elements whose characters are never text.
SILENT = frozenset("script style template noscript svg annotation annotation-xml iframe object canvas audio video select datalist textarea button title noframes".split())
#: Elements of page furniture.
FURNITURE = frozenset("nav footer aside form menu dialog search fieldset".split())
#: Roles of page furniture.
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words that mark page furniture as a whole class or id, as its last part (``site-footer``), or as its first before a part of SHAPES (``ad-slot``).
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "nav navbar navigation menu menus breadcrumb breadcrumbs footer header masthead topbar sidebar sidebars aside widget widgets related "
    "recommended share sharing social newsletter subscribe subscription signup login popup modal overlay comment comments respond reply "
    "replies discussion disqus pagination pager toolbar copyright legal disclaimer".split()
)
SHAPES = frozenset(
    "area bar block body bottom box button buttons container content form group holder icon icons inner item items left link links list outer panel "
    "right row section slot table thread title top unit wrap wrapper zone".split()
)
#: Parts of a class that say what the page has or lacks elsewhere: ``has-sidebar``, ``no-footer``.
NEGATIONS = frozenset("has have with without no non not is ".split())
#: Marks that inside the article name its own head.
HEADS = frozenset("header masthead banner".split())
#: Marks of reader comments, which may be longer than the article.
REPLIES = frozenset("comment comments respond reply replies discussion disqus".split())
#: A marked element with more of the page's text than this is no furniture: in general, and for reader comments.
MOST, MOST_REPLIES = 0.5, 0.9
#: Elements that hold the article, the best first.
HOLDERS = ("article", "main")
#: Elements without an end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an opening tag of the given kind ends, within its block.
ENDS = {k: frozenset(v.split()) for k, v in {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}.items()}
#: Smoothing: lines on either side, and the width of the Gauss curve in lines.
RADIUS, SIGMA = 2, 1.0

_WHITE = re.compile(r"\s+")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HEADING = re.compile(r"h[1-6]$")


class _Line:
    __slots__ = ("heading", "holder", "marks", "parent", "tags", "text")

    def __init__(self, text: str, tags: int, holder: int, heading: bool, marks: tuple[int, ...], parent: int):
        self.text, self.tags, self.holder, self.heading, self.marks, self.parent = text, tags, holder, heading, marks, parent


class _Reader(HTMLParser):
    """Turns parser events into lines (texts of blocks with their numbers of tags); furniture by element or role is left out.

    Elements that only their class or id marks are noted with each line; ``_unmarked`` decides on them when the page
    is known whole.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        self.open: list[tuple[str, bool, int, tuple[int, ...], int]] = []  # name, furniture or silent, holder, marked elements, own number
        self.parts: list[str] = []
        self.tags = self.count = 0
        self.holders: list[str] = [""]
        self.marked: list[bool] = []  # by marked element: reader comments
        self.heading = False

    def _skip(self) -> bool:
        return bool(self.open) and self.open[-1][1]

    def _holder(self) -> int:
        return self.open[-1][2] if self.open else 0

    def _flush(self) -> None:
        text = _WHITE.sub(" ", "".join(self.parts)).strip()
        if text:
            marks = self.open[-1][3] if self.open else ()
            blocks = [x[4] for x in self.open if x[0] in BLOCKS][-2:]
            self.lines.append(_Line(text, self.tags, self._holder(), self.heading, marks, blocks[0] if blocks else 0))
            self.tags = 0
        self.parts.clear()

    def handle_starttag(self, tag: str, attrs) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self._flush()
            self.heading = bool(_HEADING.match(tag))
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag in ENDS or tag in BLOCKS:
            self._end_implied(tag)
        inside, marks = self._holder(), self.open[-1][3] if self.open else ()
        bad = self._skip() or tag in SILENT or tag in FURNITURE or (tag == "header" and not inside) or _hidden(attrs)
        if not bad and attrs and tag not in ("html", "body", *HOLDERS) and not _HEADING.match(tag) and (found := _marks(attrs, inside)):
            marks = (*marks, len(self.marked))
            self.marked.append(found <= REPLIES)
        if tag in HOLDERS and not bad:
            self.holders.append(tag)
            inside = len(self.holders) - 1
        self.count += 1
        self.open.append((tag, bad, inside, marks, self.count))

    def _end_implied(self, tag: str) -> None:
        """Ends what the start of ``tag`` ends: an open paragraph at a block, a list item at the next, and so on."""
        ends = ENDS.get(tag, frozenset()) | ({"p"} if tag in BLOCKS else frozenset())
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name in ends:
                del self.open[i:]
                return
            if name in BLOCKS or name in SILENT:
                return

    def handle_startendtag(self, tag: str, attrs) -> None:
        if tag in VOID or tag in SILENT:
            self.handle_starttag(tag, attrs) if tag in VOID else None
        else:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self._flush()
            self.heading = False
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return
            if self.open[i][0] in ("table", "article", "main", "body") and tag not in ("html", "body", "article", "main"):
                return

    def handle_data(self, data: str) -> None:
        if not self._skip():
            self.parts.append(data)

    def lines_of(self, html: str) -> list[_Line]:
        self.feed(html)
        self.close()
        self._flush()
        return self.lines


def _hidden(attrs) -> bool:
    for name, value in attrs:
        if (name == "role" and (value or "").strip().lower() in ROLES) or name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
    return False


def _marks(attrs, holder: int) -> set[str]:
    """The words of an element's class and id that mark it; inside the article those of its head mark nothing."""
    found = set()
    for name, value in attrs:
        for token in (value or "").split() if name in ("class", "id") else ():
            parts = [p.lower() for p in _PART.findall(token)]
            if not parts or NEGATIONS & set(parts[:-1]):
                continue
            if parts[-1] in MARKS:
                found.add(parts[-1])
            elif parts[0] in MARKS and parts[-1] in SHAPES:
                found.add(parts[0])
    return found - HEADS if holder else found


def _unmarked(reader: _Reader) -> list[_Line]:
    """The lines but for those in marked elements, as far as these are furniture.

    A marked element is none if it is around the article (unless that is a reader comment of a page that has another
    article), or if it has most of the page's text and does not stand beside an article.
    """
    lines, n = reader.lines, len(reader.marked)
    if not n:
        return lines
    size, total = [0] * n, sum(len(x.text) for x in lines)
    around: dict[int, frozenset[int]] = {}
    for x in lines:
        for m in x.marks:
            size[m] += len(x.text)
        if x.holder:
            around[x.holder] = around.get(x.holder, frozenset(x.marks)).intersection(x.marks)
    within = {m for x in lines if x.holder for m in x.marks if m not in around[x.holder]}
    replies = [a for a in around.values() if any(reader.marked[m] for m in a)]
    own = [a for a in around.values() if not any(reader.marked[m] for m in a)] or replies
    held = frozenset() if frozenset() in own else frozenset().union(*own)
    small = lambda m: size[m] <= (MOST_REPLIES if reader.marked[m] else MOST) * total
    gone = {m for m in range(n) if m not in held and (small(m) or (bool(around) and m not in within))}
    return [x for x in lines if not gone.intersection(x.marks)]


def _selected(lines: list[_Line]) -> list[bool]:
    """Which lines have smoothed text-to-tag ratios over the threshold: the deviation of the ratios of the page."""
    ratio = [len(x.text) / max(1, x.tags) for x in lines]
    kernel = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-RADIUS, RADIUS + 1)]
    smooth = []
    for i in range(len(ratio)):
        near = [(w, ratio[i + k]) for w, k in zip(kernel, range(-RADIUS, RADIUS + 1), strict=True) if 0 <= i + k < len(ratio)]
        smooth.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    mean = sum(smooth) / len(smooth)
    threshold = min(math.sqrt(sum((r - mean) ** 2 for r in smooth) / len(smooth)), mean)
    return [r >= threshold for r in smooth]


def main_text(html: str | None) -> str:
    """The article's blocks in page order, parted by two line ends; empty if the page has no text."""
    if not html:
        return ""
    reader = _Reader()
    reader.lines_of(html)
    lines = _unmarked(reader)
    if not lines:
        return ""
    chosen = _selected(lines)
    weight: dict[int, int] = {}
    for x, good in zip(lines, chosen, strict=True):
        if good:
            weight[x.holder] = weight.get(x.holder, 0) + len(x.text)
    for kind in HOLDERS:
        held = {h for h in weight if reader.holders[h] == kind}
        if held and 2 * sum(weight[h] for h in held) >= max(weight.values()):
            return "\n\n".join(x.text for x in lines if x.holder in held)
    region = [i for i, good in enumerate(chosen) if good]
    parents = {lines[i].parent for i in region}
    kept = []
    for i, x in enumerate(lines):
        between = region[0] <= i <= region[-1]
        if between or x.parent in parents or (x.heading and i + 1 == region[0]):
            kept.append(x.text)
    return "\n\n".join(kept)


def extracted(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, text and n_chars (code points) of every whole page; null and empty pages have empty text.

    Markup that does not close, unknown character references and pages without tags are read as browsers do, as
    far as the standard library's parser goes. Repeated rows give repeated rows; an empty table gives none.
    """
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema] + ["text string", "n_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                texts = [main_text(x.as_py()) for x in part.column(len(keep))]
                new = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *new], names=[*keep, "text", "n_chars"])

    return pages.select(*keep, F.col(html_col).cast("string").alias("_html")).mapInArrow(run, schema)


def op9(spark, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
