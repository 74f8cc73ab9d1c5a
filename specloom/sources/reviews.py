"""Owner reviews from paged answers: a data source with a partition a page, and the same over a table of keys."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, Not, StringContains

from specloom.operators.reviews import VISIT
from specloom.session import settled
from specloom.sources.web import Fetch, fetched, http_get

#: Fixed values. Addresses of the answers: reviews of a series, of a trim; reviews of a page; pages asked for at most.
SERIES = "{base}/pc/series/list?pm=3&seriesId={id}&pageIndex={page}&pageSize=20&yearid={year}&ge=0&seriesSummaryKey=0&order=0"
SPEC = "{base}/pc/spec/list?pm=3&specId={id}&pageIndex={page}&pageSize=20&ge=0&seriesSummaryKey=0&order=0"
BASE, MOST = "https://koubeiipv6.app.autohome.com.cn", 10
#: First pages that the driver asks for at a time; seconds of a wait, as a multiple of the other sources'.
AT_ONCE, SLOWER = 6, 2.0
SCHEMA = (
    "kind string, id string, page int, pos int, show_id string, specname string, posted string, owned string, distance string, "
    "visit boolean, sections array<struct<name: string, text: string>>, error string"
)
ANSWERS = "kind string, id string, page int, body string, error string"


def address(kind: str, key: str, page: int, base: str = BASE, year: str = "0") -> str:
    return (SPEC if kind == "spec" else SERIES).format(base=base, id=key, page=page, year=year)


def asked(kind: str, key: str, page: int, base: str, year: str, fetch: Fetch, wait: Callable[[float], None]) -> tuple[str | None, str | None]:
    """(body, error) of a page; 404 is an error here."""
    _, status, body, error = fetched(address(kind, key, page, base, year), fetch, lambda s: wait(SLOWER * s))
    return (body, None) if error is None and status != 404 else (None, error or f"HTTP {status}")


def pagecount(body: str | None) -> int:
    """The pages that an answer says there are; 0 if it says nothing."""
    try:
        return int(json.loads(body or "")["result"]["pagecount"])
    except (ValueError, KeyError, TypeError):
        return 0


def _text(value) -> str | None:
    return None if value is None else str(value)


def rows_of(kind: str, key: str, page: int, body: str | None, error: str | None = None) -> list[tuple]:
    """SCHEMA rows of one answer, in its order; one row with the error if it failed or is no list of reviews."""
    if error is None:
        try:
            found = [dict(e) for e in json.loads(body or "")["result"]["list"] or []]
        except (ValueError, KeyError, TypeError):
            error = "no list of reviews"
    if error is not None:
        return [(kind, key, page, None, None, None, None, None, None, None, None, error)]
    out = []
    for n, e in enumerate(found):
        visit = any(isinstance(x, dict) and x.get("name") == VISIT for x in e.get("exinfolist") or [])
        sections = [(_text(c.get("structuredname")), _text(c.get("content"))) for c in e.get("contents") or [] if isinstance(c, dict)]
        out.append((kind, key, page, n, *(_text(e.get(f)) for f in ("showId", "specname", "posttime", "carOwnershipPeriod", "distance")), visit, sections, None))
    return out


def parsed(answers: DataFrame) -> DataFrame:
    """SCHEMA rows of ANSWERS rows. Null bodies and bodies that are no list of reviews give a row with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            plain = batch.astype(object).where(batch.notna(), None)
            rows = [r for a in plain.itertuples(index=False) for r in rows_of(*a)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _FIELDS]).astype({"page": "Int32", "pos": "Int32"})

    return answers.select("kind", "id", "page", "body", "error").mapInPandas(run, SCHEMA)


_FIELDS = ["kind", "id", "page", "pos", "show_id", "specname", "posted", "owned", "distance", "visit", "sections", "error"]


def fetch_reviews(keys: DataFrame, most: int = MOST, base: str = BASE, year: str = "0", fetch: Fetch = http_get, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """SCHEMA rows of all reviews of ``keys`` (kind series or spec, id): executors ask for first pages, then side by side for the rest.

    ``most`` pages a key at most, as the site's readers have it. A key of several rows is asked for once.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, int(p), *asked(k, i, int(p), base, year, fetch, wait)) for k, i, p in batch.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["kind", "id", "page", "body", "error"])

    first = settled(keys.select("kind", F.col("id").cast("string").alias("id")).distinct().withColumn("page", F.lit(1)).mapInPandas(ask, ANSWERS))
    pages = first.withColumn("last", F.try_variant_get(F.try_parse_json("body"), "$.result.pagecount", "int")).where("last >= 2")
    rest = pages.select("kind", "id", F.explode(F.sequence(F.lit(2), F.least("last", F.lit(most)))).alias("page")).where("page > 1")
    dealt = rest.repartition("kind", "id", "page")  # a page is a request: dealt out one by one
    return parsed(first.union(dealt.mapInPandas(ask, ANSWERS)))


class ReviewsSource(DataSource):
    """``spark.read.format("specloom_reviews")`` with ``series`` or ``specs`` (ids between blanks or commas; specs win), ``most`` pages
    of each (10), ``year`` (0: any) and ``base``: SCHEMA rows, a partition a page.

    The first page of each tells how many there are; it is asked for once. Pages that fail are rows with an error.
    With option ``pushdown`` (which needs ``spark.sql.python.filterPushdown.enabled``), conditions on kind, id and page
    spare requests, and those on visit and specname (contains) spare rows.
    """

    @classmethod
    def name(cls) -> str:
        return "specloom_reviews"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        pushing = (self.options.get("pushdown") or "").lower() == "true"
        return (PushingReader if pushing else ReviewsReader)(dict(self.options))


class Page(InputPartition):
    def __init__(self, kind: str, key: str, page: int, answer: tuple[str | None, str | None] | None):
        self.kind, self.key, self.page, self.answer = kind, key, page, answer


class ReviewsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        specs, series = ((options.get(n) or "").replace(",", " ").split() for n in ("specs", "series"))
        self.keys = list(dict.fromkeys(("spec", s) for s in specs) if specs else dict.fromkeys(("series", s) for s in series))
        self.most, self.base, self.year = int(options.get("most", MOST)), options.get("base", BASE), options.get("year", "0")
        self.pause = float(options.get("pause", 1.0))
        self.allowed: dict[str, set] = {}
        self.visit: bool | None = None
        self.parts: list[str] = []

    def _fits(self, **values) -> bool:
        return all(v in self.allowed.get(n, {v}) for n, v in values.items())

    def _ask(self, kind: str, key: str, page: int) -> tuple[str | None, str | None]:
        return asked(kind, key, page, self.base, self.year, http_get, lambda s: time.sleep(self.pause * s))

    def partitions(self) -> list[InputPartition]:
        keys = [(k, i) for k, i in self.keys if self._fits(kind=k, id=i)]
        with ThreadPoolExecutor(AT_ONCE) as pool:
            first = list(pool.map(lambda k: self._ask(*k, 1), keys))
        out = []
        for (kind, key), answer in zip(keys, first, strict=True):
            pages = range(1, max(1, min(self.most, pagecount(answer[0]))) + 1)
            out += [Page(kind, key, p, answer if p == 1 else None) for p in pages if self._fits(page=p)]
        return out

    def read(self, partition: Page) -> Iterator[tuple]:
        answer = partition.answer or self._ask(partition.kind, partition.key, partition.page)
        for row in rows_of(partition.kind, partition.key, partition.page, *answer):
            if (self.visit is None or row[9] == self.visit) and all(row[5] is not None and p in row[5] for p in self.parts):
                yield row


def _visits(f: Filter) -> bool | None:
    """What a condition on ``visit`` asks for; null for other conditions."""
    if isinstance(f, Not):
        inner = _visits(f.child)
        return None if inner is None else not inner
    return f.value if isinstance(f, EqualTo) and f.attribute == ("visit",) else None


class PushingReader(ReviewsReader):
    """A reader that takes over conditions; the engine only allows this where their pushdown is enabled."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, EqualTo | In) and name in ("kind", "id", "page"):
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.allowed[name] = self.allowed.get(name, values) & values
            elif self.visit is None and (visit := _visits(f)) is not None:
                self.visit = visit
            elif isinstance(f, StringContains) and name == "specname":
                self.parts.append(f.value)
            else:
                yield f
