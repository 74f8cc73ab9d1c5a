"""Pages as a data source: URLs in parallel, retries, failures as rows."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from specloom.session import settled

#: Fixed values. Answers that are asked for again, times to try, seconds to wait (times the try).
AGAIN = frozenset({429, 500, 502, 503, 504})
TRIES, BACKOFF = 4, 1.5
SCHEMA = "url string, status int, html string, error string"

Fetch = Callable[[str], tuple[int, str]]


def http_get(url: str, timeout: float = 20.0) -> tuple[int, str]:
    request = urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, ""


def fetched(url: str, fetch: Fetch = http_get, wait: Callable[[float], None] = time.sleep) -> tuple[str, int | None, str | None, str | None]:
    """(url, status, html, error): 404 is an answer; others over 399 are errors after the last try."""
    error = None
    for n in range(TRIES):
        try:
            status, html = fetch(url)
            if status == 404 or status < 400:
                return url, status, html, None
            error = f"HTTP {status}"
            if status not in AGAIN:
                return url, status, None, error
        except OSError as e:
            error = str(e)
        if n + 1 < TRIES:
            wait(BACKOFF * (n + 1))
    return url, None, None, error


def fetch_all(urls: DataFrame, fetch: Fetch = http_get, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """SCHEMA rows for the distinct ``url`` of a DataFrame, fetched by the executors. Filter before this, not after."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([fetched(u, fetch, wait) for u in batch["url"]], columns=["url", "status", "html", "error"])

    return urls.select("url").where(F.col("url").isNotNull()).distinct().mapInPandas(run, SCHEMA)


class PagesSource(DataSource):
    """``spark.read.format("specloom_pages").option("urls", "a b c")``: one partition per URL."""

    @classmethod
    def name(cls) -> str:
        return "specloom_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _PagesReader(self.options.get("urls", "").split())


class _PagesReader(DataSourceReader):
    def __init__(self, urls: list[str]):
        self.urls = list(dict.fromkeys(urls))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition):
        yield fetched(partition.value)


def batches_of(ids: DataFrame, position: str, value: str, size: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """(by, batch, ids): values in order, ``size`` to a request, for each of ``by``."""
    rows = ids.groupBy(*by, F.floor(F.col(position) / size).alias("batch"))
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct(position, value))), lambda x: x[value]).alias("ids"))


def tombstones(pages: DataFrame) -> DataFrame:
    """Pages with an ``error`` column that also names pages that are gone."""
    return pages.withColumn("error", F.coalesce("error", F.when(F.col("status") == 404, "404")))


#: Fixed values. A charset that pages name in their first letters, and where it is looked for.
OTHER_CHARSET, WITHIN = "windows-1251", 5000


def sniffed(raw: bytes) -> str:
    """A page's text: in OTHER_CHARSET if its beginning names that, else in UTF-8; what does not decode is left out."""
    return raw.decode(OTHER_CHARSET if OTHER_CHARSET.encode() in raw[:WITHIN].lower() else "utf-8", "ignore")


def sniffing_get(url: str, timeout: float = 30.0) -> tuple[int, str]:
    """As ``http_get``, the charset told by the page and not by the answer's head."""
    request = urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status, sniffed(r.read())
    except urllib.error.HTTPError as e:
        return e.code, ""


def crawled(lists: DataFrame, fetch: Fetch = sniffing_get, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """SCHEMA rows of the numbered pages below each ``url`` of ``lists`` (``.../model/``) that its page links to, each once.

    Lists that fail are rows with an error. Both steps run on the executors; the addresses are dealt out between them.
    """
    first = settled(fetch_all(lists, fetch, wait))
    path = F.concat(F.parse_url("url", F.lit("PATH")))
    found = F.regexp_extract_all("html", F.concat(F.lit("\\Q"), path, F.lit("\\E(\\d+)/")), F.lit(1))
    links = first.where("html is not null").select(F.explode(F.transform(F.array_distinct(found), lambda i: F.concat(F.col("url"), i, F.lit("/")))).alias("url"))
    failed = first.where(F.col("html").isNull() | (F.col("status") == 404)).select("url", "status", F.lit(None).cast("string").alias("html"), F.coalesce("error", F.lit("HTTP 404")).alias("error"))
    return failed.union(fetch_all(links.repartition("url"), fetch, wait))
