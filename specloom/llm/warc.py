"""WARC archives with a two-level capture index: sorted, compressed blocks of keys under a sparse directory."""

from __future__ import annotations

import bisect
import gzip
import itertools
import json
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator
from datetime import UTC, datetime
from hashlib import sha1
from urllib.parse import urlsplit, urlunsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, settled, table

#: Index lines in a compressed block.
LINES = 1000
#: Bytes of an archive file, about, and index lines in a shard, about.
ARCHIVE_BYTES, SHARD_LINES = 64 << 20, 50_000
#: Shards at most; beyond it they grow.
MAX_SHARDS = 4096
#: The date of every record: records of equal pages are equal.
DATE = datetime(2026, 1, 1, tzinfo=UTC)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


#: First key and page of a shard, its file, and offset and size of its directory.
Shard = tuple[str, int, str, int, int]


def digest_of(payload: bytes) -> str:
    """The bare upper-case base32 SHA-1."""
    return b32encode(sha1(payload).digest()).decode()


def surt(url: str | None) -> str:
    """The sort key of a URL: its host reversed, then the rest; scheme, ``www.``, port and fragment play no part."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return f"){url}"
    rest = urlunsplit(("", "", parts.path or "/", parts.query, ""))
    return f"{','.join(reversed(host.split('.')))}){rest}".lower()


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder and the path in it, from its URI."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), urlsplit(path).path
    return fs.FileSystem.from_uri(path)


def _put(folder: str, name: str, chunks: Iterator[bytes]) -> None:
    """A file that appears whole or not at all: written under another name first."""
    store, at = _store(folder)
    store.create_dir(at, recursive=True)
    with store.open_output_stream(f"{at}/.{name}.open") as out:
        for chunk in chunks:
            out.write(chunk)
    store.move(f"{at}/.{name}.open", f"{at}/{name}")


class _Ranges:
    """Range reads from the files of a folder; the last file stays open."""

    def __init__(self, folder: str):
        self.store, self.at = _store(folder)
        self.name, self.file = None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            if self.file is not None:
                self.file.close()
            self.name, self.file = name, self.store.open_input_file(f"{self.at}/{name}")
        return self.file.read_at(length, offset)


def record(page_id, url: str | None, payload: bytes, response_id, place: str = "") -> bytes:
    """One record as a gzip member of its own; a revisit carries no payload and names the record that does."""
    revisit = response_id is not None and response_id != page_id
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + (b"" if revisit else payload)
    digest = digest_of(payload)
    own = f"{page_id}|{url}|{place}" if revisit else f"{page_id}|{digest}"
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _urn(own),
        "WARC-Date": DATE.strftime("%Y-%m-%dT%H:%M:%SZ"),
        "WARC-Target-URI": " ".join((url or "").split()),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{digest_of(body)}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(body)),
        "X-Page-ID": "" if page_id is None else str(page_id),
        "X-Payload-Length": str(len(payload)),
    }
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _urn(f"{response_id}|{digest}"), "X-Refers-To-Page-ID": str(response_id)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return gzip.compress(f"WARC/1.1\r\n{lines}\r\n".encode("utf-8", "surrogatepass") + body + b"\r\n\r\n", 3, mtime=0)


def _urn(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """The named fields and the payload of one record's gzip member."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    body = rest[: int(fields["Content-Length"])]
    if f"sha1:{digest_of(body)}" != fields["WARC-Block-Digest"]:
        raise ValueError("damaged WARC record")
    return fields, body.partition(b"\r\n\r\n")[2]


def _payload(html: Column) -> Column:
    return F.coalesce(html.cast("string"), F.lit("")).cast("binary")


def with_responses(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, payload, response_id): of equal payloads of ``least`` bytes or more, the largest page_id.

    Only digests and ids are shuffled to find it; payloads move once, by page, so copies stay spread out.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), _payload(F.col("html")).alias("payload"))
    mark = rows.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size")).where(F.col("size") >= least)
    best = settled(mark.groupBy("digest").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n")).where("n > 1"))
    turned = mark.join(best, "digest").where("not (page_id <=> response_id)").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "response_id").distinct()
    same = F.col("page_id").eqNullSafe(F.col("p")) & (F.sha1("payload") == F.col("d"))
    return rows.join(turned, same, "left").select("page_id", "url", "payload", "response_id")


def write(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes archives below ``folder`` and returns their captures: key, page_id, url, file, offset, length, type, digest.

    Each task writes files of its own, named after the attempt, so a repeated task never touches what another has
    written; only files that the captures name count. Equal page ids with equal payloads are all responses if
    theirs is the largest id. Null html is an empty payload; null urls have the key ``)/``.
    """
    rows = with_responses(pages, least)
    schema = "key string, page_id long, url string, file string, offset long, length long, type string, digest string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        stem = f"{task.partitionId():06d}-{task.taskAttemptId()}" if task else uuid.uuid4().hex
        made: list[tuple] = []

        def members(stream: Iterator[tuple], name: str) -> Iterator[bytes]:
            at = 0
            for page_id, url, payload, response_id in stream:
                member = record(page_id, url, payload, response_id, f"{name}-{len(made)}")
                kind = "revisit" if response_id is not None and response_id != page_id else "response"
                made.append((surt(url), page_id, url, name, at, len(member), kind, digest_of(payload)))
                at += len(member)
                yield member
                if at >= ARCHIVE_BYTES:
                    return

        def each() -> Iterator[tuple]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield tuple(batch.column(c)[i].as_py() for c in range(4))

        stream, number = each(), 0
        for head in stream:
            name = f"{stem}-{number:04d}.warc.gz"
            _put(f"{folder}/archive", name, members(itertools.chain([head], stream), name))
            number += 1
            columns = list(zip(*made, strict=True))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])
            made.clear()

    path = f"{folder}/captures"
    rows.mapInArrow(run, schema).write.parquet(path)
    return pages.sparkSession.read.parquet(path)


def _page(page_id) -> int:
    """What a page id sorts as: null first."""
    return -(1 << 63) if page_id is None else page_id


def index(captures: DataFrame, folder: str) -> list[Shard]:
    """Writes the capture index below ``folder`` and returns its shards, in order.

    Captures are dealt by ranges of key and id, so that a hot host spreads over shards. A shard is a file of
    compressed blocks of LINES sorted lines, then its directory: each block's first key and page, offset and length. The
    list of shards is short: one entry in SHARD_LINES captures.
    """
    n = captures.count()
    shards = min(MAX_SHARDS, n // SHARD_LINES + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}.idx" if task else f"{uuid.uuid4().hex}.idx"
        lines: list[bytes] = []
        directory: list[tuple[str, int, int, int]] = []
        at, tail = 0, b""

        def blocks() -> Iterator[bytes]:
            nonlocal at
            for batch in batches:
                columns = batch.to_pydict()
                for i in range(batch.num_rows):
                    key = columns["key"][i]
                    if not lines:
                        directory.append((key, _page(columns["page_id"][i]), at, 0))
                    lines.append(json.dumps([key, columns["page_id"][i], columns["file"][i], columns["offset"][i], columns["length"][i]]).encode())
                    if len(lines) == LINES:
                        yield from block()
            if lines:
                yield from block()

        def block() -> Iterator[bytes]:
            nonlocal at
            made = zlib.compress(b"\n".join(lines), 6)
            directory[-1] = (*directory[-1][:2], at, len(made))
            at += len(made)
            lines.clear()
            yield made

        def whole() -> Iterator[bytes]:
            nonlocal tail
            yield from blocks()
            tail = zlib.compress(json.dumps(directory).encode(), 6)
            yield tail

        _put(f"{folder}/index", name, whole())
        if directory:
            yield pa.RecordBatch.from_pydict({"first": [directory[0][0]], "page": [directory[0][1]], "file": [name], "at": [at], "size": [len(tail)]})

    made = captures.select("key", "page_id", "file", "offset", "length").repartitionByRange(shards, "key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    found = settled(made.mapInArrow(run, "first string, page long, file string, at long, size long"))
    return sorted(tuple(r) for r in found.collect())


class Lookup:
    """Finds captures: the shard, then the block by binary search in its directory, then a range read of the block."""

    def __init__(self, folder: str, shards: list[Shard]):
        self.files = _Ranges(f"{folder}/index")
        self.shards, self.firsts = shards, [(s[0], s[1]) for s in shards]
        self.directories: dict[int, tuple[list[tuple[str, int]], list[list]]] = {}
        self.blocks: dict[tuple[int, int], list[list]] = {}

    def _directory(self, s: int) -> tuple[list[tuple[str, int]], list[list]]:
        if s not in self.directories:
            name, at, size = self.shards[s][2:]
            rows = json.loads(zlib.decompress(self.files.read(name, at, size)))
            if len(self.directories) > 16:
                self.directories.clear()
            self.directories[s] = [(r[0], r[1]) for r in rows], rows
        return self.directories[s]

    def _block(self, s: int, b: int) -> list[list]:
        if (s, b) not in self.blocks:
            at, size = self._directory(s)[1][b][2:]
            if len(self.blocks) > 16:
                self.blocks.clear()
            self.blocks[s, b] = [json.loads(x) for x in zlib.decompress(self.files.read(self.shards[s][2], at, size)).split(b"\n")]
        return self.blocks[s, b]

    def captures(self, key: str, *page_id) -> Iterator[list]:
        """The captures [key, page_id, file, offset, length] of ``key``, one after the other; of one page if it is given."""
        low = (key, _page(page_id[0]) if page_id else _page(None))
        high = low if page_id else (key, 1 << 63)
        for shard in range(max(0, bisect.bisect_left(self.firsts, low) - 1), len(self.shards)):
            firsts = self._directory(shard)[0]
            if firsts[0] > high:
                return
            for b in range(max(0, bisect.bisect_left(firsts, low) - 1), len(firsts)):
                if firsts[b] > high:
                    return
                rows = self._block(shard, b)
                for i in range(bisect.bisect_left(rows, low, key=lambda r: (r[0], _page(r[1]))), len(rows)):
                    if (rows[i][0], _page(rows[i][1])) > high:
                        return
                    yield rows[i]


def shard_of(key: Column, page_id: Column, shards: list[Shard]) -> Column:
    """The number of shards that begin before a key and page."""
    steps, size = [], 1
    while size <= len(shards):
        steps.insert(0, size)
        size *= 2
    firsts = F.array(*[F.struct(F.lit(s[0]).alias("k"), F.lit(s[1]).cast("long").alias("p")) for s in shards])
    own = F.struct(key.alias("k"), F.coalesce(page_id.cast("long"), F.lit(-(1 << 63)).cast("long")).alias("p"))

    def step(at: Column, width: Column) -> Column:
        probe = F.element_at(firsts, F.least(at + width, F.lit(len(shards))))
        return F.when((at + width <= len(shards)) & (probe < own), at + width).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def find(wanted: DataFrame, folder: str, shards: list[Shard]) -> DataFrame:
    """(page_id, file, offset, length) of the captures of ``wanted`` (key, page_id), through the index.

    Lookups are dealt by shard, a hot key's by page too, and sorted, so that a task reads each of its blocks once.
    Keys come from ``surt``.
    """
    if not shards:
        return wanted.selectExpr("cast(page_id as long) page_id", "'' file", "0L offset", "0L length").limit(0)
    rows = wanted.select(F.col("page_id").cast("long").alias("page_id"), "key").distinct()
    rows = rows.withColumn("_s", shard_of(F.col("key"), F.col("page_id"), shards)).repartition("_s").sortWithinPartitions("key", "page_id").select("key", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lookup(folder, shards)
        for batch in batches:
            out = [(p, r[2], r[3], r[4]) for k, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in own.captures(k, p)]
            if out:
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "file", "offset", "length"])

    return rows.mapInArrow(run, "page_id long, file string, offset long, length long")


def read(places: DataFrame, folder: str, bodies: bool = False) -> DataFrame:
    """The records at ``places`` (file, offset, length): page_id, url, record_type, digest, bytes, refers_to and payload.

    Reads are dealt by stretches of files and go forward in each. Payloads of revisits are those of their responses,
    null if these are not among ``places``; with ``bodies`` false no payload is returned, but every response's is
    read and checked against its digest. No places give no rows.
    """
    schema = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long" + (", payload binary" if bodies else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Ranges(f"{folder}/archive")
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                out = []
                for name, offset, length in zip(*(batch.slice(first, 256).column(c).to_pylist() for c in range(3)), strict=True):
                    fields, payload = parse(files.read(name, offset, length))
                    digest, size, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"]), fields["WARC-Type"]
                    if kind == "response":
                        digest, size = digest_of(payload), len(payload)
                        if f"sha1:{digest}" != fields["WARC-Payload-Digest"]:
                            raise ValueError("damaged payload")
                    page, other = fields["X-Page-ID"], fields.get("X-Refers-To-Page-ID")
                    out.append((int(page) if page else None, fields["WARC-Target-URI"], kind, digest, size, None if other is None else int(other), payload))
                columns = list(zip(*out, strict=True))[: 7 if bodies else 6]
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=[x.split()[0] for x in schema.split(", ")])

    stretch = F.floor(F.col("offset") / (4 << 20))
    rows = places.select("file", "offset", "length").withColumn("_s", stretch).repartition("file", "_s").sortWithinPartitions("file", "offset")
    found = rows.select("file", "offset", "length").mapInArrow(run, schema)
    if not bodies:
        return found
    found = settled(found)
    heads = found.where("record_type = 'response'").select(F.col("page_id").alias("_page"), F.col("payload").alias("_payload"))
    own = found.where("record_type = 'response'")
    again = found.where("record_type <> 'response'").drop("payload").join(heads, F.col("refers_to") == F.col("_page"), "left")
    return own.unionByName(again.select(*found.columns[:-1], F.col("_payload").alias("payload")))


def round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """Writes ``pages`` as archives with their index, looks every page up in it and reads its record back."""
    captures = write(pages, folder)
    shards = index(captures, folder)
    places = find(captures.select("key", "page_id"), folder, shards)
    return read(places, folder)


def remove(folder: str) -> None:
    """Deletes an archive's files."""
    store, at = _store(folder)
    if store.get_file_info(at).type != fs.FileType.NotFound:
        store.delete_dir(at)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = round_trip(table(spark, sf_dir, "pages"), new_folder(spark, "warc"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base 32 of SHA-1: eight times four groups of five bits.
_BASE32 = (
    "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '')"
)
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
     d AS (SELECT h, max(page_id) AS top FROM p GROUP BY h)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM p JOIN d USING (h)
"""
