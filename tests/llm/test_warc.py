import base64
import gzip
import hashlib

import duckdb
import pytest
from specloom.llm import warc
from specloom.llm.common import new_folder

PAGES = "page_id long, url string, html string, key string, file string"


def make(spark, rows):
    return spark.createDataFrame([(p, u, h, "clash", "clash") for p, u, h in rows], PAGES)


def want(rows, least=0):
    out = []
    for p, _, h in rows:
        raw = (h or "").encode()
        tops = [q for q, _, x in rows if (x or "") == (h or "") and q is not None] if len(raw) >= least else []
        top = max(tops, default=p)
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((str(p), len(raw), digest, "response" if p == top else "revisit", None if p == top else top))
    return sorted(out)


def rows_of(df):
    return sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


ROWS = [(i, f"https://www.site{i % 7}.example.org:80/p/{i % 11}?q={i}#top", f"<p>page {i % 40} é</p>" * (1 + i % 3)) for i in range(300)]
ODD = [(1000, None, None), (1001, "", ""), (1002, "http://[bad", "x"), (None, "http://a.example/", "x"), (1003, "http://a.example/\r\nX: y", "long " * 100_000), (5, ROWS[5][1], ROWS[5][2])]


def test_round_trip(spark):
    rows = ROWS + ODD
    assert rows_of(warc.round_trip(make(spark, rows), new_folder(spark, "t"))) == want(rows)


def test_small_blocks_shards_and_files(spark, monkeypatch):
    monkeypatch.setattr(warc, "LINES", 3)
    monkeypatch.setattr(warc, "SHARD_LINES", 20)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    rows = ROWS + [(2000 + i, "http://hot.example/", f"hot {i}") for i in range(200)]
    folder = new_folder(spark, "t")
    assert rows_of(warc.round_trip(make(spark, rows).repartition(3), folder)) == want(rows)
    captures = spark.read.parquet(f"{folder}/captures")
    shards = warc.index(captures, folder)
    assert len(shards) > 10
    own = warc.Lookup(folder, shards)
    assert len(list(own.captures("example,hot)/"))) == 200
    assert [r[1] for r in own.captures("example,hot)/", 2007)] == [2007]
    assert list(own.captures("example,none)/")) == [] == list(own.captures("example,hot)/", 7))


def test_records_are_plain_gzip_members():
    raw = warc.record(7, "http://a.example/é", b"payload", 7) + warc.record(6, "http://b.example/", b"payload", 7)
    text = gzip.decompress(raw).decode()
    assert text.count("WARC/1.1\r\n") == 2 and text.count("payload\r\n\r\n") == 1
    response = text.split("WARC-Record-ID: ")[1].split("\r\n")[0]
    assert f"WARC-Refers-To: {response}" in text
    with pytest.raises(ValueError):
        warc.parse(gzip.compress(b"HTTP/1.1 200 OK\r\n\r\n"))


def test_small_payloads_stay_responses(spark):
    rows = [(1, "u", "tiny"), (2, "v", "tiny"), (3, "w", "large payload"), (4, "x", "large payload")]
    found = warc.with_responses(make(spark, rows), least=10).collect()
    assert {r.page_id: r.response_id for r in found} == {1: None, 2: None, 3: 4, 4: None}


def test_payloads_come_back(spark):
    folder = new_folder(spark, "t")
    captures = warc.write(make(spark, ROWS), folder)
    every = warc.read(captures, folder, bodies=True).collect()
    assert len(every) == len(ROWS) and {r.record_type for r in every} == {"response", "revisit"}
    assert sorted((str(r.page_id), r.payload.decode()) for r in every) == sorted((str(p), h or "") for p, _, h in ROWS)
    back = {r.page_id: r.payload for r in every if r.record_type == "response"}
    assert all(back[p].decode() == h for p, _, h in ROWS if p in back) and len(back) == len({h for _, _, h in ROWS})
    warc.remove(folder)


def test_empty_table(spark):
    assert warc.round_trip(make(spark, []), new_folder(spark, "t")).count() == 0


def test_surt():
    assert warc.surt("https://www.A.example.com:8080/Path?x=1#frag") == "com,example,a)/path?x=1"
    assert warc.surt(None) == ")/"


def test_sql_agrees():
    con = duckdb.connect()
    con.execute("create table pages as select * from (values (1, 'a'), (2, 'a'), (3, null), (4, 'ü')) t(page_id, html)")
    got = sorted((str(a), b, c, d, e) for a, b, c, d, e in con.sql(warc.ORACLE).fetchall())
    assert got == want([(1, None, "a"), (2, None, "a"), (3, None, None), (4, None, "ü")])
