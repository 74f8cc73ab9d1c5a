import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F
from specloom.sources import reviews


def review(n, visit=False):
    extra = [{"name": "探店时间", "value": "x"}] if visit else [{"name": "购车时间"}]
    return {"showId": f"01{n}", "specname": f"{2020 + n % 5}款 {'豪华' if n % 2 else '舒适'}型", "posttime": "2025-01-02", "carOwnershipPeriod": "3个月", "distance": n, "exinfolist": extra, "contents": [{"structuredname": "最不满意", "content": f"c{n}"}]}


@pytest.fixture
def server():
    asked = Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            at = urlparse(self.path)
            q = {k: v[0] for k, v in parse_qs(at.query).items()}
            kind = "spec" if at.path == "/pc/spec/list" else "series"
            key, page = q["specId" if kind == "spec" else "seriesId"], int(q["pageIndex"])
            asked[kind, key, page] += 1
            if (key, page) == ("7", 2):
                self.send_response(500)
                self.end_headers()
                return
            pages = {"7": 3, "8": 25, "9": 0}.get(key, 1)
            rows = [review(page * 20 + i, visit=i == 0) for i in range(3)] if pages else []
            body = "oops" if key == "6" else json.dumps({"result": {"seriesname": "x", "rowcount": 3 * pages, "pagecount": pages, "list": rows}}, ensure_ascii=False)
            self.send_response(200)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *a):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", asked
    http.shutdown()


def load(spark, base, **options):
    spark.dataSource.register(reviews.ReviewsSource)
    reader = spark.read.format("specloom_reviews").option("base", base).option("pause", "0")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def test_pages_are_partitions_and_failures_rows(spark, server):
    base, asked = server
    df = load(spark, base, series="7 8,9 6", most="4")
    rows = df.collect()
    by = Counter((r.id, r.page) for r in rows)
    assert by == {("7", 1): 3, ("7", 2): 1, ("7", 3): 3, ("8", 1): 3, ("8", 2): 3, ("8", 3): 3, ("8", 4): 3, ("6", 1): 1}
    assert {(r.id, r.page, r.error) for r in rows if r.error} == {("7", 2, "HTTP 500"), ("6", 1, "no list of reviews")}
    assert df.rdd.getNumPartitions() == 3 + 4 + 1 + 1
    one = next(r for r in rows if r.id == "8" and r.page == 2 and r.pos == 1)
    assert (one.show_id, one.owned, one.distance, one.visit, one.sections[0].text) == ("0141", "3个月", "41", False, "c41")


def test_first_pages_are_asked_once_and_specs_win(spark, server):
    base, asked = server
    assert len(load(spark, base, specs="8", series="7", most="2").collect()) == 6
    assert set(asked) == {("spec", "8", 1), ("spec", "8", 2)} and asked["spec", "8", 2] == 1


def test_conditions_spare_requests_and_rows(spark, server):
    base, asked = server
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = load(spark, base, series="7 8", pushdown="true")
        rows = df.where((F.col("id") == "8") & (F.col("page") == 3) & ~F.col("visit") & F.contains("specname", F.lit("豪华"))).collect()
        assert [(r.page, r.pos) for r in rows] == [(3, 1)]
        assert ("series", "7", 1) not in asked and set(asked) == {("series", "8", 1), ("series", "8", 3)}
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


def test_table_of_keys_gives_what_the_source_gives(spark, server, tmp_path):
    base, asked = server
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    keys = spark.createDataFrame([("series", "7"), ("series", "8"), ("series", "8"), ("spec", "5"), ("series", "9"), ("series", "6")], "kind string, id string")
    rows = reviews.fetch_reviews(keys, most=3, base=base, wait=lambda s: None)
    by = Counter((r.kind, r.id, r.page) for r in rows.collect())
    assert by == {("series", "7", 1): 3, ("series", "7", 2): 1, ("series", "7", 3): 3, ("series", "8", 1): 3, ("series", "8", 2): 3, ("series", "8", 3): 3, ("spec", "5", 1): 3, ("series", "6", 1): 1}
    assert asked["series", "8", 1] == 1 and asked["series", "7", 2] >= 4


def test_odd_answers():
    assert reviews.rows_of("series", "1", 1, None)[0][-1] == "no list of reviews"
    assert reviews.rows_of("series", "1", 1, '{"result": {"list": null}}') == []
    assert reviews.rows_of("series", "1", 1, '{"result": {"list": [{"exinfolist": null, "contents": null, "distance": 5}]}}')[0][8:11] == ("5", False, [])


def test_numbered_pages_are_crawled_from_lists(spark, tmp_path):
    from specloom.operators import reviews as operators
    from specloom.sources import web

    spark.sparkContext.setCheckpointDir(f"file://{tmp_path}")
    list_page = '<meta charset=windows-1251><a href="/r/byd/x/12/">a</a><a href="/r/byd/x/12/">a</a><a href="/r/byd/x/7/?p">b</a><a href="/r/byd/y/9/">c</a>'

    def fetch(url):
        if url.endswith("/gone/"):
            return 404, ""
        if url.endswith("/7/"):
            raise TimeoutError("late")
        return 200, list_page if url.endswith("/x/") else "x Характеристики 1.5 Недостатки шум Поломки нет Оценка 5 Год выпуска 2020 текст Комментарии z"

    lists = spark.createDataFrame([("http://h/r/byd/x/",), ("http://h/r/byd/gone/",)], "url string")
    rows = {r.url: r for r in web.crawled(lists, fetch, lambda s: None).collect()}
    assert {u: (r.status, r.error) for u, r in rows.items()} == {"http://h/r/byd/gone/": (404, "HTTP 404"), "http://h/r/byd/x/12/": (200, None), "http://h/r/byd/x/7/": (None, "late")}
    text = spark.createDataFrame([(rows["http://h/r/byd/x/12/"].html,), ("nothing",)], "t string").select(operators.page_opinions(F.col("t")).alias("o"), operators.page_body(F.col("t")).alias("b")).collect()
    assert (text[0].o.minus, text[0].o.broken, text[0].b) == ("шум", "нет", "Год выпуска 2020 текст ") and (text[1].o.spec, text[1].o.minus, text[1].b) == ("", None, "")
    assert web.sniffed("<meta charset=Windows-1251>шум".encode("cp1251")).endswith("шум") and web.sniffed("шум".encode() + b"\xff") == "шум"


def test_complaint_report_orders_and_bounds(spark):
    from specloom.operators import reviews as operators

    rows = [(i, f"{'x' * 60}刹车 有点 异响\n{'y' * 60}大灯 暗", f"trim {i} with a very long name", "1y") for i in range(20)] + [(30, "没有 异响", "t", None), (31, None, None, None), (32, "车灯", None, "2y")]
    df = spark.createDataFrame(rows, "k int, body string, trim string, owned string")
    found = operators.complaint_report(df, "k", "body", operators.review_meta(F.col("trim"), F.col("owned")), "k", operators.CATEGORIES | {"extra": "y{5}"}).collect()
    heads = sorted({(r.rank, r.category, r.reviews) for r in found})
    assert heads == [(1, "lights", 21), (2, "rattle", 20), (3, "brake", 20), (4, "extra", 20)]
    assert sum(r.category == "lights" for r in found) == 14 and all(r.k == r.place - 1 for r in found)
    one = next(r for r in found if r.category == "rattle" and r.k == 0)
    assert one.meta == "trim 0 with a very lon/1y" and "\n" not in one.snippets and "异响" in one.snippets
    lines = operators.report_lines(spark.createDataFrame(found), "k").orderBy("rank", "place").collect()
    assert lines[0].line == "#### lights: 21 reviews" and lines[1].line.startswith("  0 trim 0")
    assert operators.complaint_report(df.limit(0), "k", "body", F.lit("m"), "k").count() == 0
