"""What fails only on larger or odd tables: plans and bounds that small ones do not show."""

import random
import re

from pyspark.sql import functions as F
from specloom.functions import dom
from specloom.operators import issues, reviews, specs
from specloom.plans import models, page_queries, queries  # noqa: F401  they register themselves

from tests.oracle import compare, connection

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_specification_maps_are_shuffled(spark):
    trims = spark.createDataFrame([(1, 0, 2021, "a", "2024-1", 9, True)], "trim_id long, pos long, year int, name string, launched string, price int, on_sale boolean")
    maps = spark.createDataFrame([(1, {"车身/整备质量(kg)": "1500"})], "trim_id long, spec map<string,string>")
    rows = models.keyed(trims, maps)
    assert "Broadcast" not in plan(rows)
    assert rows.select("weight").first()[0] == 1500


def test_trees_have_more_rows_than_recursion_allows(spark):
    spark.conf.set("spark.sql.cteRecursionRowLimit", "10")
    try:
        tree = '{"config":[{"category_name":"main","config_list":[{"name":"a","value":"1","child_config_list":[{"name":"b","value":"2"}]}]}]}'
        df = spark.range(20).select(F.col("id").alias("trim_id"), F.parse_json(F.lit(tree)).alias("tree"))
        assert specs.flattened(spark, df).count() == 40
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_references_without_semicolon_count_in_sql_too(spark, tmp_path):
    page = "<html><head><title> A&amp;B &amp</title></head><body><h1>x &lt;&lt y&quot</h1><a href='x'>y</a></body></html>"
    spark.createDataFrame([(1, "u", page), (2, "u", "<title></title>")], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/p")
    [part] = [p for p in (tmp_path / "p").iterdir() if p.name.endswith(".parquet")]
    part.rename(tmp_path / "pages.parquet")
    compare(spark, queries.QUERIES["html_extract"], queries.SQL["html_extract"], str(tmp_path))


def test_every_listing_has_litres(spark):
    compare(spark, queries.QUERIES["listing_rows"], queries.SQL["listing_rows"], SF)
    con = connection(SF)
    assert con.execute(f"select count(*) from ({queries.SQL['listing_rows']}) where error is null and engine_l is null").fetchone() == (0,)


def test_issues_of_a_key_are_shown_once(spark):
    kind = "array<struct<text:string,source:string,more_sources:array<string>,review_car:string>>"
    records = spark.createDataFrame([(1, []), (2, [("own", None, None, None)]), (3, None), (4, [])], f"slug int, known_issues {kind}")
    keys = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "slug int, key int")
    raw = spark.createDataFrame([(7, [("a", 1, ["s"], None), ("b", 1, ["s"], None)])], "key int, issues array<struct<text:string,count:int,sources:array<string>,review_car:string>>")
    out = issues.merged_where_none(records, keys, raw, lambda known: F.array_join(F.transform(known, lambda i: i["text"]), ";"))
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a;b"), (2, "own"), (3, None), (4, "")]


def test_siblings_are_linked_when_made():
    first, second = [e for e in dom.tree("<ul><li>a</li> x <!-- c --><li>b<br>y</li></ul>").walk() if e.tag == "li"]
    assert first.after is second and first.following() is second and second.after is None


def test_few_components_go_to_their_records(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        own = spark.createDataFrame([("r", "m", 0, "t", "s")], "slug string, model string, pos int, text string, source string")
        linked = spark.createDataFrame([("r", "m", "engine", "e")], "slug string, model string, kind string, id string")
        shared = spark.createDataFrame([("engine", "e", 0, "t2", "s", ["m"])], "kind string, id string, pos int, text string, source string, reported_in array<string>")
        labels = spark.createDataFrame([("engine", "e", "E")], "kind string, id string, label string")
        out = issues.inherited(own, linked, shared, labels)
        assert "BroadcastHashJoin" in plan(out) and "SortMergeJoin" not in plan(out)
        assert out.count() == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_links_are_brought_to_their_records_once(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(queries.QUERIES["issue_inheritance"](spark, SF))
        assert "HashAggregate" not in text and text.count("SortMergeJoin") == 1  # tables of keys hold memory that sorts beside them need
        assert re.findall(r"hashpartitioning\((\w+)#\w+, \d+\)", text).count("slug") == 1 and not re.search(r"hashpartitioning\(slug#\w+, source", text)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_inheritance_is_the_same_for_few_and_many_components(spark, monkeypatch):
    own = spark.createDataFrame([("r", "m", 0, "t", "s"), ("q", "m", 0, None, "s"), (None, "m", 0, "t", "s")], "slug string, model string, pos int, text string, source string")
    linked = spark.createDataFrame([("r", "m", "engine", "e"), ("r", "m", "engine", "e"), ("q", "o", "transmission", "g"), ("q", "o", None, None), ("q", "o", "engine", "unknown"), ("z", None, "engine", "e")], "slug string, model string, kind string, id string")
    shared = spark.createDataFrame([("engine", "e", 0, "t2", "s", ["m"]), ("engine", "e", 1, "t", "s", ["m"]), ("transmission", "g", 0, None, "s", []), ("transmission", "g", 1, "t3", None, None)], "kind string, id string, pos int, text string, source string, reported_in array<string>")
    labels = spark.createDataFrame([("engine", "e", "E"), ("transmission", "g", "G")], "kind string, id string, label string")
    told = lambda: sorted(map(repr, issues.inherited(own, linked, shared, labels).collect()))
    few = told()
    monkeypatch.setattr(issues, "BROADCAST_ISSUES", 0)
    assert few == told() and len(few) == 7
    assert few.count("Row(slug='r', text='t2', source='s', rank=1, pos=0, component='e', origin='двигатель E, отзыв по m (эта модель)', own_model=True)") == 1


def test_complaints_carry_what_stands_beside(spark):
    df = spark.createDataFrame([(1, "xx noise yy", "m", 5), (2, "quiet", "n", 6), (None, "noise", "o", 7)], "k int, body string, trim string, at int")
    assert [tuple(r) for r in reviews.complaints(df.where("k = 1"), "k", "body", {"n": "noise"}, beside=("trim",)).collect()] == [(1, "n", 0, "xx noise yy", "m")]
    report = reviews.complaint_report(df, "k", "body", F.col("trim"), "at", {"n": "noise"})
    assert [tuple(r) for r in report.collect()] == [(1, "n", 1, 1, 1, "m", "xx noise yy")]


def test_plain_pages_read_the_same_by_one_pattern():
    labels, item = {"A": "a", "B": "b"}, "i"
    pick = random.Random(7)
    parts = ['<div class="x i">', "</div>", '<label class="i-name">', "</label>", '<b id="1" class="i-value">', "</b>", "A", " B ", "x > y", "<p>", "</p>", "<br>", "<li>", "<title>t</title>", "<h1>", "</h1>", "<script>A 1</script>", "</i>", "<ul>", "</ul>", "<td>", "<style></style>", "\n"]
    odd = ["&amp;", "<!-- A -->", "<br/>", "<P>", "<script>", "<title>", "<b x>", "</b x=\"1\">", "<", "<title><b>", "<x-y>"]

    def told(own):
        return own.first("title", ""), own.first("h1"), own.text(0), own.values(), own.hits, own.tags, own.ends, own.after

    plain = 0
    for n in range(3000):
        page = "".join(pick.choice(parts + odd if n % 3 == 0 else parts) for _ in range(pick.randrange(25)))
        fast, slow = dom._Flat(labels, item), dom._Flat(labels, item)
        fast.read(page)
        slow.feed(page)
        slow.close()
        assert told(fast) == told(slow), page
        plain += dom._plain_tokens(page) is not None
    assert plain >= 2000
