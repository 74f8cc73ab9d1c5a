import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from specloom.operators import components, firsts, issues, records, reviews, specs, translate
from specloom.plans import report
from specloom.sources import files, web
from specloom.streaming import increment


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_first_wins_and_unseen_rows(spark):
    a = spark.createDataFrame([("k", 0, "a"), ("k", 1, "b"), ("m", 2, "c"), (None, 3, "d")], "key string, pos int, v string")
    assert rows(firsts.first_rows(a, ["key"], ["pos"]), "pos") == [("k", 0, "a"), ("m", 2, "c"), (None, 3, "d")]
    assert rows(firsts.first_values(a, ["key"], "pos", ["v"]).where("key = 'k'")) == [("k", "a")]
    b = spark.createDataFrame([("m", 0, "x"), ("n", 1, "y"), ("n", 2, "z")], "key string, pos int, v string")
    assert [r[2] for r in rows(firsts.appended_unseen(a.where("key is not null"), b, ["key"]), "key", "pos")] == ["a", "c", "y"]
    one = spark.createDataFrame([([1, 2], [2, 3, 3])], "a array<int>, b array<int>")
    assert one.select(firsts.unseen(F.col("a"), F.col("b"), lambda x, y: x == y)).first()[0] == [1, 2, 3, 3]


def test_trees_keep_only_the_parent_above(spark):
    tree = {"config": [{"category_name": "基本参数表", "config_list": [{"name": "动力", "value": "BEV", "child_config_list": [{"name": "电机", "value": "100", "child_config_list": [{"name": "前", "value": "50"}]}]}]}, {"category_name": "选装", "config_list": [{"name": "漆", "value": "1"}]}]}
    df = spark.createDataFrame([(7, json.dumps(tree)), (8, json.dumps({"config": []}))], "trim_id long, t string").select("trim_id", F.parse_json("t").alias("tree"))
    out = specs.flattened(spark, df, skip=["选装"])
    assert sorted(tuple(r) for r in out.select("trim_id", "path", "value").collect()) == [(7, "基本参数/动力", "BEV"), (7, "基本参数/动力>电机", "100"), (7, "基本参数/电机>前", "50")]
    assert rows(specs.spec_maps(out).select("trim_id", F.size("spec"))) == [(7, 3)]
    assert specs.wide(out, [7, 8]).count() == 3


def test_groups_ranges_slugs(spark):
    df = spark.createDataFrame([(2024, "18", "145", 0, 1, "t1", 5.0), (2024, "18", "145", 1, 2, "t2", None), (2023, None, "90", 2, 3, "t3", 7.0)], "year int, battery string, motor_kw string, pos int, trim_id int, name string, v double")
    got = rows(specs.grouped(df, ["year", "battery", "motor_kw"]), "year")
    assert [[m.trim_id for m in r[3]] for r in got] == [[3], [1, 2]]
    r = df.groupBy("year").agg(specs.value_range("v").alias("r"))
    assert rows(r.select("year", specs.shown_range(F.col("r.min"), F.col("r.max"))), "year") == [(2023, "7.0"), (2024, "5.0")]
    assert [x[1] for x in rows(specs.group_order(df.select("year", "battery", "pos"), "year", "battery"))] == [None, "18", "18"]
    code = F.lit("BYD 472")
    made = df.select(specs.slug(F.lit("byd_song"), F.col("year"), F.col("battery"), F.col("motor_kw"), code, F.lit("6at"), F.lit("电动四驱")).alias("slug"), F.lit("BYD472").alias("code"), "pos")
    assert rows(specs.without_collisions(made, "slug", "code", ["pos"]), "pos") == [("byd_song_2024_18kwh-145kw-awd", "BYD472", 0), ("byd_song_2024_18kwh-145kw-awd-byd472", "BYD472", 1), ("byd_song_2023_90kw-byd472-awd", "BYD472", 2)]


@pytest.mark.parametrize(
    ("code", "cc", "aspiration", "want"),
    [("BYD 472QA", 1498, "NA", "byd_472qa_1.5"), ("JL486ZQ", None, "turbo", "byd_jl486zq_2.0t"), ("XX9", None, "NA", "byd_xx9"), ("SQR", 1998, "turbo", "byd_sqr_2.0t")],
)
def test_engine_ids(spark, code, cc, aspiration, want):
    df = spark.createDataFrame([(code, cc, aspiration)], "code string, cc int, a string")
    assert df.select(components.engine_id(F.lit("byd"), F.col("code"), F.col("cc"), F.col("a"))).first()[0] == want


def test_fingerprints_need_every_part(spark):
    df = spark.createDataFrame([("PHEV_series_parallel", "JLH", [100, None, 0], "E-CVT"), ("EREV", "X", [90, 75], "Редуктор 1 ст."), ("BEV", "X", [1], "E-CVT"), ("EREV", None, [1], "E-CVT"), ("EREV", "X", [0], "E-CVT"), ("EREV", "X", [1], "7DCT")], "k string, c string, kw array<int>, g string")
    got = [r[0] for r in df.select(components.fingerprint(F.lit("geely"), F.col("k"), F.col("c"), F.col("kw"), F.col("g"))).collect()]
    assert got == ["geely_phev_jlh_m100", "geely_erev_x_m90-75", None, None, None, None]
    assert rows(df.limit(1).select(components.brand(F.lit("deepal_s7_x")), components.family(F.lit("deepal_s7_x")))) == [("changan", "deepal_s7")]


def test_links_users_sets_and_upsert(spark):
    docs = spark.createDataFrame([("b", {"engine": "e1", "transmission": None}, 2), ("a", {"engine": "e1"}, None)], "slug string, components map<string,string>, kw int")
    linked = components.links(docs)
    assert rows(components.used_in(linked)) == [("engine", "e1", ["a", "b"])]
    assert rows(components.value_sets(linked, docs, ["kw"])) == [("engine", "e1", [2])]
    old = spark.createDataFrame([("engine", "e1", "old", ["i"], {"a": "1", "b": "1"}), ("engine", "e0", "alone", None, None)], "kind string, id string, name string, known_issues array<string>, sources map<string,string>")
    new = spark.createDataFrame([("engine", "e1", "new", None, {"a": "2"}), ("engine", "e2", "fresh", None, None)], "kind string, id string, name string, known_issues array<string>, sources map<string,string>")
    got = {r.id: r for r in components.upserted(old, new).collect()}
    assert (got["e1"].name, got["e1"].known_issues, got["e1"].sources) == ("new", ["i"], {"a": "2", "b": "1"})
    assert got["e0"].name == "alone" and got["e2"].name == "fresh"
    picked = docs.select("slug", components.assigned([(F.col("kw") > 1, F.lit("dm5"), F.lit(None)), (F.lit(True), F.lit(None), F.lit("BEV"))]).alias("x"))
    assert rows(picked.select("slug", "x.id", "x.reason"), "slug") == [("a", None, "BEV"), ("b", "dm5", None)]


ISSUE = "array<struct<text:string,source:string>>"


def test_inheritance_order_provenance_and_repeats(spark):
    own = spark.createDataFrame([("r1", "Song", 0, "t1", "s1")], "slug string, model string, pos int, text string, source string")
    linked = spark.createDataFrame([("r1", "Song", "transmission", "g"), ("r1", "Song", "engine", "e"), ("r2", "Han", "engine", "e")], "slug string, model string, kind string, id string")
    shared = spark.createDataFrame([("engine", "e", 0, "t1", "s1", ["Song"]), ("engine", "e", 1, "t2", "s1", ["Song", "Qin"]), ("transmission", "g", 0, "t2", "s1", None), ("transmission", "g", 1, "t3", "s3", None)], "kind string, id string, pos int, text string, source string, reported_in array<string>")
    labels = spark.createDataFrame([("engine", "e", "472QA"), ("transmission", "g", "E-CVT")], "kind string, id string, label string")
    got = rows(issues.inherited(own, linked, shared, labels).select("slug", "text", "component", "origin", "own_model"), "slug", "text")
    assert got == [
        ("r1", "t1", None, "модель", True), ("r1", "t2", "e", "двигатель 472QA, отзыв по Song, Qin (эта модель)", True), ("r1", "t3", "g", "коробка E-CVT, отзыв по неизвестно", False),
        ("r2", "t1", "e", "двигатель 472QA, отзыв по Song", False), ("r2", "t2", "e", "двигатель 472QA, отзыв по Song, Qin", False),
    ]


def test_raw_issues_binding_scopes_and_moves(spark):
    raw = spark.createDataFrame([("k", [("a", ["u1", "u2"], "Song 2021–2022", None), ("b", ["u3"], None, 5)])], "key string, issues array<struct<text:string,sources:array<string>,review_car:string,count:int>>")
    flat = issues.from_reviews(raw)
    assert [(r.source, r.more_sources, r["count"]) for r in flat.orderBy("pos").collect()] == [("u1", ["u2"], 2), ("u3", None, 5)]
    groups = spark.createDataFrame([("k", 2020), ("k", 2022), ("x", 2022)], "key string, year int")
    assert rows(issues.bound(flat, groups).select("text", "year")) == [("a", 2022)]
    by_rule = issues.bound(flat, groups, F.when(F.col("pos") == 1, F.col("year") == 2020)).select("text", "year")
    assert rows(by_rule, "text") == [("a", 2022), ("b", 2020)]
    few = flat.select("text", "source", F.lit("r").alias("slug"))
    scopes = spark.createDataFrame([("u1", "a", "engine", True), ("u3", "b", "transmission", True)], "source string, text string, scope string, move boolean")
    linked = spark.createDataFrame([("r", "engine", "e")], "slug string, kind string, id string")
    goes, stays = issues.moved(issues.scoped(few, scopes), linked)
    assert rows(goes.select("text", "component")) == [("a", "e")] and rows(stays.select("text", "scope_note")) == [("b", "no component")]
    with pytest.raises(PySparkException, match="issue without scope"):
        issues.scoped(few, scopes.limit(1)).collect()


def test_consolidation_keeps_order(spark):
    df = spark.createDataFrame([("engine", "e", "s", "t", 0, None, None, "A"), ("engine", "e", "s", "t", 1, ["s", "x"], "car", "B"), ("engine", "e", "s", "t", 2, ["x", "y"], "car2", "A")], "scope string, component string, source string, text string, pos int, more_sources array<string>, review_car string, model string")
    r = issues.consolidated(df).first()
    assert (r.more_sources, r.reported_in) == (["x", "y"], ["A", "B"])


def test_record_merges(spark):
    new = spark.createDataFrame([(1, "n", {"a": "new", "b": "new"}), (2, "n2", None)], "k int, name string, sources map<string,string>")
    old = spark.createDataFrame([(1, "o", {"a": "old"})], "k int, name string, sources map<string,string>")
    assert rows(records.merged(new, old, ["k"], ["name"], ["sources"]), "k") == [(1, "o", {"a": "old", "b": "new"}), (2, "n2", {})]
    one = spark.range(1).select(records.notes(F.lit("old | gone"), F.lit("new")), records.notes(F.lit(None).cast("string"), F.lit("new")), records.verification(F.lit(1), F.lit(None).cast("int")), records.verification(F.lit(1)))
    assert rows(one) == [("old | new", "new", "partial", "verified")]
    docs = spark.createDataFrame([("a", None, 1), ("b", "a", 2), ("c", "zz", 3)], "slug string, copy_of string, v int")
    assert rows(records.synced_copies(docs, "slug", "copy_of", ["v"]), "slug") == [("a", None, 1), ("b", "a", 1), ("c", "zz", 3)]
    groups = spark.createDataFrame([("g", [9, 3, 1]), ("h", [8])], "g string, ids array<int>")
    known = spark.createDataFrame([(1, "one"), (3, "three")], "id int, name string")
    assert rows(records.by_first_match(groups, "ids", known, "id", ["g"], ["name"]).select("g", "name"), "g") == [("g", "three"), ("h", None)]
    names = spark.createDataFrame([("view_abc",), ("view_abd",)], "name string")
    assert rows(records.unique_prefix(spark.createDataFrame([("view_abc",)], "p string"), "p", names, "name")) == [("view_abc", "view_abc")]
    with pytest.raises(PySparkException, match="not one match"):
        records.unique_prefix(spark.createDataFrame([("view_",)], "p string"), "p", names, "name").collect()


def test_review_blocks_and_complaints(spark):
    block = "== http://a | Song 2023 | post 2024-01-02 | own 1 year | 5000 km\n  [minus] the engine hums, the engine hums loudly in the cold morning\n  [plus] good"
    b = reviews.blocks(spark.createDataFrame([(block,)], "value string")).first()
    assert (b.url, b.spec, b.posted, b.owned, b.distance) == ("http://a", "Song 2023", "2024-01-02", "1 year", "5000 km")
    assert [(s.name, s.text[:4]) for s in b.sections] == [("minus", "the "), ("plus", "good")]
    filler = "word " * 30
    texts = [(1, f"{filler}noise here {filler}noise here {filler}"), (2, f"{filler}not any noise here {filler}"), (3, "quiet"), (4, None)]
    df = spark.createDataFrame(texts, "id int, text string")
    found = reviews.complaints(df, "id", "text", {"sound": "noise", "it's": "quiet"}, negation=r"\bnot\b")
    assert [(r.id, r.category, r.place) for r in found.orderBy("id", "place").collect()] == [(1, "sound", 0), (3, "it's", 0)]
    assert rows(reviews.category_counts(found, "id")) == [("it's", 1), ("sound", 1)]
    cut = spark.range(1).select(reviews.between(F.lit("a LEAST: bad thing MOST: good"), "LEAST:", "MOST:"), reviews.between(F.lit("none"), "LEAST:", "MOST:"))
    assert rows(cut) == [("bad thing", None)]


def test_translation(spark):
    docs = spark.createDataFrame([("батарея 5", ["шум", "ok"]), ("шум", None)], "name string, notes array<string>")
    wanted = translate.texts(docs, {"name": F.col("name"), "notes": F.col("notes")})
    assert rows(wanted.select("text", "kind"), "text") == [("батарея 5", "name"), ("шум", "name")]
    phrases = spark.createDataFrame([("шум", "noise")], "source string, target string")
    fragments = spark.createDataFrame([(0, "бат", "x", ["name"]), (1, "батарея", "battery", ["name"])], "pos int, source string, target string, kinds array<string>")
    done = translate.checked(translate.translated(wanted, phrases, fragments))
    assert rows(done.select("text", "result", "method", "problems"), "text") == [("батарея 5", "battery 5", "fragments", []), ("шум", "noise", "phrase", [])]
    with pytest.raises(PySparkException, match="phrase twice"):
        translate.translated(wanted, phrases.union(phrases), fragments).collect()
    old = spark.createDataFrame([("gone", "x"), (done.first().key, "y")], "key string, result string")
    assert sorted(r.status for r in translate.kept_stale(old, done.select("key", "result")).collect()) == ["ok", "ok", "stale"]


def test_coverage_and_gate(spark):
    df = spark.createDataFrame([("a", 2020), ("a", 2021), ("b", 2019)], "f string, y int")
    names = spark.createDataFrame([("a",), ("c",)], "name string")
    assert rows(report.coverage(df, "f", "y", [2020, 2021], names), "f") == [("a", 1, 1, 2), ("c", 0, 0, 0)]
    families = spark.createDataFrame([("a",)], "p string")
    assert rows(report.unmatched(df, "f", families, "p").select("f")) == [("b",)]
    assert report.gate({"records": df}, {"records": df.where("f = 'a'")}, {"records": ["f"]}, {"resolved": (5, 4), "more": (1, 2)}) == ["records: 1 lost", "resolved: 5 to 4"]


def test_files(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "b_1.json").write_text('{"w": {"min": 1, "max": 2}, "sources": {"a": "x"}}')
    (tmp_path / "docs" / "a_2.json").write_text('{"w": 3,\n "sources": null}')
    docs = files.json_documents(spark, str(tmp_path / "docs"), "w variant, sources map<string,string>")
    assert rows(docs.select("slug", files.split_union(F.col("w")).alias("r")).select("slug", "r.min", "r.max"), "slug") == [("a_2", 3.0, 3.0), ("b_1", 1.0, 2.0)]
    (tmp_path / "t.txt").write_text("head\n== one\n x\n== two")
    assert rows(files.text_blocks(spark, str(tmp_path / "t.txt")).select("pos", "value"), "pos") == [(0, "one\n x"), (1, "two")]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "1").write_bytes("шум".encode("cp1251"))
    (tmp_path / "c" / "2").write_bytes("шум".encode())
    assert [r.text for r in files.decoded(spark, str(tmp_path / "c")).collect()] == ["шум", "шум"]
    df = spark.createDataFrame([("a", True, ["x", "y"]), ("b", None, None)], "slug string, flag boolean, tags array<string>")
    files.write_csv(df.select("slug", files.flagged(F.col("flag")).alias("flag"), files.joined(F.col("tags")).alias("tags")).coalesce(1), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part-*")).read_text("utf-8")
    assert text.startswith("﻿slug;flag;tags\n") and 'a;ДА;"x; y"' in text
    assert files.write_new(df, str(tmp_path / "out")).count() == 2
    more = spark.createDataFrame([("b", True, None), ("c", True, None)], df.schema)
    files.write_new(more, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    page = spark.range(1).select(files.replaced_between(F.lit("a <!-- AUTO:x -->old<!-- /AUTO:x --> b"), "x", F.lit("new")))
    assert rows(page) == [("a <!-- AUTO:x -->\nnew\n<!-- /AUTO:x --> b",)]


def test_pages(spark):
    def fetch(url):
        if url == "slow":
            raise TimeoutError("late")
        return {"ok": (200, "<p>"), "gone": (404, ""), "bad": (500, ""), "no": (403, "")}[url]

    waits = []
    assert web.fetched("bad", fetch, waits.append)[3] == "HTTP 500" and len(waits) == web.TRIES - 1
    urls = spark.createDataFrame([("ok",), ("gone",), ("no",), ("ok",), (None,), ("slow",)], "url string")
    got = {r.url: (r.status, r.error) for r in web.tombstones(web.fetch_all(urls, fetch, lambda s: None)).collect()}
    assert got == {"ok": (200, None), "gone": (404, "404"), "no": (403, "HTTP 403"), "slow": (None, "late")}
    ids = spark.createDataFrame([(i, i * 10) for i in range(12)], "pos int, id int")
    assert [len(r.ids) for r in web.batches_of(ids, "pos", "id").orderBy("batch").collect()] == [10, 2]


def test_increment(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    spark.createDataFrame([("a", 1)], "slug string, v int").write.parquet(src)
    for more in ([("b", 2)], [("a", 9), ("c", 3)]):
        increment.run_once(spark, src, "slug string, v int", lambda df: df.withColumn("w", F.col("v") * 2), out, mark)
        spark.createDataFrame(more, "slug string, v int").write.mode("append").parquet(src)
    increment.run_once(spark, src, "slug string, v int", lambda df: df.withColumn("w", F.col("v") * 2), out, mark)
    assert rows(spark.read.parquet(out), "slug") == [("a", 1, 2), ("b", 2, 4), ("c", 3, 6)]
