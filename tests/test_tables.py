import json

import pytest
from pyspark.sql import functions as F
from specloom.operators import prefix
from specloom.plans import report
from specloom.sources import files, tables

RECORD = "slug string, n int, issues array<string>"


def rows(df, *order):
    return sorted(map(tuple, df.collect()), key=str)


def test_snapshots_are_published_whole_or_not_at_all(spark, tmp_path):
    snaps = tables.Snapshots(spark, f"file://{tmp_path}/s")
    one = spark.createDataFrame([("a", 1, ["x"]), ("b", 2, None)], RECORD)
    totals = {"records": lambda df: df.agg(F.sum("n")).first()[0] or 0}
    assert snaps.published() == {}
    snaps.publish({"records": one, "parts": one.select("slug")}, {"records": ["slug"], "parts": ["slug"]}, totals)
    assert rows(snaps.published()["records"]) == rows(one)
    for bad, why in ((one.where("slug = 'a'"), "records: 1 lost"), (one.withColumn("n", F.lit(0)), "records: 3 to 0")):
        with pytest.raises(tables.Regression) as e:
            snaps.publish({"records": bad, "parts": one.select("slug")}, {"records": ["slug"]}, totals)
        assert why in e.value.problems and rows(snaps.published()["records"]) == rows(one)
    with pytest.raises(tables.Regression) as e:
        snaps.publish({"records": one}, {"records": ["slug"]}, check=lambda before, after: ["never"])
    assert e.value.problems == ["parts: no longer there", "never"]
    more = one.union(spark.createDataFrame([("c", 1, None)], RECORD))
    snaps.publish({"records": more, "parts": one.select("slug")}, {"records": ["slug"]}, totals)
    assert snaps.published()["records"].count() == 3
    # A new set may be built from what is published.
    snaps.publish({"records": snaps.published()["records"].withColumn("n", F.col("n") + 1), "parts": one.select("slug")}, {"records": ["slug"]}, totals)
    assert sorted(r.n for r in snaps.published()["records"].collect()) == [2, 2, 3]


def test_a_run_that_ends_between_leaves_the_old(spark, tmp_path, monkeypatch):
    snaps = tables.Snapshots(spark, f"file://{tmp_path}/s")
    one = spark.createDataFrame([("a", 1, None)], RECORD)
    snaps.publish({"records": one}, {"records": ["slug"]})
    with monkeypatch.context() as m:
        m.setattr(tables.Pointers, "set", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            snaps.publish({"records": one.withColumn("n", F.lit(9))}, {"records": ["slug"]})
    assert rows(tables.Snapshots(spark, f"file://{tmp_path}/s").published()["records"]) == rows(one)
    number, told = snaps.pointers.last()
    snaps.pointers.set(told, number)
    with pytest.raises(RuntimeError):
        snaps.pointers.set(told, number)  # of two writers one fails
    assert snaps.pointers.last()[0] == number + 1


def test_rows_are_replaced_by_key_in_their_buckets_only(spark, tmp_path):
    table = tables.KeyedTable(spark, f"file://{tmp_path}/t", "slug", 8)
    first = spark.createDataFrame([(f"k{i}", i, [str(i)]) for i in range(40)], RECORD)
    assert table.read() is None and table.put(first) == 40 and table.put(first) == 0 and table.put(first, force=True) == 0
    _, before = table.pointers.last()
    change = spark.createDataFrame([("k3", 99, None), ("new", 1, None), ("k4", 4, ["4"])], RECORD)
    assert table.put(change) == 1 and {r.slug: r.n for r in table.read().collect()} == {f"k{i}": i for i in range(40)} | {"new": 1}
    assert table.put(change, force=True) == 1 and table.put(change, force=True) == 0
    got = {r.slug: (r.n, r.issues) for r in table.read().collect()}
    assert got == {f"k{i}": (i, [str(i)]) for i in range(40)} | {"new": (1, None), "k3": (99, None)} and table.read().count() == 41
    _, after = table.pointers.last()
    assert 1 <= sum(before["folders"][b] != after["folders"][b] for b in before["folders"]) <= 2
    for bad in ([("a", 1, None), ("a", 2, None)], [(None, 1, None)]):
        with pytest.raises(ValueError):
            table.put(spark.createDataFrame(bad, RECORD))
    with pytest.raises(ValueError):
        table.put(first.drop("n"))
    assert table.read().count() == 41 and table.put(first.limit(0)) == 0


def test_prefixes_meet_names_by_equality(spark):
    names = spark.createDataFrame([("byd_qin-plus_2025",), ("byd_qin-plus_2025",), ("zeekr_x",), ("x",), (None,), ("",)], "slug string")
    known = spark.createDataFrame([("byd_qin", "Qin", 2), ("byd_", "BYD", 1), ("zeekr_x", "X", 3), ("", "none", 0), (None, "null", 0)], "p string, family string, pos int")
    out = prefix.first_prefixed(names, "slug", known, "p", "pos", "family")
    assert rows(out) == sorted([("byd_qin-plus_2025", "BYD"), ("byd_qin-plus_2025", "BYD"), ("zeekr_x", "X"), ("x", None), (None, None), ("", None)], key=str)
    plan = out._jdf.queryExecution().toString() + report.unmatched(names, "slug", known, "p")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert rows(report.unmatched(names, "slug", known, "p")) == [("",), ("x",), (None,)]
    assert prefix.pairs(names, "slug", known.limit(0), "p").count() == 0


def test_counters_come_with_the_write(spark, tmp_path):
    df = spark.range(10).withColumn("kept", F.when(F.col("id") > 6, True))
    told = report.written(df, str(tmp_path / "w"), {"kept": F.col("kept"), "even": F.col("id") % 2 == 0, "all": F.lit(True)})
    assert told == {"kept": 3, "even": 5, "all": 10} and spark.read.parquet(str(tmp_path / "w")).count() == 10


def test_json_array_of_any_size(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 3 else "ё\n") for i in range(50)], "i int, t string").repartition(7)
    for some in (df, df.limit(0), df.limit(1)):
        path = tmp_path / f"j{some.count()}"
        files.write_json_array(some, str(path), [F.desc("i")])
        whole = json.loads("".join(p.read_text("utf-8") for p in sorted(path.glob("part-*"))))
        assert whole == sorted(({"i": r.i, "t": r.t} for r in some.collect()), key=lambda r: -r["i"])


def test_small_writers(spark, tmp_path):
    df = spark.createDataFrame([("b", 1, True, None), ("a", 2, None, "e")], "key string, z int, under_budget boolean, error string")
    files.write_sorted_json(df.select("z", "key"), str(tmp_path / "o"))
    assert [json.loads(x) for p in sorted((tmp_path / "o").glob("part-*")) for x in p.read_text().splitlines()] == [{"key": "a", "z": 2}, {"key": "b", "z": 1}]
    files.write_once(df, str(tmp_path / "once"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        files.write_once(df, str(tmp_path / "once"))
    files.write_listings_csv(df.coalesce(1), str(tmp_path / "c"), {"key": "Ключ", "under_budget": "Бюджет"})
    assert next((tmp_path / "c").glob("part-*")).read_text("utf-8") == "﻿Ключ;Бюджет\nb;ДА\na;ОШИБКА\n"
    assert files.in_field_order(df, ["z", "none", "error"]).columns == ["z", "error", "key", "under_budget"]
    (tmp_path / "keys").write_text("a b\n a\n\nc\n")
    assert sorted(r.slug for r in files.key_list(spark, str(tmp_path / "keys")).collect()) == ["a", "b", "c"]
