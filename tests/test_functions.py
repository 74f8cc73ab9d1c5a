import pytest
from pyspark.sql import functions as F
from specloom.functions import classify, html, parse, text


def one(spark, value, schema, *columns):
    return spark.createDataFrame([(value,)], schema).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


@pytest.mark.parametrize(("given", "want"), [("12,345.5 km", 12345.5), ("-3", -3.0), ("none", None), ("", None), (None, None), ("a1b2", 1.0)])
def test_first_number(spark, given, want):
    assert one(spark, given, "x string", parse.first_number(F.col("x")))[0] == want


def test_missing_values_fall_through_by_name(spark):
    spec = {"a": "-", "b": "待查", "c": " --- ", "d": "7"}
    row = one(spark, spec, "x map<string,string>", parse.first_present(F.col("x"), "a", "b", "zz", "d"), parse.first_present(F.col("x"), "c", "d"), parse.first_present(F.col("x"), "c", "d", trim=True))
    assert tuple(row) == ("7", " --- ", "7")


@pytest.mark.parametrize(("kw", "want"), [(0, None), (None, None), (100, 136), (81, 110)])
def test_metric_hp(spark, kw, want):
    assert one(spark, kw, "x int", parse.metric_hp(F.col("x")))[0] == want


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("1.5 L / 18.3 kWh / 331 a.g. / Hibrid", (1.5, 18.3, 331, "Hibrid")),
        ("2.0 L/1.6 L/150 ag", (1.6, None, 150, None)),
        ("82 KWH / Elektro / Benzin", (None, 82.0, None, "Benzin")),
        ("1,5 L / 90 a.g.", (None, None, 90, "1,5 L")),
        ("1,5 L / 1.5.2 L / Hibrid / 7 a g", (None, None, 7, "Hibrid")),
        ("", (None, None, None, None)),
        (None, (None, None, None, None)),
    ],
)
def test_composite(spark, given, want):
    assert tuple(one(spark, given, "x string", parse.composite(F.col("x")))[0]) == want


def test_price_and_currency(spark):
    row = one(spark, "Zeekr, qiyməti 45 900 USD", "x string", parse.price(F.col("x"), F.lit("1 000 ₼")), parse.price(F.lit("none"), F.lit("cost 39 500 ₼ now")), parse.price(F.lit(""), F.lit("12₼")))
    assert [tuple(r) for r in row] == [(45900, "USD"), (39500, "AZN"), (None, None)]
    row = one(spark, "XXX", "x string", parse.to_azn(F.lit(100), F.col("x")), parse.to_azn(F.lit(101), F.lit("USD")), parse.to_azn(F.lit(0), F.lit("USD")), parse.under_budget(F.lit(None).cast("int")), parse.under_budget(F.lit(44000)))
    assert tuple(row) == (100, 172, 0, False, True)


@pytest.mark.parametrize(("given", "want"), [("共计1,234辆,其中涉及约2.5万余辆", 26234), ("涉及车辆 12台", 12), ("共计 58026 辆", 58026), ("涉及 约 3万 余 辆", 30000), ("总计3，000台。", 3000), ("none", None), ("共0辆", None)])
def test_units_sum(spark, given, want):
    assert one(spark, given, "x string", parse.units_sum(F.col("x")))[0] == want


@pytest.mark.parametrize(("given", "want"), [("2023–2025 and 2021", [2021, 2023, 2024, 2025]), ("2025 - 2023", [2023, 2025]), ("none", []), ("2020-2020", [2020])])
def test_years(spark, given, want):
    assert one(spark, given, "x string", parse.years_in(F.col("x")))[0] == want


def test_dimensions_dates_lines_parts(spark):
    row = one(spark, "4780x1837x1495", "x string", parse.dimensions(F.col("x")), parse.first_date(F.lit("on 2026-09-18 15:17")), parse.unique_lines(F.lit("http://a\n x\nhttp://b\nhttp://a")), parse.last_part(F.lit("5.1/4.2/ 1.1")))
    assert list(row) == [[4780.0, 1837.0, 1495.0], "2026-09-18", ["http://a", "http://b"], "1.1"]


def test_ordered_rules_and_dictionaries(spark):
    row = one(
        spark, "插电混动 增程", "x string", classify.first_containing(F.col("x"), classify.POWERTRAIN), classify.first_containing(F.lit("燃料电池"), classify.POWERTRAIN), classify.first_containing(F.lit(""), classify.DRIVE),
        classify.gearbox_slug(F.lit("7挡湿式双离合")), classify.gearbox_slug(F.lit("单速")), classify.looked_up(F.lit("自然吸气"), classify.ASPIRATION), classify.looked_up(F.lit("x"), classify.ASPIRATION), classify.origin(F.lit("进口及国产")), classify.origin(F.lit("")),
    )
    assert list(row) == ["PHEV_series_parallel", "燃料电池", None, "7dct", "gb", "NA", "x", "both", "unknown"]


def test_removed_prefixes_can_show_another_name(spark):
    body = classify.without(F.col("x"), ("一汽", "上汽"))
    row = one(spark, "一汽大众汽车 上汽", "x string", classify.contained(body, {"大众": "VW", "奥迪": "Audi", "汽": "Auto"}), classify.contained(F.lit(""), {"a": "b"}))
    assert list(row) == [["Auto", "VW"], []]


def test_text_keys_and_folds(spark):
    row = one(spark, " a  b\n", "x string", text.collapsed(F.col("x")), text.text_key(F.col("x")) == F.sha2(F.lit("a b"), 256), text.replaced(F.lit("ab abc"), (("ab", "1"), ("abc", "2"))), text.nfc(F.lit("é")))
    assert list(row) == ["a b", True, "1 2", "é"]


def test_translation_problems(spark):
    p = text.problems
    row = one(spark, "x", "x string", p(F.lit("70,000 км"), F.lit("70000 km")), p(F.lit("5,5 л"), F.lit("5.5 l")), p(F.lit("5"), F.lit("6")), p(F.lit("AKB нет"), F.lit("нет"), ("AKB",)), p(F.lit("а"), F.lit(" ")), p(F.lit("а"), F.lit("bele cumle yoxdur burada"), kind="az"))
    assert list(row) == [[], [], ["numbers"], ["cyrillic", "term AKB"], ["empty"], ["letters"]]


PAGE = """<html><head><title>A &amp; B</title><meta name="Description" content="about"><script>var p = "<p>no</p>";</script></head>
<body><h1>Head</h1><p>short<p>long enough to be a body, with <a href="/x">a link</a> in it<br>and more
<dl><dt>Power<dd>100 kW<dt>Drive<dd>AWD</dl></body>"""


def test_page_fields(spark):
    row = spark.createDataFrame([(PAGE,), (None,), ("",)], "x string").select(html.page_fields(F.col("x")).alias("f"), html.tags_stripped(F.col("x")).alias("t"), html.body_text(html.page_fields(F.col("x")), 30, 3).alias("b")).collect()
    f = row[0].f
    assert (f.title, f.h1, f.description) == ("A & B", "Head", "about")
    assert [(x.href, x.text) for x in f.links] == [("/x", "a link")] and f.labels == {"Power": "100 kW", "Drive": "AWD"}
    assert row[0].b.startswith("long enough to be a body, with a link in it") and "no" not in row[0].t.split()
    assert row[1].b == "" and row[2].b == ""
