from pyspark.sql import functions as F
from specloom.functions import classify, parse
from specloom.operators import specs
from specloom.plans import catalogue, models

LISTING = """<html><head><title>Zeekr 7X, qiyməti 45 000 AZN</title></head><body><dl><dt>Marka<dd>Zeekr<dt>Buraxılış ili<dd>2024<dt>Yürüş<dd>12 000 km
<dt>Mühərrik<dd>1.5 L / 18.3 kWh / 331 a.g. / Hibrid</dl></body></html>"""


def test_listings_and_their_order(spark):
    pages = [("u1", 200, LISTING, None), ("u2", 200, LISTING.replace("45 000", "30 000"), None), ("u3", 404, None, None), ("u4", None, None, "late"), ("u5", 200, "<title>no price</title>", None)]
    out = catalogue.listing_order(catalogue.listings(spark.createDataFrame(pages, "url string, status int, html string, error string"))).collect()
    assert [(r.url, r.price_azn, r.under_budget, r.error) for r in out] == [("u2", 30000, True, None), ("u1", 45000, False, None), ("u5", None, False, None), ("u3", None, False, "объявление удалено"), ("u4", None, False, "late")]
    assert (out[0].make, out[0].year, out[0].mileage_km, out[0].engine_l, out[0].hp, out[0].fuel) == ("Zeekr", 2024, 12000, 1.5, 331, "Гибрид")


def test_recalls(spark):
    page = '<a href="/zhdt/art/1">一汽大众汽车 召回部分进口汽车</a><a href="/zhdt/art/1">召回 again</a><a href="/zhdt/art/2">某摩托车 召回</a><a href="/x">大众 召回</a><a href="/zhdt/art/3">大众客车 召回</a>'
    links = catalogue.recall_links(spark.createDataFrame([("p1", page), ("p2", None)], "url string, html string"))
    assert links.count() == 3
    wanted = catalogue.wanted_recalls(links, {"大众": "VW"}, ("一汽",))
    assert [(r.href, r.brands, r.origin) for r in wanted.collect()] == [("/zhdt/art/1", ["VW"], "import")]
    details = spark.createDataFrame([("/zhdt/art/1", '<meta name="PubDate" content="2026-09-18"><p>涉及车辆 共计 约 1,200 余 辆 召回编号：M2026A</p>', None)], "url string, html string, error string")
    r = catalogue.recalls(wanted, details).first()
    assert r.recall_numbers == ["M2026A"]
    assert (r.pub_date, r.affected_units_total, r.detail_error) == ("2026-09-18", 1200, None)


SPEC = {
    "车辆/动力类型": "插电式混合动力", "发动/最大功率(kW/rpm)": "81/6000", "发动/最大扭矩(N·m/rpm)": "135/4500", "发动/进气形式": "自然吸气", "发动/汽缸容积(cc)": "1498", "发动/发动机型号": "BYD472QA", "发动/压缩比": "15.5",
    "电机/电动机总功率(kW)": "145", "电机/前电动机最大功率(kW)": "145", "电机/后电动机最大功率(kW)": "-", "电机/电动机总扭矩(N·m)": "325", "电机/电机类型": "永磁同步电机", "电机/电机数": "1", "电池/电池容量(kWh)": "18.3",
    "电池/电池种类": "磷酸铁锂电池", "电池/电芯品牌": "--", "电池/电池品牌": "弗迪", "底盘/驱动方式": "前置前驱", "电池/充电方式": "慢充", "电池/慢充时间(小时)": "2.5", "电池/最大慢充功率(kW)": "6.6", "车身/长x宽x高(mm)": "4780x1837x1495",
    "车身/轴距(mm)": "2718", "车身/整备质量(kg)": "1620", "车辆/工信部油耗(L/100km)(城市/市郊/综合)": "4.1/3.8", "车辆/官方最高车速(km/h)": "185", "车身/油箱容积(L)": "48", "车辆/系统综合功率(kW)": "-", "变速/变速箱": "ECVT无级变速", "车辆/工信部纯电续航里程(km)": "待查", "电池/CLTC纯电续航里程(km)": "120",
    "没有斜线": "x",
}


def test_records_from_specifications(spark):
    rows = spark.createDataFrame([(SPEC,), ({},), (None,), ({"x/电动机总功率(kW)": "200", "y/前电动机最大功率(kW)": "80", "y/后电动机最大功率(kW)": "120", "z/电机类型": "感应", "x/电池容量(kWh)": "未知"},)], "s map<string,string>")
    found = rows.select(parse.by_name(F.col("s"), catalogue.SPEC_NAMES).alias("f")).select("f", *catalogue.base_record(F.col("f"))).collect()
    a = found[0]
    assert (a.powertrain_type, a.engine.code, a.engine.power_hp, a.engine.torque_nm, a.engine.aspiration, a.engine.displacement_cc, a.engine.compression) == ("PHEV_series_parallel", "BYD472QA", 110, 135.0, "NA", 1498.0, 15.5)
    assert (a.motor.type, a.motor["count"], a.motor.power_hp, a.motor.axle, a.motor.torque_nm) == ("PMSM", 1.0, 197, "front", 325.0)
    assert (a.battery.kwh, a.battery.chemistry, a.battery.brand, a.drive, a.system_power_hp) == (18.3, "LFP", "弗迪", "FWD", None)
    assert (a.charging.dc_supported, a.charging.ac_full_h, a.charging.ac_kw, a.charging.connector) == (False, 2.5, 6.6, "GB/T")
    assert (tuple(a.dimensions_mm), a.fuel_l_100km.value, a.miit_range_km, a.top_speed_kmh, a.tank_l, a.gearbox_cn) == ((4780, 1837, 1495, 2718), 3.8, 120.0, 185.0, 48.0, "ECVT无级变速")
    assert found[1].engine is None and found[1].battery is None and found[1].charging.dc_supported is None and found[2].engine is None
    assert (found[3].motor.axle, found[3].motor.type, found[3].battery.kwh) == ("front+rear", "感应", None)


def test_first_entry_of_a_name_wins_under_any_category(spark):
    spec = {"a/x": "--", "b/x": "1", "c/x": "2", "a/p>y": "3", "a/y": " 待查 ", "b/y/z": "4", "x": "5"}
    as_map = F.create_map(*[F.lit(x) for pair in spec.items() for x in pair])  # keeps the order
    r = spark.range(1).select(as_map.alias("s")).select(parse.by_name(F.col("s"), ["y", "x", "p>y", "y/z"]).alias("f"), parse.by_name(F.col("s"), ["y"], trim=True).alias("t")).first()
    assert r.f == {"x": "1", "p>y": "3", "y": " 待查 ", "y/z": "4"} and r.t == {}


def test_gearboxes_as_records_call_them(spark):
    names = ["ECVT无级变速", "单速变速箱", "3档DHT", "7挡湿式双离合", "8挡手自一体", "6挡手动", "CVT无级变速", "怪", "", None]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", classify.transmission(F.col("n")).alias("t")).orderBy("i").collect()
    assert [r.t for r in rows] == ["E-CVT", "Редуктор 1 ст.", "3-ступ. DHT", "DCT", "AT", "MT", "CVT", "怪", None, None]


def trims_of(spark, rows):
    return spark.createDataFrame(rows, "trim_id long, pos int, year int, name string, launched string, price double, on_sale boolean")


def test_models_are_built_named_and_merged(spark):
    other = SPEC | {"车身/整备质量(kg)": "1700", "车辆/官方0-100加速(s)": "7.9"}
    petrol = {"车辆/动力类型": "汽油", "发动/最大功率(kW/rpm)": "138/5500", "发动/发动机型号": "JL473ZQ", "变速/变速箱": "7挡湿式双离合", "车身/整备质量(kg)": "-"}
    trims = trims_of(spark, [(1, 0, 2025, " A ", "2025-01", 9.98, False), (2, 1, 2025, "B", "2025-02", 10.98, True), (3, 2, 2025, "C", None, None, False), (4, 3, 2019, "old", None, 1.0, True), (5, 4, 2025, "D", None, 1.0, None), (6, 5, 2026, "E", None, 1.0, True)])
    maps = spark.createDataFrame([(1, SPEC), (2, other), (3, petrol), (4, SPEC), (6, SPEC)], "trim_id long, spec map<string,string>")
    old = spark.createDataFrame([(2, "kept", 2024, {"price": "1"}, ["look"], "was | more", {"engine": "o"}, "P", None)], "trim_id long, slug string, my int, listing_values map<string,string>, buyer_checks array<string>, notes string, sources map<string,string>, platform string, model string")
    gens = [models.Generation(F.col("k_engine") == "BYD472QA", "4", "e", "n", {"page": "u"}), models.Generation(F.lit(True), "?")]
    rows = {tuple(r.ids): r for r in models.built(trims, maps, "byd_x", {"model": "BYD X", "model_cn": "某"}, gens, None, old).collect()}
    assert set(rows) == {(1, 2), (3,), (5,), (6,)}
    a = rows[1, 2]
    assert (a.slug, a.existing, a.trim_key, a.generation, a.platform, a.status_china, a.transmission, a.powertrain_type) == ("kept", True, "2025款 A", "4", "P", "в продаже (sohu)", "E-CVT", "PHEV_series_parallel")
    assert a.trims == ["A (sohu 1, 2025-01, 9.98万)", "B (sohu 2, 2025-02, 10.98万)"] and (a.curb_weight_kg.min, a.curb_weight_kg.max, a.curb_weight_kg.several) == (1620, 1700, True)
    assert a.notes == "was | n Масса и разгон — диапазон по комплектациям группы; прочие поля — по sohu 1. Год в объявлении 2024, официальный 年款 — 2025."
    assert a.listing_values == {"price": "1", "year": "2024"} and a.buyer_checks == ["look"] and a.sources["engine"] == "o" and a.sources["page"] == "u" and a.sources["trim_page"].endswith("trim_1/")
    assert a.sources["weight"].endswith("trim_ids=1,2&city_code=110000") and (a.match_fingerprint.battery_kwh, a.match_fingerprint.hp, a.ev_range_km.MIIT) == (18.3, 197, 120.0)
    b = rows[3,]
    assert (b.slug, b.verification, b.match_fingerprint.hp, b.battery, b.charging, b.transmission, b.existing, b.notes) == ("byd_x_2025_jl473zq-7dct", "partial", 188, None, None, "DCT", False, "")
    assert rows[6,].slug == "byd_x_2026_18.3kwh-145kw" and rows[6,].verification == "verified" and rows[5,].slug == "byd_x_2025_"
    assert models.built(trims.limit(0), maps, "x", {"model": "m"}).collect() == []


def test_no_two_rows_share_a_slug(spark):
    df = spark.createDataFrame([(1, "a", "C 1"), (2, "a", "C 1"), (3, "a", "C1"), (4, "a", None), (5, "a", None), (6, "b", "C1")], "i int, slug string, code string")
    rows = specs.without_collisions(df, "slug", "code", ["i"]).orderBy("i").collect()
    assert [r.slug for r in rows] == ["a", "a-c1", "a-c1-2", "a-2", "a-3", "b"]


def test_flat_pages_read_as_trees_do(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from specloom.functions import dom

    labels, item = {"A": "a", "B b": "b", "C": "c"}, "p__i"
    bits = ["<p>", "</p>", "<li>", "</li>", "<ul>", "</ul>", "<div class='x p__i'>", "<span class=p__i-name>", "<i class='p__i-value z'>", "</i>", "</span>", "</div>", "A", " B b ", "C", "1", "x &amp; y", "<br>", "<br/>", "<script>A</script>", "<title>t ", "</title>", "<h1>", "</h1>", "<dt>", "<dd>", "<table><tr><td>", "</table>", "<!-- A -->", "<b>", "</b>"]

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.sampled_from(bits), max_size=40).map("".join))
    def same(page):
        root, flat = dom.tree(page), dom._Flat(labels, item)
        flat.feed(page)
        flat.close()
        assert flat.text(0) == root.text()
        for tag, between in (("title", ""), ("h1", " ")):
            e = next((e for e in root.walk() if e.tag == tag), None)
            assert flat.first(tag, between) == (e and e.text(between))
        for e in root.walk():
            assert e.tag != "h2"
        assert sorted(flat.texts) == sorted(root.strings())

    same()


LISTING_ITEMS = "".join(f"<div class='product-properties__i'><label class='product-properties__i-name'>{n}</label><span class='product-properties__i-value'>{v}</span></div>" for n, v in (("Marka", "BYD"), ("Model", "Song"), ("Marka", "Zeekr"), ("Başqa", "x")))


def test_listing_values_by_markup_and_beside_labels(spark):
    page = f"<title>T</title>{LISTING_ITEMS}<ul><li><b>Rəng</b><i></i> Ağ<li><b>Yürüş</b> <i>5 km</i></ul><p>Şəhər</p><p>Bakı</p><b>Model</b><i>no</i>"
    rows = spark.createDataFrame([(page,), ("",), (None,), ("<h1>only",)], "p string")
    from specloom.functions import dom

    got = rows.select(dom.listing(F.col("p"), catalogue.LISTING_LABELS, catalogue.LISTING_ITEM).alias("f")).collect()
    assert got[0].f["values"] == {"make": "Zeekr", "model": "Song", "color": "Ağ", "mileage_raw": "5 km", "city": "Bakı"}
    assert got[1].f.text == "" and got[1].f["values"] == {} and got[2].f.text is None and got[3].f.h1 == "only"
