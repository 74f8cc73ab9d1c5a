from pyspark.sql import functions as F
from specloom.operators import rules
from specloom.operators.rules import Rule
from specloom.plans import component_rules

KIND = "slug string, model string, my int, generation string, transmission string, powertrain_type string, engine struct<code:string,displacement_cc:double,aspiration:string>, motor struct<front_kw:double,rear_kw:double,power_kw:double>"


def test_catalogue_rules_reach_all_but_none_twice():
    assert rules.unreachable(component_rules.RULES) == []
    kinds = {r.kind for r in component_rules.RULES}
    assert all(len({r.place for r in component_rules.RULES if r.kind == k}) == sum(r.kind == k for r in component_rules.RULES) for k in kinds)


def test_rules_that_never_decide_are_told():
    wide, narrow = Rule("t", 1, id="a", family=["x_*"]), Rule("t", 2, id="b", family=["x_1", "x_2"], year=[2020])
    years = [Rule("t", 3, id="c", year=[2020, 2021], gearbox=["AT"]), Rule("t", 4, id="d", year=[2021], gearbox=["8AT"], has=["z"]), Rule("t", 5, id="e", year=[2021], gearbox=["*"])]
    labels = [Rule("t", 6, id="f", has=["第二"], lacks=["第三代"]), Rule("t", 7, id="g", has=["第二代"], lacks=["第三"]), Rule("t", 8, id="h", has=["第二代"])]
    found = [(r.place, by.place) for r, by in rules.unreachable([wide, narrow, *years, *labels])]
    assert found == [(2, 1), (4, 3), (7, 6)]
    assert rules.unreachable([Rule("t", 1, id="{f}"), Rule("t", 2, id="b"), Rule("u", 3, id="c")]) == []
    assert len(rules.unreachable([Rule("t", 1, id="a"), Rule("t", 2, id="b"), Rule("t", 3, reason="c", code=["*"])])) == 2


def test_rules_of_a_table_decide_as_the_list_does(spark):
    table = spark.createDataFrame([r._asdict() | {n: list(getattr(r, n)) or None for n in ("family", "code", "powertrain", "year", "gearbox", "has", "lacks")} for r in component_rules.RULES], rules.SCHEMA)
    read = rules.read(table)
    assert [tuple(map(lambda v: list(v) if isinstance(v, tuple | list) else v, r)) for r in read] == [tuple(map(lambda v: list(v) if isinstance(v, tuple | list) else v, r)) for r in component_rules.RULES]
    rows = spark.createDataFrame([
        ("byd_qin-plus_2025", "BYD Qin", 2025, "5", "E-CVT", "PHEV_series_parallel", ("BYD472QC", 1498.0, "NA"), (None, None, 120.0)),
        ("changan_cs75-plus_2023", "Changan CS75", 2023, "第二代", "8AT", "ICE", ("JL486ZQ4", None, "turbo"), None),
        ("changan_cs75-plus_2023", "Changan CS75", 2023, "第二代 第三代", "8AT", "ICE", (None, None, None), None),
        ("deepal_s07_2025", "Deepal S07", 2025, None, "Редуктор 1 ст.", "EREV", ("JL469Q1", None, "NA"), (0.0, 175.0, 175.0)),
        ("zeekr_x_2026", "Zeekr X", 2026, None, None, "BEV", None, (0.0, 200.0, 200.0)),
        (None, None, None, None, None, None, None, None),
    ], KIND)
    for own in (None, read):
        out = component_rules.assigned(rows, own).collect()
        a = [(r.components["engine"], r.components["transmission"], r.components["hybrid_system"]) for r in out]
        assert a[:5] == [("byd_472qc_1.5", "byd_ehs_ecvt_dm5", "byd_dm_5.0"), ("changan_jl486zq4_2.0t", "aisin_8at", None), (None, None, None), ("changan_jl469q1_1.5", None, "changan_erev_jl469q1_m175"), (None, None, None)]
        assert out[2].components_null_reason["transmission"].startswith("Aisin 8AT") and out[4].components_null_reason == {"engine": "нет ДВС (BEV)", "transmission": "BEV: редуктор, тип/поставщик не указаны", "hybrid_system": "не гибрид (ICE/BEV)"}
        assert a[5] == (None, None, None) and out[5].components_null_reason["engine"] == "код двигателя неизвестен"
    place = rows.select(rules.decided_by(component_rules.RULES, "transmission", *component_rules.fields(rows)).alias("p")).collect()
    assert [r.p for r in place] == [1, 7, 9, 13, 17, 18]
    assert rules.decided_by([], "x", {}) is not None and rows.select(F.lit(1)).count() == 6
