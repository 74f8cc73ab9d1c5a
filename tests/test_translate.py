import random

import pytest
from pyspark.sql import functions as F
from specloom.functions import text
from specloom.operators import translate
from specloom.operators.translate import COMPONENT_PATHS, RECORD_PATHS, Path

LETTERS = "абвгдежз"


def plain_fold(kind, own, literal, patterns):
    """Fragments put in one after the other, the longer first, then patterns; null if Cyrillic letters stay."""
    import re

    out = own
    for source, target, kinds, _ in sorted(literal, key=lambda f: (-len(f[0]), f[3])):
        if kind in kinds:
            out = out.replace(source, target)
    for kinds, pattern, replacement in patterns:
        if kind in kinds:
            out = re.sub(pattern, replacement, out)
    return None if re.search("[А-Яа-яЁё]", out) or (kind == "cn_fuel_cycle" and "工信部" in out) else " ".join(out.split())


@pytest.mark.parametrize("empty", [False, True])
def test_index_folds_as_all_fragments_do(spark, empty):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice(LETTERS) for _ in range(n))
    sources = list(dict.fromkeys([*(word(rng.choice([4, 5, 6, 7])) for _ in range(9900)), *LETTERS, "ab", "х ц", *(word(2) for _ in range(60))]))
    fragments = [(s, "" if empty and i == 3 else rng.choice(["x", "ab", "y z", "q,"]) + str(i % 7), rng.choice([["a"], ["b"], ["a", "b"]]), i) for i, s in enumerate(sources)]
    patterns = [(["a", "b"], r"([0-9])q", r"q\1$"), (["b"], "[а-я]+", "W"), (["cn_fuel_cycle"], "цикл", "cycle")]
    texts = [(str(i), " ".join(rng.choice([word(3), word(5), rng.choice(sources), "ab"]) for _ in range(5)), rng.choice("ab")) for i in range(120)]
    texts += [("n1", "工信部 цикл", "cn_fuel_cycle"), ("n2", "цикл", "cn_fuel_cycle"), ("n3", "нет", "c")]
    rows = translate.translated(
        spark.createDataFrame(texts, "key string, text string, kind string"), spark.createDataFrame([(texts[0][1], "whole")], "source string, target string"),
        spark.createDataFrame(fragments, "source string, target string, kinds array<string>, pos int"), patterns,
    )
    assert "CartesianProduct" not in rows._jdf.queryExecution().toString() and "BroadcastNestedLoopJoin" not in rows._jdf.queryExecution().toString()
    got = {r.key: r.result for r in rows.collect()}
    want = {k: plain_fold(kind, own, fragments, patterns) for k, own, kind in texts} | {texts[0][0]: "whole"}
    assert got == want and len(got) == len(texts)
    assert got["n1"] is None and got["n2"] == "cycle" and got["n3"] is None


def test_texts_are_taken_from_records_by_paths(spark):
    issue = "struct<text:string,scope_note:string,review_car:string,source:string>"
    records = spark.createDataFrame([
        ("b", [("стук", "только", None, "u"), (None, None, "Ёж", "u")], ["проверить", None, "plain"], "первое | second |  третье ", "поколение", None, None, ("工信部 combined",), ("трим", "зачем")),
        ("a", [("первое", None, None, "u")], None, None, None, "в продаже", "й", ("city",), None),
        ("c", None, None, None, None, None, None, None, None),
    ], f"slug string, known_issues array<{issue}>, buyer_checks array<string>, notes string, generation string, status_china string, hybrid_system string, fuel_l_100km struct<cycle:string>, closest_official struct<trim:string,why:string>")
    parts = spark.createDataFrame([("e1", "имя", "стук", {"type": ["тип", "x"], "n": []})], "id string, name string, note string, specs map<string,array<string>>")
    single = spark.createDataFrame([("e2", ("одно", 5))], "id string, specs struct<type:string,n:int>")
    rows = translate.gathered(translate.extracted(records, RECORD_PATHS, "slug"), translate.extracted(parts, COMPONENT_PATHS, "id", 1), translate.extracted(single, COMPONENT_PATHS, "id", 2)).collect()
    assert {(r.kind, r.text) for r in rows} == {
        ("cn_issue", "стук"), ("cn_scope_note", "только"), ("cn_review_car", "Ёж"), ("cn_buyer_check", "проверить"), ("cn_note", "третье"), ("cn_generation", "поколение"), ("cn_fuel_cycle", "工信部 combined"),
        ("cn_closest_trim", "трим"), ("cn_closest_why", "зачем"), ("cn_issue", "первое"), ("cn_status", "в продаже"), ("cn_hybrid_system", "й"), ("cn_component_name", "имя"), ("cn_component_spec", "тип"), ("cn_component_spec", "одно"),
    }
    import hashlib

    assert next(r.key for r in rows if r.kind == "cn_hybrid_system") == hashlib.sha256("й".encode()).hexdigest()
    assert translate.extracted(records.select("slug"), RECORD_PATHS, "slug").collect() == []
    assert translate.extracted(records, [Path("x", "known_issues[].source")], "slug").collect() == []


def test_what_is_wrong_with_translations(spark):
    rows = [
        ("пробег 70 тыс. км", "mileage 70000 km"), ("пробег 70 тыс. км", "mileage 70 km"), ("1,5 л и 2.0", "1.5 l and 2,0"), ("цена 70,000", "price 70000"), ("70,000км", "70000km"), ("текст BYD", "text"), ("текст", " "), ("текст", None),
        ("锐放双擎 текст", "Frontlander hybrid"), ("锐放双擎", "锐放"), ("国产", "made"), ("текст", "текст left"), ("текст", "bura gedir yaxsi nese"), ("текст", "burada gedir yaxşı nəsə"),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a string, b string")
    found = [r.p for r in df.select("i", text.translation_problems(F.col("a"), F.col("b"), ("BYD",), ("双擎", "擎", "国产"), "az").alias("p")).orderBy("i").collect()]
    assert found == [
        [], [], [], [], ["numbers 70.000 -> 70000"], ["term BYD"], ["empty"], ["empty"], ["label 锐放双擎"], [], [], ["cyrillic"], ["letters"], [],
    ]
