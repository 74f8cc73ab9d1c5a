"""Queries of the record plans: build from trims, components by rules, index, totals, reports, issues of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.functions import text
from specloom.operators import build, components, issues, records, specs, translate
from specloom.plans import component_rules, models, report
from specloom.plans.queries import Tables, registered


@registered("""
    WITH trims AS (SELECT p_partkey AS id, p_name, p_size, 2020 + p_size % 3 AS year, p_size % 4 = 0 AS ev, p_brand AS code, contains(p_name, 'widget') AS awd,
                          CASE WHEN p_size % 7 > 0 THEN (1000 + p_size * 10)::DOUBLE END AS w, CASE WHEN p_size % 5 > 0 THEN p_size / 4.0::DOUBLE END AS a FROM part WHERE p_size % 3 < 2),
         g AS (SELECT year, ev, code, awd, min(id) AS id, string_agg(id, ',' ORDER BY id) AS ids, count(*) AS n, arg_min(p_name, id) AS name, arg_min(p_size, id) AS size, bool_or(p_size % 10 = 0) AS sale, min(w) AS w1, max(w) AS w2, min(a) AS a1, max(a) AS a2 FROM trims GROUP BY ALL),
         s AS (SELECT *, 'x_' || year || '_' || CASE WHEN ev THEN '18.3kwh-145kw' ELSE lower(code) || '-7dct' END || CASE WHEN awd THEN '-awd' ELSE '' END AS slug FROM g),
         c AS (SELECT * EXCLUDE slug, CASE WHEN row_number() OVER (PARTITION BY slug ORDER BY code, id) > 1 THEN slug || '-' || lower(code) ELSE slug END AS slug FROM s),
         hits AS (SELECT year, ev, code, awd, min(s_suppkey) AS k FROM trims JOIN supplier ON s_suppkey * 3 = id GROUP BY ALL),
         m AS (SELECT c.*, k, 'made' || CASE WHEN year = 2021 THEN ' late' ELSE '' END || CASE WHEN n > 1 THEN ' Масса и разгон — диапазон по комплектациям группы; прочие поля — по sohu ' || id || '.' ELSE '' END AS own, k % 2 = 0 AND 2019 + k % 3 <> year AS moved FROM c LEFT JOIN hits USING (year, ev, code, awd))
    SELECT CASE WHEN k IS NULL THEN slug ELSE 'old_' || k END AS slug, year, n AS trims_n, trim(name) || ' (sohu ' || id || ', 2024-' || (1 + size % 9) || ', ' || size || '万)' AS label,
           CASE WHEN k % 2 = 0 THEN 'key ' || k ELSE year || '款 ' || trim(name) END AS trim_key, CASE WHEN sale THEN 'в продаже (sohu)' ELSE 'снята с продажи (sohu)' END AS status,
           CASE WHEN ev THEN 'PHEV_series_parallel' ELSE 'ICE' END AS powertrain, coalesce('Old ' || k, 'X') AS model, CASE WHEN year = 2021 THEN 'II' ELSE 'I' END AS generation,
           CASE WHEN k IS NULL THEN own ELSE 'n' || k || ' | ' || own || CASE WHEN moved THEN ' Год в объявлении ' || (2019 + k % 3) || ', официальный 年款 — ' || year || '.' ELSE '' END END AS notes,
           CASE WHEN moved THEN (2019 + k % 3)::VARCHAR END AS listing_year, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS checks_n,
           CASE WHEN k IS NULL THEN 'https://portal.auto.sohu.com/aggr/model/trims/pk?trim_ids=' || ids || '&city_code=110000' ELSE 'old' END AS engine_source, 8 + CASE WHEN year = 2021 THEN 2 ELSE 1 END AS sources_n,
           CASE WHEN k IS NULL THEN 1 ELSE 2 END AS issues_n, w1 AS weight_min, w2 AS weight_max, a1 AS accel_min, a2 AS accel_max, CASE WHEN w1 IS NOT NULL THEN n > 1 END AS several,
           CASE WHEN size % 11 > 0 THEN (100 + size)::DOUBLE END AS torque, CASE WHEN ev THEN 197 ELSE 110 END AS fingerprint_hp, CASE WHEN ev THEN (50 + size)::DOUBLE END AS range_km, CASE WHEN ev THEN size::DOUBLE END AS fuel,
           CASE WHEN ev AND size % 8 = 4 THEN TRUE END AS dc, CASE WHEN ev THEN 'LFP' END AS chemistry, CASE WHEN awd THEN 'AWD' ELSE 'FWD' END AS drive, 1837.0::DOUBLE AS width, CASE WHEN ev THEN 'E-CVT' ELSE 'DCT' END AS transmission,
           CASE WHEN w1 IS NOT NULL THEN 'verified' ELSE 'partial' END AS verification, k IS NOT NULL AS existing FROM m""")
def record_build(t: Tables) -> DataFrame:
    """Records of a model from trims and their specification entries, merged over the records there are."""
    size, ev = F.col("p_size"), F.col("p_size") % 4 == 0
    trims = t.part.select(
        F.col("p_partkey").alias("trim_id"), F.col("p_partkey").alias("pos"), (2020 + size % 3).alias("year"), F.concat(F.lit(" "), "p_name").alias("name"),
        F.concat(F.lit("2024-"), 1 + size % 9).alias("launched"), size.alias("price"), (size % 10 == 0).alias("on_sale"),
    )
    text = lambda c: c.cast("string") if not isinstance(c, str) else F.lit(c)
    entries = {
        "车身/整备质量(kg)": F.when(size % 7 > 0, text(1000 + size * 10)).otherwise("-"), "车辆基本/官方0-100加速(s)": F.when(size % 5 > 0, text(size / 4)).otherwise("--"),
        "变速箱/变速箱": F.when(ev, "ECVT无级变速").otherwise("7挡湿式双离合"), "发动机/发动机型号": F.col("p_brand"), "发动机/最大功率(kW/rpm)": F.lit("81/6000"),
        "发动机/最大扭矩(N·m/rpm)": F.when(size % 11 > 0, F.concat(text(100 + size), F.lit("/4500"))).otherwise("待查"), "底盘/驱动方式": F.when(F.col("p_name").contains("widget"), "电动四驱").otherwise(" 前置前驱 "),
        "车辆/动力类型": F.when(ev, "插电式混合动力").otherwise("汽油"), "车辆/长x宽x高(mm)": F.lit("4780x1837x1495"), "电机/电动机总功率(kW)": F.when(ev, "145").otherwise("-"),
        "电池/电池容量(kWh)": F.when(ev, "18.3").otherwise(""), "电池/电池种类": F.lit("磷酸铁锂电池"), "车辆/工信部纯电续航里程(km)": F.lit("-"), "电池/CLTC纯电续航里程(km)": text(50 + size),
        "车辆/工信部油耗(L/100km)(城市/市郊/综合)": F.concat(F.lit("9.1/8.2/"), text(size)), "电池/充电方式": F.when(size % 8 == 4, "快充+慢充").otherwise("慢充,家充"),
    }
    spec = F.create_map(*[x for name, value in entries.items() for x in (F.lit(name), value)])
    issue = lambda *texts: F.array(*[F.struct(F.lit("s").alias("source"), F.lit(x).alias("text")) for x in texts])
    generations = [models.Generation(F.col("year") == 2021, "II", notes="made late", sources={"a": "new", "b": "new"}), models.Generation(F.lit(True), "I", platform="p", notes="made", sources={"a": "new"})]
    k, none = F.col("s_suppkey"), F.lit(None)
    old = t.supplier.select(
        (k * 3).alias("trim_id"), F.concat(F.lit("old_"), k).alias("slug"), F.concat(F.lit("Old "), k).alias("model"), F.when(k % 2 == 0, F.concat(F.lit("key "), k)).alias("trim_key"), (2019 + k % 3).cast("int").alias("my"),
        F.when(k % 2 == 0, F.create_map(F.lit("price"), F.lit("1"))).alias("listing_values"), F.when(k % 3 == 0, F.array(F.lit("check"))).alias("buyer_checks"),
        F.concat(F.lit("n"), k, F.lit(" | more")).alias("notes"), F.create_map(F.lit("a"), F.lit("old"), F.lit("engine"), F.lit("old")).alias("sources"), issue("t", "o").alias("known_issues"),
    )
    years = t.part.select((2020 + size % 3).alias("year")).distinct().withColumn("known_issues", issue("t"))
    out = models.built(trims, t.part.select(F.col("p_partkey").alias("trim_id"), spec.alias("spec")), "x", {"model": "X", "model_cn": "某"}, generations, years, old, 2020, 2021)
    return out.select(
        "slug", "year", F.size("ids").alias("trims_n"), F.col("trims")[0].alias("label"), "trim_key", F.col("status_china").alias("status"), F.col("powertrain_type").alias("powertrain"), "model", "generation", "notes",
        F.try_element_at("listing_values", F.lit("year")).alias("listing_year"), F.size("buyer_checks").alias("checks_n"), F.try_element_at("sources", F.lit("engine")).alias("engine_source"), F.size("sources").alias("sources_n"),
        F.size("known_issues").alias("issues_n"), F.col("curb_weight_kg.min").alias("weight_min"), F.col("curb_weight_kg.max").alias("weight_max"), F.col("accel_0_100_s.min").alias("accel_min"), F.col("accel_0_100_s.max").alias("accel_max"),
        F.col("curb_weight_kg.several").alias("several"), F.col("engine.torque_nm").alias("torque"), F.col("match_fingerprint.hp").alias("fingerprint_hp"), F.col("ev_range_km.MIIT").alias("range_km"), F.col("fuel_l_100km.value").alias("fuel"),
        F.col("charging.dc_supported").alias("dc"), F.col("battery.chemistry").alias("chemistry"), "drive", F.col("dimensions_mm.width").alias("width"), "transmission", "verification", "existing",
    )


def _assigned(t: Tables) -> DataFrame:
    """Parts as records with components by rules."""
    size, bolt, own = F.col("p_size"), F.col("p_name").contains("bolt"), F.lit(None).cast("string")
    slug = F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.lit("_"), F.lower("p_type"), F.lit("_"), "p_partkey")
    rows = t.part.select(slug.alias("slug"), "p_partkey", "p_name", "p_size", "p_type", "p_brand")
    print_id = components.fingerprint(components.model_brand(F.concat(F.lit("Deepal "), "p_type")), F.lit("EREV"), F.col("p_brand"), components.motor_powers(F.when(size % 5 > 0, size % 5).cast("double"), (size % 2).cast("double"), size.cast("double")), F.when(size % 3 == 2, F.lit("E-CVT")).otherwise("MT"))
    rules = {
        "engine": [(size % 5 > 0, components.engine_id(components.model_brand(F.col("p_type")), F.col("p_brand"), size * 100, F.lit("NA")), own), (F.lit(True), own, F.lit("no engine code"))],
        "transmission": [(bolt & (size > 25), F.lit("at8"), own), (bolt, own, F.lit("another generation")), (size % 2 == 0, F.lit("dct7"), own), (F.lit(True), own, F.concat(F.lit("no data: "), "p_type"))],
        "hybrid_system": [(size % 3 == 1, own, F.lit("no hybrid")), (print_id.isNotNull(), print_id, own), (F.lit(True), F.lit("dm5"), own)],
    }
    return components.with_components(rows, rules)


_ASSIGNED = """a AS (SELECT lower(replace(p_brand, '#', '-')) || '_' || lower(p_type) || '_' || p_partkey AS slug, lower(replace(p_brand, '#', '-')) || '_' || lower(p_type) AS family, p_partkey,
           CASE WHEN p_size % 5 > 0 THEN 'other_' || lower(p_brand) || '_' || printf('%.1f', p_size * 100 / 1000.0) END AS engine, CASE WHEN p_size % 5 = 0 THEN 'no engine code' END AS why_engine,
           CASE WHEN contains(p_name, 'bolt') THEN CASE WHEN p_size > 25 THEN 'at8' END WHEN p_size % 2 = 0 THEN 'dct7' END AS transmission,
           CASE WHEN contains(p_name, 'bolt') THEN CASE WHEN p_size <= 25 THEN 'another generation' END WHEN p_size % 2 > 0 THEN 'no data: ' || p_type END AS why_transmission,
           CASE p_size % 3 WHEN 2 THEN 'changan_erev_' || lower(p_brand) || '_m' || array_to_string(CASE WHEN p_size % 5 + p_size % 2 = 0 THEN [p_size] ELSE list_filter([p_size % 5, p_size % 2], lambda x: x > 0) END, '-') WHEN 0 THEN 'dm5' END AS hybrid,
           CASE WHEN p_size % 3 = 1 THEN 'no hybrid' END AS why_hybrid FROM part),
       l AS (SELECT slug, family, 'engine' AS kind, engine AS id, why_engine AS why FROM a UNION ALL SELECT slug, family, 'transmission', transmission, why_transmission FROM a UNION ALL SELECT slug, family, 'hybrid_system', hybrid, why_hybrid FROM a)"""


@registered(f"""
    WITH {_ASSIGNED} SELECT p_partkey, engine, transmission, hybrid, coalesce(array_to_string(list_filter([why_engine, why_hybrid, why_transmission], lambda x: x IS NOT NULL), ','), '') AS reasons FROM a""")
def component_assign(t: Tables) -> DataFrame:
    """The components of each record by ordered rules, and why the missing ones are missing."""
    rows = _assigned(t)
    part = lambda kind: F.element_at("components", F.lit(kind))
    why = F.coalesce("components_null_reason", F.create_map().cast("map<string,string>"))
    reasons = F.array_join(F.transform(F.array_sort(F.map_keys(why)), lambda k: F.element_at(why, k)), ",")
    return rows.select("p_partkey", part("engine").alias("engine"), part("transmission").alias("transmission"), part("hybrid_system").alias("hybrid"), reasons.alias("reasons"))


@registered(f"WITH {_ASSIGNED} SELECT kind, why AS reason, count(*) AS records FROM l WHERE id IS NULL GROUP BY ALL")
def component_null_census(t: Tables) -> DataFrame:
    """Why components are missing, counted."""
    return components.null_census(_assigned(t))


@registered(f"WITH {_ASSIGNED} SELECT kind, id, array_to_string(list_sort(list_distinct(list(family))), ',') AS families, count(*) AS records FROM l WHERE id IS NOT NULL GROUP BY ALL")
def component_families(t: Tables) -> DataFrame:
    """The families that each component serves."""
    return components.families(components.links(_assigned(t))).select("kind", "id", F.array_join("families", ",").alias("families"), "records")


@registered(f"WITH {_ASSIGNED} SELECT kind, id, array_to_string(list_sort(list_distinct(list(p_size))), ',') AS batteries, arg_min(p_name, l.slug) AS name FROM l JOIN (SELECT slug, p_partkey FROM a) k ON k.slug = l.slug JOIN part USING (p_partkey) WHERE id IS NOT NULL GROUP BY ALL")
def component_batteries(t: Tables) -> DataFrame:
    """The values of each component's records, sorted, and another column of the first record."""
    rows = _assigned(t)
    found = components.batteries(components.links(rows), rows, "p_size", ["p_name"])
    return found.select("kind", "id", F.array_join(F.transform("batteries", lambda x: x.cast("string")), ",").alias("batteries"), F.col("p_name").alias("name"))


@registered("""
    SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN CASE WHEN s_suppkey % 4 = 0 THEN 'code ' || s_nationkey ELSE s_name END ELSE CASE WHEN s_suppkey % 3 = 0 THEN 'named ' || s_nationkey WHEN s_suppkey % 3 = 1 THEN 'plain ' || s_nationkey ELSE s_name END END AS label FROM supplier""")
def component_labels(t: Tables) -> DataFrame:
    """What components are called: engines by code, others by marketing name, name or id."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    kind = F.when(k % 2 == 0, "engine").otherwise("transmission")
    codes = F.when(k % 4 == 0, F.array(F.concat(F.lit("code "), n), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    name = F.when(k % 3 < 2, F.concat(F.lit("plain "), n)).otherwise("")
    return t.supplier.select("s_suppkey", components.label(kind, codes, F.when(k % 3 == 0, F.concat(F.lit("named "), n)), name, F.col("s_name")).alias("label"))


def _records(t: Tables) -> DataFrame:
    """Parts as finished records."""
    n, text = F.col("p_size"), lambda c: c.cast("string")
    some = lambda count, what: F.transform(F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.lit("s").alias("source"), F.concat(F.lit(what), i + n).alias("text")))
    pair = lambda a, b: F.struct(a.cast("double").alias("min"), b.cast("double").alias("max"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("ICE", "PHEV_parallel", "BEV", "FCEV")]), 1 + n % 4)
    return t.part.select(
        F.concat(F.lit("r_"), "p_partkey").alias("slug"), F.col("p_name").alias("model"), (2020 + n % 7).alias("my"), F.col("p_type").alias("trim_key"), F.when(n % 2 == 0, F.concat(F.lit("gen "), text(n))).alias("generation"),
        F.when(n % 3 > 0, F.array_repeat(F.lit("t"), n % 3)).alias("trims"), kind.alias("powertrain_type"), F.struct(F.when(n % 4 > 0, n / 2).alias("kwh")).alias("battery"),
        F.array(F.struct(F.lit(1.0).alias("battery_kwh"), n.alias("hp")), F.struct(F.lit(2.0).alias("battery_kwh"), (n % 10).alias("hp")), F.struct(F.lit(3.0).alias("battery_kwh"), F.when(n % 3 == 0, n).alias("hp"))).alias("match_fingerprint"),
        F.when(n % 5 > 0, F.struct(F.when(n % 2 == 0, n).alias("hp"), (n / 4).alias("battery_kwh"), F.when(n % 5 == 1, F.concat(F.lit("u"), text(n))).otherwise("").alias("url"))).alias("listing_values"),
        F.when(n % 6 > 0, pair(n * 10, n * 10 + n % 2)).alias("curb_weight_kg"), F.when(n % 8 > 0, pair(n / 8, n / 8 + 1)).alias("accel_0_100_s"), some(n % 4, "own ").alias("known_issues"), some(n % 9, "all ").alias("known_issues_resolved"),
        F.create_map(F.lit("engine"), F.when(n % 2 == 0, F.concat(F.lit("e"), text(n))), F.lit("transmission"), F.lit("t"), F.lit("hybrid_system"), F.lit(None).cast("string")).alias("components"),
        F.element_at(F.array(F.lit("verified"), F.lit("partial"), F.lit("mismatch")), 1 + n % 3).alias("verification"), (n % 11 == 0).alias("listing_copy"),
    )


def _number(sql: str) -> str:
    return f"CASE WHEN ({sql}) = floor({sql}) THEN CAST(CAST({sql} AS BIGINT) AS VARCHAR) ELSE CAST({sql} AS VARCHAR) END"


@registered(f"""
    SELECT 'r_' || p_partkey AS slug, p_name AS model, 2020 + n % 7 AS year, p_type AS trim, CASE WHEN n % 2 = 0 THEN 'gen ' || n ELSE '' END AS generation, n % 3 AS trims_n,
           ['ДВС', 'PHEV', 'BEV', 'FCEV'][1 + n % 4] AS type, CASE WHEN n % 4 > 0 THEN {_number('n / 2.0::DOUBLE')} ELSE '' END AS battery_kwh,
           CASE WHEN n % 3 = 0 THEN CASE WHEN n % 10 = n THEN n::VARCHAR ELSE n || '/' || n % 10 END ELSE CASE WHEN n % 10 = n THEN n::VARCHAR ELSE n || '/' || n % 10 END || '/None' END AS hp_official,
           CASE WHEN n % 5 > 0 AND n % 2 = 0 THEN n::VARCHAR ELSE '' END AS hp_listing, CASE WHEN n % 5 > 0 THEN {_number('n / 4.0::DOUBLE')} ELSE '' END AS battery_listing,
           CASE WHEN n % 6 > 0 THEN CASE WHEN n % 2 = 0 THEN (n * 10)::VARCHAR ELSE n * 10 || '-' || n * 10 + 1 END ELSE '' END AS weight_kg,
           CASE WHEN n % 8 > 0 THEN {_number('n / 8.0::DOUBLE')} || '-' || {_number('n / 8.0::DOUBLE + 1')} ELSE '' END AS accel_0_100_s, CASE WHEN n % 5 = 1 THEN 'да' ELSE '' END AS listing,
           n % 4 AS known_issues, n % 9 AS issues_resolved, CASE WHEN n % 2 = 0 THEN 'e' || n ELSE '' END AS engine_comp, 't' AS transmission_comp, '' AS hybrid_comp, ['verified', 'partial', 'mismatch'][1 + n % 3] AS verification
    FROM (SELECT *, p_size AS n FROM part)""")
def index_full(t: Tables) -> DataFrame:
    """All 20 columns of the index."""
    return report.index_rows(_records(t))


@registered("""
    WITH i AS (SELECT DISTINCT 'own ' || (k + p_size) AS text FROM part, range(1, 4) r(k) WHERE k <= p_size % 4 UNION SELECT 'own ' || s_suppkey % 40 FROM supplier)
    SELECT count(*) AS records, count(*) FILTER (WHERE p_size % 3 = 0) AS verified, count(*) FILTER (WHERE p_size % 3 = 1) AS partial, count(*) FILTER (WHERE p_size % 3 = 2) AS mismatch,
           count(*) FILTER (WHERE p_size % 5 = 1) AS listed, sum(p_size % 9)::BIGINT AS resolved, (SELECT count(*) FROM supplier) AS components, (SELECT count(*) FROM i) AS issues FROM part""")
def record_totals(t: Tables) -> DataFrame:
    """Counts over all records and components: by verification, listed, resolved, distinct issues."""
    own = t.supplier.select(F.array(F.struct(F.lit("s").alias("source"), F.concat(F.lit("own "), F.col("s_suppkey") % 40).alias("text"))).alias("known_issues"))
    return report.totals(_records(t), own)


@registered("SELECT ['verified', 'partial', 'mismatch'][1 + p_size % 3] AS verification, count(*) AS records FROM part WHERE p_size % 11 > 0 GROUP BY 1")
def verification_counts(t: Tables) -> DataFrame:
    """Records by verification, without the copies of listings."""
    return report.by_verification(report.of_originals(_records(t)))


@registered("""
    SELECT c_mktsegment AS language, count(*) FILTER (WHERE c_custkey % 5 > 0 AND c_custkey % 7 > 0) AS translated, count(*) FILTER (WHERE c_custkey % 5 = 0) AS stale, count(*) FILTER (WHERE c_custkey % 5 > 0 AND c_custkey % 7 = 0) AS missing,
           count(*) FILTER (WHERE c_custkey % 5 > 0 AND c_custkey % 7 > 0 AND c_custkey % 3 = 0) AS problems FROM customer GROUP BY 1""")
def translation_report(t: Tables) -> DataFrame:
    """Translated, stale, missing and wrong texts by language."""
    k = F.col("c_custkey")
    rows = t.customer.select(F.col("c_mktsegment").alias("language"), F.when(k % 7 > 0, F.col("c_name")).alias("result"), F.when(k % 5 == 0, "stale").otherwise("ok").alias("status"), F.when(k % 3 == 0, F.array(F.lit("numbers"))).otherwise(F.array().cast("array<string>")).alias("problems"))
    return report.translations(rows)


@registered("SELECT CASE WHEN c.key IS NULL THEN o.key ELSE c.key END AS key, CASE WHEN c.key IS NULL THEN o.text ELSE c.text END AS text, CASE WHEN c.key IS NULL THEN 'stale' ELSE 'ok' END AS status FROM (SELECT c_custkey AS key, c_name AS text FROM customer WHERE c_custkey % 3 > 0) c FULL JOIN (SELECT c_custkey AS key, c_mktsegment AS text FROM customer WHERE c_custkey % 2 = 0) o ON o.key = c.key")
def stale_entries(t: Tables) -> DataFrame:
    """The dictionary after a run: entries of now, and stale ones whose text is gone."""
    from specloom.operators.translate import kept_stale

    old = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("text"))
    return kept_stale(old, t.customer.where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("text")))


@registered("""
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'own' WHEN c_nationkey % 4 > 0 AND s.n > 0 THEN s.texts ELSE '' END AS issues
    FROM customer LEFT JOIN (SELECT s_nationkey, count(*) AS n, string_agg(s_name || '<a' || CASE WHEN s_suppkey % 2 = 0 THEN '+b' ELSE '' END, ';' ORDER BY s_suppkey) AS texts FROM supplier GROUP BY 1) s ON s_nationkey = c_nationkey""")
def issues_by_key(t: Tables) -> DataFrame:
    """Records without issues take those filed under their key."""
    none = F.array().cast("array<struct<text:string,source:string,more_sources:array<string>,review_car:string>>")
    own = F.array(F.struct(F.lit("own").alias("text"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("array<string>").alias("more_sources"), F.lit(None).cast("string").alias("review_car")))
    customers = t.customer.select("c_custkey", "c_nationkey")
    customers = customers.repartition(customers.sparkSession.sparkContext.defaultParallelism, "c_custkey")  # a few bytes become a long text each: dealt out before
    rows = customers.select("c_custkey", F.col("c_custkey").alias("slug"), "c_nationkey", F.when(F.col("c_custkey") % 3 == 0, own).otherwise(none).alias("known_issues"))
    keys = t.customer.where("c_nationkey % 4 > 0").select(F.col("c_custkey").alias("slug"), F.col("c_nationkey").alias("key"))
    issue = F.struct(F.col("s_name").alias("text"), F.lit(None).cast("int").alias("count"), F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("sources"), F.lit("car").alias("review_car"))
    raw = t.supplier.groupBy(F.col("s_nationkey").alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", issue.alias("i")))), lambda x: x["i"]).alias("issues"))
    one = lambda i: F.concat(i["text"], F.coalesce(F.concat(F.lit("<"), i["source"]), F.lit("")), F.coalesce(F.concat(F.lit("+"), F.array_join(i["more_sources"], "+")), F.lit("")))
    out = issues.merged_where_none(rows, keys, raw, lambda known: F.array_join(F.transform(known, one), ";"))
    return out.select("c_custkey", F.col("known_issues").alias("issues"))


_FAMILIES = ["byd_qin-plus", "byd_leopard-7", "lynk-co_900", "zeekr_8x", "toyota_corolla-cross", "changan_cs75-plus", "changan_cs55-plus", "changan_uni-v", "changan_cs75", "changan_eado-phev", "deepal_s07", "zeekr_x"]
_CODES, _BOXES = ["BYD472QC", "JL473ZQ", " ", "JL486Q", "1.5X"], ["8AT", "7DCT", "MT", "E-CVT", "Редуктор 1 ст.", ""]
_GENERATIONS, _TYPES = ["第二代", "第二代+第三代", "第四代", "第四代 冠军版", ""], ["ICE", "PHEV_series_parallel", "EREV", "BEV", ""]
_list = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"


@registered(f"""
    WITH r AS (SELECT p_partkey, {_list(_FAMILIES)}[1 + p_partkey % 12] AS family, nullif(trim({_list(_CODES)}[1 + p_partkey // 12 % 5]), '') AS code, {_list(_BOXES)}[1 + p_size % 6] AS gb, {_list(_GENERATIONS)}[1 + p_partkey // 7 % 5] AS gen,
                      nullif({_list(_TYPES)}[1 + p_partkey // 60 % 5], '') AS pt, 2022 + p_partkey % 4 AS my, p_size FROM part),
         b AS (SELECT *, CASE split_part(split_part(family, '_', 1), '-', 1) WHEN 'deepal' THEN 'changan' ELSE split_part(split_part(family, '_', 1), '-', 1) END AS brand, starts_with(family, 'byd_') AS byd FROM r),
         c AS (SELECT *, brand || '_' || regexp_replace(lower(replace(code, ' ', '')), '^byd', '') || CASE WHEN p_size % 3 = 0 THEN '_1.5' || CASE WHEN p_size % 2 = 0 THEN 't' ELSE '' END WHEN regexp_matches(code, '472|473|469|15') THEN '_1.5' || CASE WHEN p_size % 2 = 0 THEN 't' ELSE '' END
                              WHEN regexp_matches(code, '486|484|20') THEN '_2.0' || CASE WHEN p_size % 2 = 0 THEN 't' ELSE '' END ELSE '' END AS eid FROM b),
         t AS (SELECT *, CASE WHEN code IS NOT NULL THEN eid END AS engine, CASE WHEN code IS NULL THEN CASE WHEN pt = 'BEV' THEN 'нет ДВС (BEV)' ELSE 'код двигателя неизвестен' END END AS why_engine,
                      CASE WHEN byd THEN CASE WHEN code = 'BYD472QC' OR family = 'byd_leopard-7' THEN 'byd_ehs_ecvt_dm5' ELSE 'byd_ehs_ecvt_dmi4' END WHEN family = 'lynk-co_900' THEN 'lynk_em-p_3dht' WHEN family = 'zeekr_8x' THEN 'zeekr_sep_1dht' WHEN brand = 'toyota' THEN 'toyota_ths5_ecvt'
                           WHEN family = 'changan_cs75-plus' THEN CASE WHEN gb = '8AT' AND (my IN (2022, 2023) AND gen = '第二代' OR my = 2025 AND gen = '第四代') THEN 'aisin_8at' END
                           WHEN family = 'changan_cs55-plus' AND gb = '7DCT' AND starts_with(code, 'JL473') OR family = 'changan_uni-v' AND gb = '7DCT' AND my = 2025 THEN 'changan_bluewhale_7dct_wet' END AS transmission,
                      CASE WHEN byd THEN CASE WHEN code = 'BYD472QC' OR family = 'byd_leopard-7' THEN 'byd_dm_5.0' ELSE 'byd_dmi_4.0' END WHEN family = 'lynk-co_900' THEN 'lynk_em-p' WHEN family = 'zeekr_8x' THEN 'zeekr_sep' WHEN brand = 'toyota' THEN 'toyota_ths_5'
                           WHEN pt IN ('ICE', 'BEV') THEN NULL WHEN code IS NOT NULL AND pt IS NOT NULL AND gb IN ('E-CVT', 'Редуктор 1 ст.') THEN brand || CASE pt WHEN 'EREV' THEN '_erev_' ELSE '_phev_' END || lower(code) || '_m' || CASE WHEN p_size % 5 > 0 THEN '100-' ELSE '' END || '60' END AS hybrid FROM c)
    SELECT p_partkey, engine, transmission, hybrid, why_engine,
           CASE WHEN transmission IS NOT NULL THEN NULL WHEN family = 'changan_cs75-plus' THEN CASE WHEN gb = '8AT' THEN 'Aisin 8AT подтверждён только для 第二代 и 第四代 (2025); здесь другое/смешанное поколение или 6AT' ELSE 'механика: тип/поставщик не подтверждены' END
                WHEN gb = 'Редуктор 1 ст.' THEN 'редуктор EV/EREV — тип/поставщик не указаны' WHEN family IN ('changan_uni-v', 'changan_cs75', 'changan_cs55-plus') AND gb = '7DCT' THEN '7DCT: мокрое сцепление/поставщик для этого года источником не подтверждены'
                WHEN gb = 'E-CVT' THEN 'E-CVT Changan: поколение гибридной трансмиссии не подтверждено' WHEN gb <> '' THEN gb || ': поставщик/поколение не подтверждены' WHEN pt = 'BEV' THEN 'BEV: редуктор, тип/поставщик не указаны' ELSE 'нет данных о трансмиссии' END AS why_transmission,
           CASE WHEN hybrid IS NOT NULL THEN NULL WHEN pt IN ('ICE', 'BEV') THEN 'не гибрид (ICE/BEV)' ELSE 'гибрид без подтверждённого названия и без полного технического отпечатка' END AS why_hybrid FROM t""")
def component_rules_assign(t: Tables) -> DataFrame:
    """The catalogue's own rules for components over records; parts stand for records of its families."""
    n, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (1 + i % len(values)).cast("int"))
    by = lambda d: F.floor(n / d)
    kw = F.struct(F.when(size % 5 > 0, F.lit(100.0)).alias("front_kw"), F.lit(60.0).alias("rear_kw"), F.lit(160.0).alias("power_kw"))
    engine = F.struct(pick(_CODES, by(12)).alias("code"), F.when(size % 3 == 0, F.lit(1498.0)).alias("displacement_cc"), F.when(size % 2 == 0, "turbo").otherwise("NA").alias("aspiration"))
    rows = t.part.select(
        "p_partkey", F.concat(pick(_FAMILIES, n), F.lit("_"), n).alias("slug"), F.replace(F.replace(pick(_FAMILIES, n), F.lit("_"), F.lit(" ")), F.lit("-"), F.lit(" ")).alias("model"), (2022 + n % 4).cast("int").alias("my"),
        pick(_GENERATIONS, by(7)).alias("generation"), pick(_BOXES, size).alias("transmission"), F.nullif(pick(_TYPES, by(60)), F.lit("")).alias("powertrain_type"), engine.alias("engine"), kw.alias("motor"),
    )
    out = component_rules.assigned(rows)
    part = lambda kind: F.element_at("components", F.lit(kind))
    why = lambda kind: F.try_element_at("components_null_reason", F.lit(kind))
    return out.select("p_partkey", part("engine").alias("engine"), part("transmission").alias("transmission"), part("hybrid_system").alias("hybrid"), why("engine").alias("why_engine"), why("transmission").alias("why_transmission"), why("hybrid_system").alias("why_hybrid"))


@registered("""
    WITH t AS (SELECT 'cn_issue' AS kind, 'шум ' || o_orderstatus || o_orderkey % 50 AS text FROM orders UNION SELECT 'cn_scope_note', 'только ' || o_orderkey % 7 FROM orders UNION SELECT 'cn_buyer_check', 'осмотр ' || c_nationkey FROM customer
               UNION SELECT 'cn_note', 'заметка ' || c_nationkey FROM customer UNION SELECT 'cn_note', 'вторая ' || c_mktsegment FROM customer UNION SELECT 'cn_fuel_cycle', '工信部 ' || c_mktsegment FROM customer
               UNION SELECT 'cn_component_name', 'узел ' || s_nationkey FROM supplier UNION SELECT 'cn_component_spec', 'тип ' || s_nationkey % 4 FROM supplier)
    SELECT sha256(text) AS key, text, kind FROM t""")
def translation_texts(t: Tables) -> DataFrame:
    """The texts of nested records and components that need translation, each once, by paths."""
    key = F.col("o_orderkey")
    issue = F.struct(F.concat(F.lit("шум "), "o_orderstatus", key % 50).alias("text"), F.concat(F.lit("только "), key % 7).alias("scope_note"), F.lit("x").alias("review_car"))
    found = t.orders.groupBy("o_custkey").agg(F.collect_list(issue).alias("known_issues"))
    nation = F.col("c_nationkey").cast("string")
    rows = t.customer.join(found, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_custkey").cast("string").alias("slug"), "known_issues", F.array(F.concat(F.lit("осмотр "), nation), F.lit("plain")).alias("buyer_checks"),
        F.concat(F.lit("заметка "), nation, F.lit(" | plain | вторая "), "c_mktsegment").alias("notes"), F.struct(F.concat(F.lit("工信部 "), "c_mktsegment").alias("cycle")).alias("fuel_l_100km"),
    )
    own = F.col("s_nationkey")
    parts = t.supplier.select(F.col("s_suppkey").cast("string").alias("id"), F.concat(F.lit("узел "), own).alias("name"), F.create_map(F.lit("a"), F.array(F.concat(F.lit("тип "), own % 4), F.lit("x"))).alias("specs"))
    return translate.gathered(translate.extracted(rows, translate.RECORD_PATHS, "slug"), translate.extracted(parts, translate.COMPONENT_PATHS, "id", 1))


@registered("""
    WITH t AS (SELECT DISTINCT 'cn_note' AS kind, 'клиент ' || n_name || ' сегмент ' || c_mktsegment AS text, n_nationkey = 0 AS own, n_name AS name, c_mktsegment AS seg FROM customer JOIN nation ON c_nationkey = n_nationkey
               UNION ALL SELECT DISTINCT 'cn_fuel_cycle', '工信部 ' || o_orderpriority, false, o_orderpriority, '' FROM orders UNION ALL SELECT DISTINCT 'cn_status', 'сегмент ' || o_orderstatus, false, '', '' FROM orders),
         r AS (SELECT *, CASE kind WHEN 'cn_note' THEN CASE WHEN own THEN 'client of ' || lower(name) ELSE 'client ' || name END || ' ' || seg || ' segment' WHEN 'cn_fuel_cycle' THEN CASE WHEN name[1] = '1' THEN 'MIIT ' || name END END AS result FROM t)
    SELECT sha256(text) AS key, text, kind, result, CASE WHEN result IS NOT NULL THEN 'fragments' END AS method FROM r""")
def translation_folds(t: Tables) -> DataFrame:
    """Texts translated by the fragments that may occur in them, then by patterns; what keeps a label counts as untranslated."""
    nation = t.nation.select("n_nationkey", "n_name")
    rows = t.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.lit("cn_note").alias("kind"), F.concat(F.lit("клиент "), "n_name", F.lit(" сегмент "), "c_mktsegment").alias("text"))
    rows = rows.union(t.orders.select(F.lit("cn_fuel_cycle"), F.concat(F.lit("工信部 "), "o_orderpriority"))).union(t.orders.select(F.lit("cn_status"), F.concat(F.lit("сегмент "), "o_orderstatus")))
    wanted = rows.distinct().select(text.text_key(F.col("text")).alias("key"), "text", "kind")
    note = F.array(F.lit("cn_note"))
    some = t.region.where("r_regionkey = 0")
    fragments = some.select(F.lit(0).alias("pos"), F.lit("клиент ").alias("source"), F.lit("client ").alias("target"), note.alias("kinds")).union(some.select(F.lit(1), F.lit("сегмент"), F.lit("segment"), note))
    fragments = fragments.union(nation.where("n_nationkey = 0").select(F.lit(2), F.concat(F.lit("клиент "), "n_name"), F.concat(F.lit("client of "), F.lower("n_name")), note))
    phrases = some.select(F.lit("нет такого").alias("source"), F.lit("none").alias("target"))
    return translate.translated(wanted, phrases, fragments, [(["cn_note"], "segment ([A-Z]+)", r"\1 segment"), (["cn_fuel_cycle"], "工信部 1", "MIIT 1")])


@registered("""
    SELECT o_orderkey, CASE o_orderkey % 8 WHEN 2 THEN 'numbers ' || o_orderkey || ' -> ' || (o_orderkey + 1) WHEN 3 THEN 'term BYD' WHEN 4 THEN 'empty' WHEN 5 THEN 'label 国产双擎' WHEN 6 THEN 'cyrillic' WHEN 7 THEN 'letters' ELSE '' END AS problems FROM orders""")
def translation_checks(t: Tables) -> DataFrame:
    """Each of the checks of translations: emptiness, numbers, terms, labels, alphabet, letters of the language."""
    k = F.col("o_orderkey")
    targets = ["price %s000 BYD 国产双擎", "price %s BYD 国产双擎", None, "price %s 国产双擎", " ", "price %s BYD", "цена %s BYD 国产双擎", "qiymet %s min BYD deyer gore 国产"]
    target = F.format_string("price %s BYD 国产", k + 1)
    for n, shown in enumerate(targets):
        if shown is not None:
            target = F.when(k % 8 == n, F.format_string(shown, k) if "%" in shown else F.lit(shown)).otherwise(target)
    source = F.format_string("цена %s тыс. BYD 国产双擎", k)
    found = text.translation_problems(source, target, ("BYD",), ("双擎",), "az")
    return t.orders.select("o_orderkey", F.array_join(found, ";").alias("problems"))


@registered("SELECT p_partkey, 'r' || p_partkey AS slug, row_number() OVER (ORDER BY encode('r' || p_partkey)) AS place FROM part")
def record_order(t: Tables) -> DataFrame:
    """Records in the order of their names, with their places."""
    return records.in_name_order(t.part.select("p_partkey", F.concat(F.lit("r"), "p_partkey").alias("slug")))


@registered("""
    WITH o AS (SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY o_custkey)
    SELECT c_custkey, CASE WHEN k % 3 = 0 THEN 'named ' || k ELSE c_name END AS name, CASE WHEN k % 3 = 1 THEN k::DOUBLE ELSE c_acctbal END AS balance,
           CASE WHEN c_nationkey < 5 AND c_mktsegment = 'BUILDING' THEN 'early builder' WHEN c_nationkey < 5 THEN 'early' WHEN contains(c_mktsegment, 'A') THEN 'late A' ELSE 'other' END AS generation FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def record_overrides(t: Tables) -> DataFrame:
    """Records with corrections from another table where it has any, and their generation by ordered rules."""
    k = F.col("o_orderkey")
    changes = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("o_orderkey"))
    changes = changes.select("c_custkey", F.when(k % 3 == 0, F.concat(F.lit("named "), k)).alias("name"), F.when(k % 3 == 1, k.cast("double")).alias("balance"))
    rows = t.customer.select("c_custkey", F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), "c_nationkey", "c_mktsegment")
    early = F.col("c_nationkey") < 5
    label = build.labelled_generation([(early & (F.col("c_mktsegment") == "BUILDING"), "early builder"), (early, "early"), (F.contains("c_mktsegment", F.lit("A")), "late A")], F.lit("other"))
    return build.overridden(rows, "c_custkey", changes).select("c_custkey", "name", "balance", label.alias("generation"))


@registered("""
    SELECT 'n' || c_nationkey AS family, sum(c_custkey)::BIGINT AS total FROM customer JOIN (SELECT DISTINCT s_nationkey FROM supplier WHERE s_nationkey % 2 = 0) s ON s_nationkey = c_nationkey WHERE c_custkey % 5 > 0 AND c_custkey % 7 > 0 GROUP BY c_nationkey""")
def original_totals(t: Tables) -> DataFrame:
    """Records that may be matched, of allowed names and no copies of listings, summed by group."""
    nation = F.concat(F.lit("n"), "c_nationkey")
    rows = t.customer.select(nation.alias("slug"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_custkey")).alias("trim_id"), F.when(F.col("c_custkey") % 7 == 0, True).alias("listing_copy"))
    allowed = t.supplier.where("s_nationkey % 2 = 0").select(F.concat(F.lit("n"), "s_nationkey").alias("slug"))
    return report.counted(build.originals(rows, allowed), "slug", "trim_id").select(F.col("slug").alias("family"), F.col("trim_id").alias("total"))
