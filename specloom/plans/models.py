"""Records of a model: its trims grouped by year and powertrain, described, named and merged over the records there are."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.functions import classify, parse
from specloom.operators import build, records, specs
from specloom.plans import catalogue
from specloom.session import settled

#: Fixed values. Addresses of a specification table and of a trim's page; sources that are the table unless told otherwise.
TABLE_URL, PAGE_URL = "https://portal.auto.sohu.com/aggr/model/trims/pk?trim_ids=%s&city_code=110000", "https://db.auto.sohu.com/trim_%s/"
TABLE_SOURCES = ("engine", "motor", "battery", "performance", "weight", "dimensions")
#: Fixed values. Paths of the entries whose range over a group counts; what notes say of that, and of a listing's other year.
WEIGHT_PATH, ACCELERATION_PATH = "车身/整备质量(kg)", "车辆基本/官方0-100加速(s)"
RANGE_NOTE = " Масса и разгон — диапазон по комплектациям группы; прочие поля — по sohu %s."
YEAR_NOTE = " Год в объявлении %s, официальный 年款 — %s."
#: The entries that tell configurations apart, beside the year.
KEY_NAMES = {
    "k_battery": catalogue.BATTERY, "k_motor": catalogue.MOTOR_POWER, "k_engine": catalogue.ENGINE_CODE, "k_power": ("最大功率(kW/rpm)",),
    "k_drive": catalogue.DRIVE_NAME, "k_type": catalogue.POWER_TYPE, "k_gearbox": catalogue.GEARBOX_RAW,
}
KEY = ("year", *KEY_NAMES)


class Generation:
    """What is said of the configurations for which ``when`` (a condition on KEY columns) holds."""

    def __init__(self, when: Column, generation: str, platform: str | None = None, notes: str = "", sources: Mapping[str, str] | None = None, trim_key: str | None = None):
        self.when, self.generation, self.platform, self.notes, self.sources, self.trim_key = when, generation, platform, notes, dict(sources or {}), trim_key


def _said(generations: Sequence[Generation], of, kind: str = "string") -> Column:
    """What the first generation that fits says; null if none does."""
    out = F.lit(None).cast(kind)
    for g in reversed(generations):
        value = of(g)
        out = F.when(g.when, F.lit(value).cast(kind) if not isinstance(value, Column) else value).otherwise(out)
    return out


def keyed(trims: DataFrame, spec_maps: DataFrame, first: int = 2020, last: int = 2027) -> DataFrame:
    """``trims`` (trim_id, year, ...) of the years with their entries by name (found), KEY columns and the two measures.

    ``spec_maps`` has (trim_id, spec); a trim without one has no entries. Maps made of small columns are far larger than
    Spark takes them for, so they are shuffled, never broadcast.
    """
    rows = build.wanted(trims, first, last).join(spec_maps.hint("merge"), "trim_id", "left")
    measure = lambda path: parse.first_number(F.try_element_at("spec", F.lit(path)))
    rows = rows.select(*trims.columns, parse.by_name(F.col("spec"), catalogue.SPEC_NAMES).alias("found"), measure(WEIGHT_PATH).alias("weight"), measure(ACCELERATION_PATH).alias("acceleration"))
    trimmed = lambda names: F.coalesce(*[parse.present(F.trim(F.try_element_at("found", F.lit(n)))) for n in names])
    return rows.select("*", *[trimmed(names).alias(c) for c, names in KEY_NAMES.items()])


def grouped(rows: DataFrame) -> DataFrame:
    """One row per KEY of ``keyed`` rows: ids and labels in order, the first trim and its entries, ranges of both measures.

    One aggregation; of the entries only the first trim's are kept.
    """
    member = F.struct("pos", "trim_id", "name", "launched", "price", "on_sale")
    made = rows.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(member)).alias("m"), F.min_by("found", F.struct("pos", "trim_id")).alias("found"),
        *[build.ranged(F.min(c), F.max(c), F.count("*")).alias(c) for c in ("weight", "acceleration")],
    )
    m = F.col("m")
    labels = F.transform(m, lambda x: build.trim_label(x["name"], x["trim_id"], x["launched"], x["price"]))
    status = F.when(F.exists(m, lambda x: F.coalesce(x["on_sale"], F.lit(False))), build.ON_SALE).otherwise(build.OFF_SALE)
    return made.select(*KEY, "found", "weight", "acceleration", m[0].alias("lead"), F.transform(m, lambda x: x["trim_id"]).alias("ids"), labels.alias("trims"), status.alias("status_china"))


def described(groups: DataFrame, prefix: str, model: Mapping[str, str | None], generations: Sequence[Generation] = (), issues: DataFrame | None = None) -> DataFrame:
    """Records of ``groups``, with KEY, ids and slug, not merged yet.

    ``model`` has model and model_cn, and may fix powertrain_type, hybrid_system and transmission. ``issues`` has the
    known_issues (array of source and text) of a year. Slugs come from the key; those made before, in order of the key,
    get the engine code.
    """
    rows = groups.select("*", F.struct(*catalogue.base_record(F.col("found"))).alias("b"))
    texts, none = "array<string>", F.lit(None)
    fixed = lambda name, otherwise: F.lit(model[name]) if model.get(name) else otherwise
    battery, engine, motor = F.col("b.battery"), F.col("b.engine"), F.col("b.motor")
    electric = lambda c: F.when(battery.isNotNull(), c)
    powertrain = fixed("powertrain_type", classify.first_containing(F.col("k_type"), classify.POWERTRAIN))
    one = F.col("ids")[0].cast("string")
    table = F.format_string(TABLE_URL, F.array_join(F.transform("ids", lambda i: i.cast("string")), ","))
    base = F.create_map(F.lit("config_table"), table, F.lit("trim_page"), F.format_string(PAGE_URL, one))
    empty = F.create_map().cast("map<string,string>")
    own = F.coalesce(_said(generations, lambda g: F.create_map(*[F.lit(x) for pair in g.sources.items() for x in pair]).cast("map<string,string>"), "map<string,string>"), empty)
    sources = build.specs_united(build.with_defaults(base, TABLE_SOURCES, table), own, empty)
    several = F.when(F.size("ids") > 1, F.format_string(RANGE_NOTE, one)).otherwise("")
    hp = F.when(battery.isNotNull() & motor.isNotNull(), parse.metric_hp(motor["power_kw"])).otherwise(engine["power_hp"])
    given = F.lit(1.0)
    core = [F.col("weight"), F.when(powertrain == "BEV", given).otherwise(engine["power_kw"])]
    core += [F.when(battery.isNull(), given).otherwise(c) for c in (battery["kwh"], motor["power_kw"])]
    full_name = F.concat_ws(" ", F.lit(model.get("model_cn")), F.concat(F.col("year").cast("string"), F.lit("款")), F.trim("lead.name"))
    trim = F.struct(F.col("lead.trim_id").alias("trim_id"), full_name.alias("name"), F.col("lead.price").alias("price_wan"), F.col("lead.launched").alias("launch"), F.col("lead.on_sale").alias("on_sale"))
    ranges = F.struct(*[none.cast("double").alias(n) for n in ("NEDC", "WLTC", "CLTC")], F.col("b.miit_range_km").alias("MIIT"))
    columns = {
        "model": F.lit(model["model"]), "model_cn": F.lit(model.get("model_cn")).cast("string"), "aliases": F.array().cast(texts), "twin_models": F.array().cast(texts), "my": F.col("year"),
        "trim_key": F.coalesce(_said(generations, lambda g: g.trim_key), F.concat(F.col("year").cast("string"), F.lit("款 "), F.trim("lead.name"))),
        "generation": _said(generations, lambda g: g.generation), "trims": F.col("trims"), "status_china": F.col("status_china"), "powertrain_type": powertrain,
        "hybrid_system": fixed("hybrid_system", none.cast("string")), "platform": _said(generations, lambda g: g.platform), "engine": engine, "motor": motor, "system_power_hp": F.col("b.system_power_hp"),
        "transmission": fixed("transmission", classify.transmission(F.col("k_gearbox"))), "drive": F.col("b.drive"), "battery": battery, "ev_range_km": electric(ranges),
        "consumption_kwh_100km": F.col("b.consumption_kwh_100km"), "fuel_l_100km": electric(F.col("b.fuel_l_100km")), "charging": electric(F.col("b.charging")), "accel_0_100_s": F.col("acceleration"),
        "top_speed_kmh": F.col("b.top_speed_kmh"), "curb_weight_kg": F.col("weight"), "dimensions_mm": F.col("b.dimensions_mm"), "buyer_checks": F.array().cast(texts),
        "match_fingerprint": F.struct(battery["kwh"].alias("battery_kwh"), hp.alias("hp")), "listing_values": none.cast("map<string,string>"), "closest_official": none.cast("string"),
        "turbo_listings": F.array().cast(texts), "sources": sources, "notes": F.trim(F.concat(F.coalesce(_said(generations, lambda g: g.notes), F.lit("")), several)),
        "verification": records.verification(*core), "sohu_trim": trim,
    }
    slug = specs.slug(F.lit(prefix), F.col("year"), F.col("k_battery"), F.col("k_motor"), F.col("k_engine"), classify.gearbox_slug(F.col("k_gearbox")), F.col("k_drive"))
    out = rows.select(*KEY, "ids", slug.alias("slug"), *[c.alias(n) for n, c in columns.items()])
    out = specs.without_collisions(out, "slug", "k_engine", [*KEY, "ids[0]"])
    if issues is None:
        return out.withColumn("known_issues", F.array().cast("array<struct<source: string, text: string>>"))
    return out.join(issues.select("year", "known_issues"), "year", "left")


def with_listing_year(rows: DataFrame, before: str) -> DataFrame:
    """Records whose listing tells no year, of another year than ``before`` said: the listing gets that year, the notes tell both."""
    listing = F.col("listing_values")
    moved = F.coalesce(listing.isNotNull() & ~F.map_contains_key(listing, F.lit("year")) & F.col("existing") & ~F.col(before).eqNullSafe(F.col("my")), F.lit(False))
    shown = F.coalesce(F.col(before).cast("string"), F.lit("None"))
    told = F.map_concat(listing, F.create_map(F.lit("year"), F.col(before).cast("string")))
    return rows.withColumns({"listing_values": F.when(moved, told).otherwise(listing), "notes": F.concat("notes", F.when(moved, F.format_string(YEAR_NOTE, shown, F.col("my").cast("string"))).otherwise(""))})


def merged(rows: DataFrame, old: DataFrame) -> DataFrame:
    """``rows`` of ``described`` over ``old`` (trim_id, slug, my and the columns it has), see ``build.over_existing``; adds existing.

    A group goes by its first trim, which no other has; buyer checks of before stay if there are any.
    """
    before = old.withColumnRenamed("my", "_my") if "my" in old.columns else old.withColumn("_my", F.lit(None).cast("int"))
    keyed_rows = rows.withColumns({"_first": F.col("ids")[0], "_my": F.lit(None).cast("int")})
    out = build.over_existing(keyed_rows, before, ["_first"], (*build.OLD_WINS, "_my", "sohu_trim"))
    return with_listing_year(out, "_my").drop("_first", "_my")


def built(trims: DataFrame, spec_maps: DataFrame, prefix: str, model: Mapping[str, str | None], generations: Sequence[Generation] = (), issues: DataFrame | None = None, old: DataFrame | None = None, first: int = 2020, last: int = 2027) -> DataFrame:
    """The records of a model: one per year and powertrain of its ``trims`` (trim_id, pos, year, name, launched, price, on_sale).

    ``spec_maps`` has (trim_id, spec: path to value); ``old`` the records there are, by trim_id. Trims are joined with their
    entries and grouped, one shuffle each, once even if ``old`` is looked through; null parts of a key are equal to each
    other. No trims give no rows.
    """
    rows = described(grouped(keyed(trims, spec_maps, first, last)), prefix, model, generations, issues)
    return rows.withColumn("existing", F.lit(False)) if old is None else merged(settled(rows), old)
