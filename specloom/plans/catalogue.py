"""Whole plans of the catalogue: listings, recalls and records, from fetched pages and specification maps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.functions import classify, dom, parse
from specloom.operators.firsts import first_rows

#: Fixed values. Labels of a listing page and the columns they fill.
LISTING_LABELS = {
    "Şəhər": "city", "Marka": "make", "Model": "model", "Buraxılış ili": "year", "Ban növü": "body", "Rəng": "color", "Mühərrik": "engine_raw", "Yürüş": "mileage_raw",
    "Sürətlər qutusu": "gearbox", "Ötürücü": "drive", "Yeni": "is_new", "Vəziyyəti": "condition", "Hansı bazar üçün yığılıb": "market",
}
#: Fixed values. The class of a listing's properties; what a listing that is gone says.
LISTING_ITEM, GONE = "product-properties__i", "объявление удалено"
#: Fixed values. What values of a listing are called.
FUEL = {"Benzin": "Бензин", "Dizel": "Дизель", "Hibrid": "Гибрид", "Plug-in Hibrid": "Plug-in гибрид (PHEV)", "Elektro": "Электро", "Qaz": "Газ"}
GEARBOX = {"Avtomat": "Автомат", "Mexaniki": "Механика", "Robotlaşdırılmış": "Робот", "Variator": "Вариатор/E-CVT", "Reduktor": "Редуктор"}
DRIVE = {"Ön": "Передний", "Arxa": "Задний", "Tam": "Полный"}
MARKET = {"Çin": "Китай", "Amerika": "США", "Avropa": "Европа", "Koreya": "Корея", "Yaponiya": "Япония", "Rəsmi diler": "Официальный дилер", "Rusiya": "Россия", "BƏƏ": "ОАЭ", "Digər": "Другое"}
#: Fixed values. Words of recall titles.
RECALL, MOTORCYCLE = "召回", "摩托车"
COMMERCIAL = ("货车", "客车", "运输车", "自卸", "商用车", "牵引车", "专用车", "挂车")
#: Fixed values. Elements that hold the text of a recall, in this order; its number.
BODIES = (
    ("div", "class", "article"), ("div", "id", "content"), ("div", "class", "content"), ("div", "class", "view"),
    ("div", "class", "TRS_Editor"), ("div", "class", "trs_editor_view"), ("div", "id", "zoom"), ("div", "class", "article-content"),
)
RECALL_NUMBER = "召回编号[:：]?\\s*([A-Z0-9]+)"


def listings(pages: DataFrame) -> DataFrame:
    """One row per page (url, status, html, error): fields of the listing, price in manat, whether it fits the budget.

    Pages that failed keep their error and have null fields.
    """
    rows = pages.select("url", F.coalesce("error", F.when(F.col("status") == 404, GONE)).alias("error"), dom.listing(F.col("html"), LISTING_LABELS, LISTING_ITEM).alias("f"))
    named = lambda column: F.try_element_at("f.values", F.lit(column))
    columns = {
        "title": F.coalesce("f.h1", "f.title"),
        "city": named("city"), "make": named("make"), "model": named("model"),
        "year": F.when(named("year").rlike(r"^\d+$"), named("year").try_cast("int")),
        "body": named("body"), "color": named("color"), "engine_raw": named("engine_raw"),
        "mileage_km": parse.digits_only(named("mileage_raw")),
        "gearbox": classify.looked_up(named("gearbox"), GEARBOX), "drive": classify.looked_up(named("drive"), DRIVE),
        "is_new": named("is_new"), "condition": named("condition"), "market": classify.looked_up(named("market"), MARKET),
        "p": parse.price(F.col("f.title"), F.col("f.text")),
    }
    rows = rows.select("url", "error", *[c.alias(n) for n, c in columns.items()])
    rows = rows.select("*", parse.composite(F.col("engine_raw")).alias("e"), F.col("p.amount").alias("price"), F.col("p.currency").alias("currency"))
    azn = parse.to_azn(F.col("price"), F.col("currency"))
    return rows.select(*[c for c in rows.columns if c not in ("p", "e")], "e.engine_l", "e.battery_kwh", "e.hp", classify.looked_up(F.col("e.fuel"), FUEL).alias("fuel"), azn.alias("price_azn"), parse.under_budget(azn).alias("under_budget"))


def listing_order(rows: DataFrame) -> DataFrame:
    """Listings under budget first, then by price; no price and zero last in their class; failed ones at the end."""
    return rows.orderBy(F.col("error").isNotNull(), ~F.coalesce("under_budget", F.lit(False)), F.coalesce(F.nullif("price_azn", F.lit(0)), F.lit(10**9)), "url")


def recall_links(pages: DataFrame, path: str = "/zhdt/art/") -> DataFrame:
    """(href, title, list_date, page): links of list pages that lead to recalls, joined to the page's address.

    Each address once, with what its first link says.
    """
    found = pages.where("html is not null").select("url", F.posexplode(dom.links(F.col("html"), F.col("url"))).alias("pos", "l"))
    kept = found.where(F.contains("l.url", F.lit(path)) & F.contains("l.text", F.lit(RECALL)))
    return first_rows(kept.select(F.col("l.url").alias("href"), F.col("l.text").alias("title"), F.col("l.date").alias("list_date"), F.col("url").alias("page"), "pos"), ["href"], ["page", "pos"]).drop("pos")


def classified_recalls(links: DataFrame, brands: Mapping[str, str], prefixes: Sequence[str] = ()) -> DataFrame:
    """``links`` with brands, origin, motorcycle and commercial, by the title's words; ``prefixes`` are taken out first."""
    title = F.col("title")
    named = classify.contained(classify.without(title, prefixes), brands)
    commercial = F.exists(F.array(*[F.lit(m) for m in COMMERCIAL]), lambda m: F.contains(title, m))
    return links.select("*", named.alias("brands"), classify.origin(title).alias("origin"), F.contains(title, F.lit(MOTORCYCLE)).alias("motorcycle"), commercial.alias("commercial"))


def wanted_recalls(links: DataFrame, brands: Mapping[str, str], prefixes: Sequence[str] = (), commercial: bool = False) -> DataFrame:
    """Recalls of known brands, without motorcycles and (unless asked for) commercial vehicles.

    This stands before the pages are fetched, so that only these are.
    """
    rows = classified_recalls(links, brands, prefixes).where(~F.col("motorcycle") & (F.size("brands") > 0))
    return rows if commercial else rows.where(~F.col("commercial"))


def recalls(links: DataFrame, details: DataFrame) -> DataFrame:
    """Recalls with their detail pages (url, html, error): dates, source, keywords, numbers, units, body."""
    d = details.select(F.col("url").alias("href"), F.col("error").alias("detail_error"), dom.detail(F.col("html"), BODIES).alias("f"))
    rows = links.join(d, "href", "left")
    meta = lambda name: F.try_element_at("f.meta", F.lit(name))
    numbers = F.array_sort(F.array_distinct(F.regexp_extract_all("f.text", F.lit(f"(?U){RECALL_NUMBER}"), F.lit(1))))
    return rows.select(
        *links.columns, "detail_error", F.coalesce(meta("PubDate"), meta("MakeTime")).alias("pub_date"), meta("ContentSource").alias("content_source"), meta("Keywords").alias("keywords"),
        numbers.alias("recall_numbers"), parse.units_sum(F.col("f.text")).alias("affected_units_total"), F.coalesce("f.body", meta("Description"), F.lit("")).alias("body"),
    )


def recall_order(rows: DataFrame) -> DataFrame:
    """Recalls by the page's date, else the list's, as text, the latest first; undated ones at the end."""
    return rows.orderBy(F.desc(F.coalesce(F.nullif("pub_date", F.lit("")), F.nullif("list_date", F.lit("")), F.lit(""))), "href")


#: Fixed values. Names of specification entries, under any category, in the order in which they are tried.
ENGINE_POWER, ENGINE_TORQUE = ("发动机/最大功率(kW/rpm)", "最大功率(kW/rpm)"), ("发动机/最大扭矩(N·m/rpm)", "最大扭矩(N·m/rpm)")
ENGINE_CODE, ENGINE_VOLUME, ENGINE_INTAKE, ENGINE_COMPRESSION = ("发动机型号",), ("汽缸容积(cc)",), ("进气形式",), ("压缩比",)
MOTOR_POWER, MOTOR_TORQUE, MOTOR_TYPE, MOTOR_COUNT = ("电动机总功率(kW)",), ("电动机总扭矩(N·m)",), ("电机类型",), ("电机数",)
FRONT_POWER, REAR_POWER, FRONT_TORQUE, REAR_TORQUE = ("前电动机最大功率(kW)",), ("后电动机最大功率(kW)",), ("前电动机最大扭矩(N·m)",), ("后电动机最大扭矩(N·m)",)
SYSTEM_POWER, GEARBOX_NAME, GEARBOX_RAW, DRIVE_NAME, POWER_TYPE = ("系统综合功率(kW)",), ("变速箱类型", "变速箱"), ("变速箱",), ("驱动方式",), ("动力类型",)
BATTERY, BATTERY_KIND, BATTERY_BRAND, BATTERY_COOLING = ("电池容量(kWh)",), ("电池种类",), ("电芯品牌", "电池品牌"), ("电池冷却方式",)
EV_RANGE, CONSUMPTION = ("工信部纯电续航里程(km)", "CLTC纯电续航里程(km)", "纯电续航里程(km)"), ("百公里耗电量(kWh/100km)",)
FUEL_FIGURES = ("工信部油耗(L/100km)(城市/市郊/综合)", "WLTC综合油耗(L/100km)")
CHARGE_MODE, DC_TIME, DC_SHARE, AC_TIME = ("充电方式",), ("快充时间(小时)",), ("快充电量(%)",), ("慢充时间(小时)",)
DC_POWER, AC_POWER = ("最大快充功率(kW)", "快充功率(kW)"), ("最大慢充功率(kW)", "慢充功率(kW)")
ACCELERATION, TOP_SPEED, WEIGHT, SIZE, WHEELBASE, TANK = ("官方0-100加速(s)",), ("官方最高车速(km/h)",), ("整备质量(kg)",), ("长x宽x高(mm)",), ("轴距(mm)",), ("油箱容积(L)",)
SPEC_NAMES = tuple(dict.fromkeys(n for names in (
    ENGINE_POWER, ENGINE_TORQUE, ENGINE_CODE, ENGINE_VOLUME, ENGINE_INTAKE, ENGINE_COMPRESSION, MOTOR_POWER, MOTOR_TORQUE, MOTOR_TYPE, MOTOR_COUNT, FRONT_POWER, REAR_POWER, FRONT_TORQUE, REAR_TORQUE,
    SYSTEM_POWER, GEARBOX_NAME, GEARBOX_RAW, DRIVE_NAME, POWER_TYPE, BATTERY, BATTERY_KIND, BATTERY_BRAND, BATTERY_COOLING, EV_RANGE, CONSUMPTION, FUEL_FIGURES, CHARGE_MODE, DC_TIME, DC_SHARE, AC_TIME,
    DC_POWER, AC_POWER, ACCELERATION, TOP_SPEED, WEIGHT, SIZE, WHEELBASE, TANK,
) for n in names))
#: Fixed values. A kind of motor, and what records call it.
MAGNET_MOTOR = ("永磁", "PMSM")


def base_record(found: Column) -> list[Column]:
    """The technical columns of a record from its entries by name (``parse.by_name`` with SPEC_NAMES)."""
    text = lambda names: parse.named(found, *names)
    number = lambda names: parse.first_number(text(names))
    power, motor, front, rear = number(ENGINE_POWER), number(MOTOR_POWER), number(FRONT_POWER), number(REAR_POWER)
    some = lambda c: F.coalesce(c != 0, F.lit(False))
    axle = F.when(some(front) & some(rear), "front+rear").when(some(rear), "rear").otherwise("front")
    kind = F.when(text(MOTOR_TYPE).contains(MAGNET_MOTOR[0]), MAGNET_MOTOR[1]).otherwise(text(MOTOR_TYPE))
    size = parse.dimensions(F.when(F.contains(text(SIZE), F.lit("x")), text(SIZE)))
    engine = F.struct(
        text(ENGINE_CODE).alias("code"), number(ENGINE_VOLUME).alias("displacement_cc"), classify.looked_up(text(ENGINE_INTAKE), classify.ASPIRATION).alias("aspiration"),
        number(ENGINE_COMPRESSION).alias("compression"), parse.metric_hp(power).alias("power_hp"), power.alias("power_kw"), number(ENGINE_TORQUE).alias("torque_nm"),
    )
    motors = F.struct(
        kind.alias("type"), number(MOTOR_COUNT).alias("count"), parse.metric_hp(motor).alias("power_hp"), motor.alias("power_kw"), number(MOTOR_TORQUE).alias("torque_nm"), axle.alias("axle"),
        front.alias("front_kw"), rear.alias("rear_kw"), number(FRONT_TORQUE).alias("front_nm"), number(REAR_TORQUE).alias("rear_nm"),
    )
    battery = F.struct(
        number(BATTERY).alias("kwh"), classify.first_containing(text(BATTERY_KIND), classify.CHEMISTRY).alias("chemistry"), text(BATTERY_BRAND).alias("brand"),
        F.lit(None).cast("string").alias("supplier"), text(BATTERY_COOLING).alias("cooling"),
    )
    return [
        classify.first_containing(text(POWER_TYPE), classify.POWERTRAIN).alias("powertrain_type"),
        F.when(some(power), engine).alias("engine"),
        F.when(some(motor), motors).alias("motor"),
        parse.metric_hp(number(SYSTEM_POWER)).alias("system_power_hp"), number(SYSTEM_POWER).alias("system_power_kw"),
        text(GEARBOX_NAME).alias("gearbox_cn"), text(GEARBOX_RAW).alias("gearbox_raw"),
        classify.first_containing(text(DRIVE_NAME), classify.DRIVE).alias("drive"),
        F.when(text(BATTERY).isNotNull(), battery).alias("battery"),
        number(EV_RANGE).alias("miit_range_km"), number(CONSUMPTION).alias("consumption_kwh_100km"), miit_fuel(text(FUEL_FIGURES)).alias("fuel_l_100km"),
        charging(number(DC_TIME), number(AC_TIME), text(CHARGE_MODE), number(DC_POWER), number(AC_POWER), text(DC_SHARE)).alias("charging"),
        number(ACCELERATION).alias("accel_0_100_s"), number(TOP_SPEED).alias("top_speed_kmh"), number(WEIGHT).alias("curb_weight_kg"),
        F.struct(*[size[i].alias(n) for i, n in enumerate(("length", "width", "height"))], number(WHEELBASE).alias("wheelbase")).alias("dimensions_mm"),
        number(TANK).alias("tank_l"), text(POWER_TYPE).alias("power_type"),
    ]


#: Fixed values. The plug that records name.
CONNECTOR = "GB/T"


def charging(fast_h: Column, slow_h: Column, mode: Column, fast_kw: Column | None = None, slow_kw: Column | None = None, share: Column | None = None) -> Column:
    """Charging times and powers, and whether direct current is supported: known by a time or by what the mode names, else null."""
    fast = F.coalesce(fast_h != 0, F.lit(False)) | F.coalesce(mode.contains("快充"), F.lit(False))
    none = F.lit(None)
    return F.struct(
        F.lit(CONNECTOR).alias("connector"), F.when(fast, True).when(mode == "慢充", False).alias("dc_supported"), (none.cast("double") if fast_kw is None else fast_kw).alias("dc_kw"), F.nullif(fast_h, F.lit(0.0)).alias("dc_to_80_h"),
        (none.cast("string") if share is None else share).alias("dc_window_pct"), (none.cast("double") if slow_kw is None else slow_kw).alias("ac_kw"), F.nullif(slow_h, F.lit(0.0)).alias("ac_full_h"),
    )


#: Fixed values. What the last of several consumption figures is.
FUEL_CYCLE = "工信部综合 (с учётом электро)"


def miit_fuel(text: Column) -> Column:
    """The last of the figures given side by side, with the cycle it stands for; null without a number."""
    value = parse.first_number(parse.last_part(text))
    return F.when(value.isNotNull(), F.struct(value.alias("value"), F.lit(FUEL_CYCLE).alias("cycle")))
