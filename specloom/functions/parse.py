"""Numbers, units, prices and dates in text, as Column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values. Texts that stand for a missing value: in records, in the spec table (after trimming), in rows to drop.
MISSING_RECORD = ("", "-", "--", "---", "待查")
MISSING_SPEC = MISSING_RECORD
MISSING_ROW = ("", "-", "None", "--", "---")
#: Fixed values. Metric horsepower in a kilowatt; manat for a unit of each currency; the budget in manat.
HP_PER_KW = 1.35962
RATES = {"AZN": 1.0, "USD": 1.70, "EUR": 1.95}
BUDGET_AZN = 44000
#: Fixed values. Currency signs and their codes.
SIGNS = {"₼": "AZN", "AZN": "AZN", "$": "USD", "USD": "USD", "€": "EUR", "EUR": "EUR"}
#: Fixed values. Words before a count of affected units, the count, ten-thousands and what is counted.
UNIT_TEXT = r"(?U)(?:共计|合计|总计|涉及车辆|涉及|共)\s*约?\s*([\d][\d,，.]*)\s*(万)?\s*余?\s*(?:辆|台)"
#: Fixed values. A price named in a title, and one in a page.
TITLE_PRICE = r"(?iU)qiyməti\s*([\d\s]+?)\s*(AZN|USD|EUR)"
PAGE_PRICE = r"(?U)([\d][\d\s]{2,})\s*(₼|AZN|\$|USD|€|EUR)"


def present(value: Column, missing: tuple[str, ...] = MISSING_RECORD) -> Column:
    """``value``, null where it is one of the ``missing`` texts."""
    return F.when(~value.isin(*missing), value)


def first_present(spec: Column, *names: str, missing: tuple[str, ...] = MISSING_RECORD, trim: bool = False) -> Column:
    """The first of a map's entries ``names``, in this order, that is not missing."""
    values = [F.try_element_at(spec, F.lit(n)) for n in names]
    return F.coalesce(*[present(F.trim(v) if trim else v, missing) for v in values])


def by_name(spec: Column, names: Sequence[str], missing: tuple[str, ...] = MISSING_RECORD, trim: bool = False) -> Column:
    """A map of those of ``names`` that a specification has: what the first entry of that name says that is not missing.

    Keys of ``spec`` are paths ``category/name``; the name is all after the first slash, under any category. Entries come
    in the map's order. Only wanted names are kept before first ones are looked for, so the search is short.
    """
    entries = F.transform(F.map_entries(spec), lambda e: F.struct(F.when(F.contains(e["key"], F.lit("/")), F.substr(e["key"], F.instr(e["key"], "/") + 1)).alias("key"), (F.trim(e["value"]) if trim else e["value"]).alias("value")))
    kept = F.filter(entries, lambda e: e["key"].isin(*dict.fromkeys(names)) & e["value"].isNotNull() & ~e["value"].isin(*missing))

    def firsts(own: Column) -> Column:
        value = lambda k: F.element_at(F.filter(own, lambda e: e["key"] == k), 1)["value"]
        return F.map_from_entries(F.transform(F.array_distinct(F.transform(own, lambda e: e["key"])), lambda k: F.struct(k.alias("key"), value(k).alias("value"))))

    # What a lambda names it evaluates anew for each item, so the kept entries become a variable of their own.
    return F.transform(F.array(kept), firsts)[0]


def named(found: Column, *names: str) -> Column:
    """The value of the first of ``names`` that the map of ``by_name`` has."""
    return F.coalesce(*[F.try_element_at(found, F.lit(n)) for n in names])


def first_number(text: Column) -> Column:
    """The first number of a text as double, thousands commas dropped; null without one."""
    return F.nullif(F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"-?\d+(\.\d+)?", 0), F.lit("")).try_cast("double")


def digits_only(text: Column) -> Column:
    """The digits of a text as an integer; null without any."""
    return F.nullif(F.regexp_replace(text, r"\D", ""), F.lit("")).try_cast("int")


def metric_hp(kw: Column) -> Column:
    """Kilowatts as whole metric horsepower, halves to even; null and zero give null."""
    return F.bround(F.nullif(kw.cast("double"), F.lit(0.0)) * HP_PER_KW).cast("int")


def composite(text: Column) -> Column:
    """``1.5 L / 18.3 kWh / 331 a.g. / fuel`` as a struct of engine_l, battery_kwh, hp and fuel; later parts win.

    Numbers have decimal points; what has a decimal comma is no number with a unit and so counts as fuel.
    """
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "/"), lambda p: F.trim(p)), lambda p: p != "")
    litres, kwh, power = r"^(?:[\d.]+\s*L)\z", r"(?i)^(?:[\d.]+\s*kWh)\z", r"^(?:\d+\s*a\.?\s*g\.?)\z"

    def last(keep) -> Column:
        return F.try_element_at(F.filter(parts, keep), F.lit(-1))

    number = lambda p: F.regexp_extract(p, r"[\d.]+", 0)
    return F.struct(
        number(last(lambda p: p.rlike(litres))).try_cast("double").alias("engine_l"),
        number(last(lambda p: p.rlike(kwh))).try_cast("double").alias("battery_kwh"),
        number(last(lambda p: p.rlike(power))).try_cast("int").alias("hp"),
        last(lambda p: ~(p.rlike(litres) | p.rlike(kwh) | p.rlike(power))).alias("fuel"),
    )


def dimensions(text: Column) -> Column:
    """``4780x1837x1495`` as an array of three numbers, missing ones null."""
    parts = F.split(text, "[xX×*]")
    return F.array(*[first_number(F.get(parts, F.lit(i))) for i in range(3)])


def price(title: Column, body: Column) -> Column:
    """Amount and currency: the price named in the title, else the first amount of three or more digits in the body."""
    named = F.regexp_like(F.coalesce(title, F.lit("")), F.lit(TITLE_PRICE))

    def found(group: int) -> Column:
        return F.nullif(F.when(named, F.regexp_extract(title, TITLE_PRICE, group)).otherwise(F.regexp_extract(body, PAGE_PRICE, group)), F.lit(""))

    codes = F.create_map(*[F.lit(x) for pair in SIGNS.items() for x in pair])
    return F.struct(digits_only(found(1)).alias("amount"), F.try_element_at(codes, F.upper(found(2))).alias("currency"))


def to_azn(amount: Column, currency: Column) -> Column:
    """Whole manat, halves to even; an unknown currency counts as manat, no amount gives null."""
    rates = F.create_map(*[F.lit(x) for pair in RATES.items() for x in pair])
    return F.bround(amount.cast("double") * F.coalesce(F.try_element_at(rates, currency), F.lit(1.0))).cast("int")


def under_budget(azn: Column) -> Column:
    return F.coalesce(azn <= BUDGET_AZN, F.lit(False))


def units_sum(text: Column, pattern: str = UNIT_TEXT) -> Column:
    """The sum over all matches of counts in a text, ten-thousands multiplied out; no match or zero gives null.

    Every match counts, so a total and its parts add up.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))  # one pass over the text; the parts come from its matches
    numbers, scales = (F.transform(found, lambda m: F.regexp_extract(m, pattern, g)) for g in (1, 2))

    def one(number: Column, scale: Column) -> Column:
        value = F.regexp_replace(F.regexp_replace(number, "[,，]", ""), r"\.+$", "").try_cast("double")
        return F.coalesce(F.bround(value * F.when(scale == "万", 10000.0).otherwise(1.0)), F.lit(0.0))

    return F.nullif(F.aggregate(F.zip_with(numbers, scales, one), F.lit(0.0), lambda a, x: a + x).cast("long"), F.lit(0))


def years_in(text: Column) -> Column:
    """The sorted distinct years of a text: every ``20dd`` and all years of ranges ``20dd-20dd`` (hyphen or en dash)."""
    ranges = r"(20\d{2})\s*[–-]\s*(20\d{2})"
    first, last = (F.regexp_extract_all(text, F.lit(ranges), F.lit(g)) for g in (1, 2))
    spans = F.zip_with(first, last, lambda a, b: F.when(a.cast("int") <= b.cast("int"), F.sequence(a.cast("int"), b.cast("int"))).otherwise(F.array().cast("array<int>")))
    single = F.transform(F.regexp_extract_all(text, F.lit(r"(20\d{2})"), F.lit(1)), lambda y: y.cast("int"))
    return F.sort_array(F.array_distinct(F.concat(F.flatten(spans), single)))


def first_date(text: Column) -> Column:
    """The first ``20dd-dd-dd`` of a text."""
    return F.nullif(F.regexp_extract(text, r"20\d{2}-\d{2}-\d{2}", 0), F.lit(""))


def last_part(text: Column, separator: str = "/") -> Column:
    """What follows the last separator: the value that counts in figures given side by side."""
    return F.trim(F.element_at(F.split(text, separator), -1))


def unique_lines(block: Column, prefix: str = "http") -> Column:
    """The lines of a block that begin with ``prefix``, each once, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(block, "\n"), lambda x: F.trim(x)), lambda x: x.startswith(prefix)))
