"""Shared components of records: ids, assignment by rules, attribute sets, users."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.operators.firsts import distinct_sorted, united

#: Fixed values. Brands that count as another; gearboxes that a fingerprint needs; parts of engine codes that tell litres.
SAME_BRAND = {"deepal": "changan"}
FINGERPRINT_GEARBOXES = ("E-CVT", "Редуктор")
LITRES_BY_CODE = ((("472", "473", "469", "15"), "1.5"), (("486", "484", "20"), "2.0"))


def family(slug: Column) -> Column:
    """The first two parts of a slug."""
    return F.substring_index(slug, "_", 2)


def brand(slug: Column) -> Column:
    out = F.substring_index(slug, "_", 1)
    for a, b in SAME_BRAND.items():
        out = F.when(out == a, F.lit(b)).otherwise(out)
    return out


def displacement(code: Column, cc: Column) -> Column:
    """Litres with one digit: from cubic centimetres, else from parts of the code; null if neither tells."""
    by_code = None
    for parts, litres in LITRES_BY_CODE:
        hit = code.rlike("|".join(parts))
        by_code = (F if by_code is None else by_code).when(hit, F.lit(litres))
    return F.when(cc > 0, F.format_string("%.1f", cc / 1000.0)).otherwise(by_code)


def engine_id(own_brand: Column, code: Column, cc: Column, aspiration: Column) -> Column:
    """``brand_code_litres[t]``: the code in lower case without spaces and a leading ``byd``."""
    plain = F.regexp_replace(F.lower(F.replace(code, F.lit(" "), F.lit(""))), "^byd", "")
    litres = F.concat(displacement(plain, cc), F.when(aspiration == "turbo", "t").otherwise(""))
    return F.concat_ws("_", own_brand, plain, litres)


def fingerprint(own_brand: Column, kind: Column, code: Column, kw: Column, gearbox: Column) -> Column:
    """``brand_type_code_mKW[-KW]`` of a hybrid system; ``kw`` is an array. Null unless every part is there."""
    short = F.when(kind == "PHEV_series_parallel", "phev").when(kind == "EREV", "erev")
    powers = F.filter(kw, lambda x: x.isNotNull() & (x != 0))
    known = code.isNotNull() & (F.size(powers) > 0) & F.exists(F.array(*[gearbox.contains(g) for g in FINGERPRINT_GEARBOXES]), lambda x: x)
    text = F.concat_ws("_", own_brand, short, F.lower(code), F.concat(F.lit("m"), F.array_join(F.transform(powers, lambda x: x.cast("int").cast("string")), "-")))
    return F.when(known & short.isNotNull(), text)


def assigned(rules: Sequence[tuple[Column, Column, Column]]) -> Column:
    """The first rule (condition, id, reason) that holds, as a struct of id and null reason."""
    out = None
    for condition, component, reason in rules:
        made = F.struct(component.cast("string").alias("id"), reason.cast("string").alias("reason"))
        out = (F if out is None else out).when(condition, made)
    return out


def links(records: DataFrame) -> DataFrame:
    """(slug, kind, id) from (slug, components map): one row per component of a record."""
    return records.select("slug", F.explode("components").alias("kind", "id")).where("id is not null")


def used_in(linked: DataFrame) -> DataFrame:
    """(kind, id, used_in): the sorted slugs of each component's records."""
    return linked.groupBy("kind", "id").agg(F.sort_array(F.collect_set("slug")).alias("used_in"))


def value_sets(linked: DataFrame, records: DataFrame, values: Sequence[str]) -> DataFrame:
    """Per component the sorted distinct ``values`` of its records, null for none: one pass, pre-aggregated."""
    return linked.join(records.select("slug", *values), "slug").groupBy("kind", "id").agg(*[distinct_sorted(v).alias(v) for v in values])


def upserted(old: DataFrame, new: DataFrame, key: Sequence[str] = ("kind", "id"), kept: Sequence[str] = ("known_issues",), maps: Sequence[str] = ("sources",)) -> DataFrame:
    """``new`` over ``old``: fields are rebuilt, ``kept`` come from old, ``maps`` unite with new first; others stay.

    Components that only ``old`` has are not touched.
    """
    out = []
    for c in dict.fromkeys([*new.columns, *old.columns]):
        if c in key:
            out.append(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c))
        elif c not in new.columns:
            out.append(F.col(f"o.{c}"))
        elif c not in old.columns:
            out.append(F.col(f"n.{c}"))
        elif c in kept:
            out.append(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c))
        elif c in maps:
            empty = F.create_map().cast(new.schema[c].dataType)
            out.append(united(F.coalesce(F.col(f"o.{c}"), empty), F.coalesce(F.col(f"n.{c}"), empty)).alias(c))
        else:
            out.append(F.when(F.col(f"n.{key[0]}").isNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
    same = [F.col(f"n.{k}") == F.col(f"o.{k}") for k in key]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return new.alias("n").join(old.alias("o"), condition, "full").select(*out)


#: Fixed values. Brands told by a model's name, in this order.
MODEL_BRANDS = (("byd", "byd"), ("changan", "changan"), ("deepal", "changan"), ("lynk", "lynk"), ("zeekr", "zeekr"), ("toyota", "toyota"))


def model_brand(model: Column) -> Column:
    """The brand that a model's name holds first in the order of MODEL_BRANDS, else ``other``."""
    out, name = None, F.lower(F.coalesce(model, F.lit("")))
    for part, brand_name in MODEL_BRANDS:
        out = (F if out is None else out).when(name.contains(part), F.lit(brand_name))
    return out.otherwise("other")


def motor_powers(front: Column, rear: Column, total: Column) -> Column:
    """The powers that a fingerprint names: those of the axles that have one, else the total."""
    axles = F.filter(F.array(front, rear), lambda x: x.isNotNull() & (x != 0))
    return F.when(F.size(axles) > 0, axles).when(total.isNotNull() & (total != 0), F.array(total)).otherwise(F.array().cast("array<double>"))


def with_components(rows: DataFrame, rules: dict[str, Sequence[tuple[Column, Column, Column]]]) -> DataFrame:
    """``rows`` with ``components`` (kind to id) and ``components_null_reason`` (kind to reason, null if there is none).

    ``rules`` has for each kind (condition, id, reason) in order of precedence; the first that holds decides. They are
    data of the caller; no join and no shuffle.
    """
    found = rows.select("*", *[assigned(r).alias(f"_r_{kind}") for kind, r in rules.items()])
    ids = F.create_map(*[x for kind in rules for x in (F.lit(kind), F.col(f"_r_{kind}.id"))])
    reasons = F.create_map(*[x for kind in rules for x in (F.lit(kind), F.when(F.col(f"_r_{kind}.id").isNull(), F.col(f"_r_{kind}.reason")))])
    why = F.map_filter(reasons, lambda k, v: v.isNotNull())
    return found.select(*rows.columns, ids.alias("components"), F.when(F.size(why) > 0, why).alias("components_null_reason"))


def null_census(records: DataFrame) -> DataFrame:
    """(kind, reason, records): why components are missing, by kind."""
    rows = records.select("slug", F.explode("components").alias("kind", "id"), F.col("components_null_reason").alias("why")).where("id is null")
    return rows.groupBy("kind", F.coalesce(F.try_element_at("why", F.col("kind")), F.lit("")).alias("reason")).agg(F.count("*").alias("records"))


def families(linked: DataFrame) -> DataFrame:
    """(kind, id, families, records): the sorted families of each component's records."""
    return linked.groupBy("kind", "id").agg(F.sort_array(F.collect_set(family(F.col("slug")))).alias("families"), F.count("*").alias("records"))


def label(kind: Column, codes: Column, marketing_name: Column, name: Column, own_id: Column) -> Column:
    """What a component is called: an engine by its first code, others by their marketing name or name, else the id."""
    text = lambda c: F.nullif(c, F.lit(""))
    return F.when(kind == "engine", F.coalesce(F.try_element_at(codes, F.lit(1)), own_id)).otherwise(F.coalesce(text(marketing_name), text(name), own_id))


def batteries(linked: DataFrame, records: DataFrame, battery: str = "battery_kwh", first_seen: Sequence[str] = ()) -> DataFrame:
    """Per component the sorted distinct batteries of its records and, of other columns, the first record's by slug."""
    rows = linked.join(records.select("slug", battery, *first_seen), "slug")
    return rows.groupBy("kind", "id").agg(F.sort_array(F.collect_set(battery)).alias("batteries"), *[F.min_by(c, "slug").alias(c) for c in first_seen])
