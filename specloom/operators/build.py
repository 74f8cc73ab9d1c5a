"""Records built from groups of trims: the first trim's specification, ranges over all, labels, merge with records before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.functions.parse import first_number, first_present
from specloom.operators import records, specs
from specloom.operators.firsts import united

#: Fixed values. What a status says of a group with a trim on sale, and without.
ON_SALE, OFF_SALE = "в продаже (sohu)", "снята с продажи (sohu)"
#: Fixed values. Fields whose old value stays, where it is not null.
OLD_WINS = (
    "listing_values", "closest_official", "turbo_listings", "verification", "aliases", "twin_models", "trim_key", "hybrid_system", "platform", "transmission",
    "ev_range_km", "charging", "fuel_l_100km", "status_china", "engine", "motor", "battery", "match_fingerprint", "model", "model_cn",
)


def wanted(trims: DataFrame, first: int, last: int) -> DataFrame:
    """Trims of the model years ``first`` to ``last``."""
    return trims.where(F.col("year").between(first, last))


def trim_label(name: Column, trim_id: Column, launched: Column, price: Column) -> Column:
    """``name (sohu id, launch, price 万)``."""
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.concat(F.trim(name), F.lit(" (sohu "), shown(trim_id), F.lit(", "), shown(launched), F.lit(", "), shown(price), F.lit("万)"))


def ranged(low: Column, high: Column, members: Column) -> Column:
    """(min, max, several): a group of one trim has one value, a larger one a range even if its ends are equal."""
    return F.when(low.isNotNull(), F.struct(low.alias("min"), high.alias("max"), (members > 1).alias("several")))


def grouped(trims: DataFrame, key: Sequence[str] = specs.KEY) -> DataFrame:
    """Groups of trims (trim_id, pos, key, name, launched, price, on_sale) with ids, labels, trim_key and status."""
    rows = specs.grouped(trims, key, members=("trim_id", "name", "launched", "price", "on_sale"))
    m = F.col("members")
    ids, labels = F.transform(m, lambda x: x["trim_id"]), F.transform(m, lambda x: trim_label(x["name"], x["trim_id"], x["launched"], x["price"]))
    status = F.when(F.exists(m, lambda x: F.coalesce(x["on_sale"], F.lit(False))), ON_SALE).otherwise(OFF_SALE)
    trim_key = F.concat(F.col("year").cast("string"), F.lit("款 "), F.trim(m[0]["name"]))
    return rows.select(*key, ids.alias("ids"), labels.alias("trims"), status.alias("status_china"), trim_key.alias("trim_key"))


def measured(groups: DataFrame, spec_maps: DataFrame, values: dict[str, Sequence[str]], key: Sequence[str] = specs.KEY) -> DataFrame:
    """``groups`` with ``spec``, the first trim's map (trim_id, spec), and a range of each of ``values`` (names of entries) over all trims.

    One join of exploded ids with the maps; of them only the numbers and one map a group are kept.
    """
    rows = groups.select(*key, F.size("ids").alias("n"), F.posexplode("ids").alias("pos", "trim_id")).join(spec_maps, "trim_id", "left")
    numbers = {c: first_number(first_present(F.col("spec"), *names)) for c, names in values.items()}
    found = rows.select(*key, "n", F.when(F.col("pos") == 0, F.col("spec")).alias("spec"), *[v.alias(c) for c, v in numbers.items()])
    made = found.groupBy(*[F.col(k) for k in key]).agg(F.first("spec", ignorenulls=True).alias("spec"), *[ranged(F.min(c), F.max(c), F.max("n")).alias(c) for c in values])
    same = None
    for k in key:
        one = groups[k].eqNullSafe(made[k])
        same = one if same is None else same & one
    return groups.join(made, same).select(groups["*"], "spec", *values)


def slugged(rows: DataFrame, prefix: Column, gearbox_slug: Column, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``slug`` from their key; slugs made before get the engine code appended."""
    made = specs.slug(prefix, F.col("year"), F.col("battery"), F.col("motor_kw"), F.col("engine_code"), gearbox_slug, F.col("drive"))
    return specs.without_collisions(rows.withColumn("slug", made), "slug", "engine_code", order)


def over_existing(rows: DataFrame, old: DataFrame, key: Sequence[str], old_wins: Sequence[str] = OLD_WINS) -> DataFrame:
    """``rows`` (with ids, slug, notes, sources, known_issues) merged over the ``old`` record (trim_id and the same columns)
    of the first of their ids that any record has.

    Slug and the fields ``old_wins`` stay as they were, notes begin with the first part of the old ones, sources unite with
    old ones first, issues follow those of before whose source and text they do not repeat, buyer checks of before stay if
    there are any. Adds ``existing``. ``key`` must tell the rows apart and not be null.
    """
    carried = [c for c in old.columns if c in rows.columns]
    renamed = old.select("trim_id", *[F.col(c).alias(f"_o_{c}") for c in carried])
    both = records.by_first_match(rows, "ids", renamed.withColumn("_o_hit", F.lit(True)), "trim_id", list(key), [f"_o_{c}" for c in carried] + ["_o_hit"])
    hit = F.col("_o_hit").isNotNull()
    out = []
    for c in rows.columns:
        own, before = F.col(c), F.col(f"_o_{c}") if c in carried else None
        if before is None:
            out.append(own)
        elif c == "slug" or c in old_wins:
            out.append(F.coalesce(before, own).alias(c))
        elif c == "notes":
            out.append(F.when(hit, records.notes(F.coalesce(before, F.lit("")), own)).otherwise(own).alias(c))
        elif c == "sources":
            empty = F.create_map().cast(rows.schema[c].dataType)
            out.append(specs_united(own, before, empty).alias(c))
        elif c == "known_issues":
            none = F.array().cast(rows.schema[c].dataType)
            new, prior = F.coalesce(own, none), F.coalesce(before, none)
            fresh = F.filter(prior, lambda b: ~F.exists(new, lambda a: (a["source"] == b["source"]) & (a["text"] == b["text"])))
            out.append(F.concat(fresh, new).alias(c))
        elif c == "buyer_checks":
            out.append(F.when(F.size(F.coalesce(before, F.array().cast(rows.schema[c].dataType))) > 0, before).otherwise(own).alias(c))
        else:
            out.append(own)
    return both.select(*out, hit.alias("existing"))


def specs_united(new: Column, old: Column, empty: Column) -> Column:
    """The entries of two maps, null ones empty; the old ones win."""
    return united(F.coalesce(new, empty), F.coalesce(old, empty))


def with_defaults(sources: Column, names: Sequence[str], address: Column) -> Column:
    """``sources`` with ``address`` under each of ``names`` it lacks."""
    lacking = F.filter(F.array(*[F.lit(n) for n in names]), lambda n: ~F.array_contains(F.map_keys(sources), n))
    return F.map_concat(sources, F.map_from_arrays(lacking, F.transform(lacking, lambda _: address)))


def overridden(rows: DataFrame, key: str, changes: DataFrame) -> DataFrame:
    """``rows`` with the values of ``changes`` (key and some of the columns) where it has a row and the value is not null."""
    names = [c for c in changes.columns if c != key]
    right = changes.select(key, *[F.col(c).alias(f"_c_{c}") for c in names])
    both = rows.join(right, key, "left")
    return both.select(*[F.coalesce(f"_c_{c}", c).alias(c) if c in names else F.col(c) for c in rows.columns])


def labelled_generation(rules: Sequence[tuple[Column, str]], default: Column | None = None) -> Column:
    """The label of the first rule (condition, label) that holds: generations by year, engine code or trim names, as data."""
    out = None
    for condition, label in rules:
        out = (F if out is None else out).when(condition, F.lit(label))
    return F.lit(None).cast("string") if out is None else (out if default is None else out.otherwise(default))


def originals(existing: DataFrame, allowed: DataFrame) -> DataFrame:
    """Records (slug, trim_id, listing_copy) that may be matched: allowed slugs with a trim that copy no listing."""
    return existing.where(F.col("trim_id").isNotNull() & ~F.coalesce("listing_copy", F.lit(False))).join(allowed.select("slug").distinct(), "slug", "left_semi")
