"""Configuration tables: nested trees to rows, rows to groups with value ranges, groups to slugs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.functions.parse import MISSING_ROW
from specloom.operators.firsts import in_order
from specloom.session import settled

#: The columns that make a configuration.
KEY = ("year", "battery", "motor_kw", "engine_code", "engine_kw", "drive", "power_type", "gearbox")


def flattened(spark: SparkSession, trims: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """(trim_id, pos, path, value) from (trim_id, tree): a walk level by level over ``config`` of categories and items.

    An item's path is the first four letters of its category, a slash, the name of the item right above it with
    ``>`` if there is one, and its own name. Categories whose name holds one of ``skip`` are left out before the walk.
    Each level is kept and the walk ends with the first that is empty, so neither rows nor depth have a bound (a
    recursive query stops at a million rows).
    """
    category, fields = "variant_get(c.value, '$.category_name', 'string')", "variant_get({0}.value, '$.name', 'string') as name, variant_get({0}.value, '$.value', 'string') as value, variant_get({0}.value, '$.child_config_list', 'variant') as children"
    bad = " or ".join(f"contains({category}, '{s}')" for s in skip) or "false"
    level = spark.sql(f"""
        select trim_id, {category} as category, array(c.pos, i.pos) as place, '' as parent, {fields.format("i")}
        from {{trims}}, lateral variant_explode(variant_get(tree, '$.config', 'variant')) c, lateral variant_explode(variant_get(c.value, '$.config_list', 'variant')) i where not ({bad})""", trims=trims)
    rows = None
    while not (level := settled(level)).isEmpty():
        rows = level.drop("children") if rows is None else rows.union(level.drop("children"))
        level = spark.sql(f"select trim_id, category, array_append(place, k.pos) as place, level.name as parent, {fields.format("k")} from {{level}} as level, lateral variant_explode(level.children) k", level=level)
    rows = level.drop("children") if rows is None else rows
    path = F.concat(F.left("category", F.lit(4)), F.lit("/"), F.when(F.col("parent") != "", F.concat("parent", F.lit(">"))).otherwise(""), "name")
    return rows.where("value is not null").select("trim_id", F.col("place").alias("pos"), path.alias("path"), "value")


#: Columns that a table of values may have, one a trim.
WIDEST = 1000


def wide(rows: DataFrame, trims: Sequence | None = None) -> DataFrame:
    """One row per path with a column per trim; rows whose values are all missing go.

    Without ``trims`` the columns are the trims there are, WIDEST at most: more are an error, as a table is for reading.
    """
    if trims is None:
        trims = sorted(r[0] for r in rows.select("trim_id").where("trim_id is not null").distinct().limit(WIDEST + 1).collect())
        if len(trims) > WIDEST:
            raise ValueError(f"more than {WIDEST} trims; name those to show")
    shown = rows.where(~F.col("value").isin(*MISSING_ROW) & F.col("value").isNotNull())
    return shown.groupBy("path").pivot("trim_id", list(trims)).agg(F.max_by("value", "pos"))


def spec_maps(rows: DataFrame) -> DataFrame:
    """(trim_id, spec): each trim's values by path, the last of a repeated path."""
    entries = F.array_sort(F.collect_list(F.struct("pos", "path", "value")))
    return rows.groupBy("trim_id").agg(F.map_from_entries(F.transform(entries, lambda e: F.struct(e["path"], e["value"]))).alias("spec"))


def grouped(trims: DataFrame, key: Sequence[str] = KEY, position: str = "pos", members: Sequence[str] = ("trim_id", "name")) -> DataFrame:
    """One row per key with ``members`` in arrival order; groups come in the order year, battery, motor as texts."""
    return trims.groupBy(*key).agg(in_order(position, *members).alias("members"))


def group_order(df: DataFrame, year: str = "year", *texts: str) -> DataFrame:
    """Rows by year, then by texts in code-point order, a missing one as ``None``."""
    return df.orderBy(year, *[F.coalesce(F.col(t).cast("string"), F.lit("None")) for t in texts])


def value_range(value: Column | str) -> Column:
    """An aggregate: the least and greatest value as a struct; null for a group without values."""
    return F.when(F.count(value) > 0, F.struct(F.min(value).alias("min"), F.max(value).alias("max")))


def shown_range(low: Column, high: Column) -> Column:
    """``low`` alone if the two are equal, else ``low-high``; null without values."""
    return F.when(low == high, low.cast("string")).otherwise(F.concat_ws("-", low.cast("string"), high.cast("string")))


def slug(prefix: Column, year: Column, battery: Column, motor: Column, engine: Column, gearbox_slug: Column, drive: Column) -> Column:
    """``prefix_year_`` and the parts that tell configurations apart: battery, motor, else engine and gearbox; ``awd``."""
    has = lambda c: c.isNotNull() & (c != "")
    code = F.lower(F.replace(engine, F.lit(" "), F.lit("")))
    parts = [
        F.when(has(battery), F.concat(battery, F.lit("kwh"))),
        F.when(has(motor), F.concat(motor, F.lit("kw"))),
        F.when(~F.coalesce(has(battery), F.lit(False)) & has(code), code),
        F.when(~F.coalesce(has(battery), F.lit(False)) & ~F.coalesce(has(motor), F.lit(False)), gearbox_slug),
        F.when(F.contains(drive, F.lit("四驱")), F.lit("awd")),
    ]
    return F.concat(prefix, F.lit("_"), year.cast("string"), F.lit("_"), F.concat_ws("-", *parts))


def without_collisions(df: DataFrame, slug_col: str, code_col: str, order: Sequence[str]) -> DataFrame:
    """Slugs made before in ``order`` get the engine code appended, where there is one; what still repeats gets a number.

    So no two rows share a slug, unless one that is made so is another's own.
    """
    by = ", ".join(order)
    code = F.lower(F.replace(F.col(code_col), F.lit(" "), F.lit("")))
    first = df.withColumn("_nth", F.expr(f"row_number() over (partition by `{slug_col}` order by {by})"))
    first = first.withColumn("_code", F.when((F.col("_nth") > 1) & (code != ""), code))
    nth = F.expr(f"row_number() over (partition by `{slug_col}`, _code order by _nth)")
    named = F.concat_ws("-", slug_col, "_code", F.when(F.col("_again") > 1, F.col("_again").cast("string")))
    return first.withColumn("_again", nth).withColumn(slug_col, named).drop("_nth", "_code", "_again")


def tags(names: Column, pattern: str) -> Column:
    """The distinct matches of a pattern over an array of names, in order, joined by spaces."""
    found = F.flatten(F.transform(names, lambda n: F.regexp_extract_all(n, F.lit(pattern), F.lit(0))))
    return F.array_join(F.array_distinct(found), " ")
