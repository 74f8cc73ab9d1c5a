"""Reports over records: coverage matrix, totals, index rows, regression gate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from specloom.operators.prefix import pairs


def coverage(rows: DataFrame, row: str, column: str, columns: Sequence, names: DataFrame | None = None) -> DataFrame:
    """Counts of ``row`` by ``column``, with zeros and a total per row; ``names`` (one column) adds rows without any.

    The columns are given, so one aggregation with a partial step makes the whole matrix.
    """
    cells = [F.count_if(F.col(column) == c).alias(str(c)) for c in columns]
    found = rows.groupBy(row).agg(*cells, F.count("*").alias("total"))
    if names is not None:
        own = names.columns[0]
        found = names.join(found, names[own] == found[row], "left").select(names[own].alias(row), *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(str(c)) for c in [*columns, "total"]])
    return found


def unmatched(rows: DataFrame, key: str, families: DataFrame, prefix: str) -> DataFrame:
    """Rows whose key begins with no family's prefix."""
    return rows.join(pairs(rows, key, families, prefix).select(key), key, "left_anti")


def counters(df: DataFrame, name: str, conditions: Mapping[str, Column]) -> tuple[DataFrame, Observation]:
    """``df`` and what gathers, in the pass that computes it, how many rows fulfil each of ``conditions``: its ``get`` has them then."""
    told = Observation(name)
    return df.observe(told, *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()]), told


def written(df: DataFrame, path: str, conditions: Mapping[str, Column], mode: str = "errorifexists") -> dict[str, int]:
    """Writes ``df`` and returns its counters, gathered by the same pass."""
    rows, told = counters(df, "written", conditions)
    rows.write.mode(mode).parquet(path)
    return {n: told.get[n] for n in conditions}


def index_row(hp: Column, low: Column, high: Column, issues: Column, name: Column) -> list[Column]:
    """Columns of the index: name, distinct powers joined by a slash, a range, the number of issues and a flag."""
    from specloom.operators.specs import shown_range

    size = F.size(F.coalesce(issues, F.array().cast("array<string>")))
    return [name.alias("name"), F.array_join(F.array_distinct(hp), "/").alias("hp"), shown_range(low, high).alias("range"), size.alias("issues"), F.when(size > 0, "ДА").otherwise("").alias("has_issues")]


def lost(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of ``before`` that ``after`` lacks: what a run must not lose."""
    return before.select(*keys).distinct().join(after.select(*keys).distinct(), list(keys), "left_anti")


def gate(before: dict[str, DataFrame], after: dict[str, DataFrame], keys: dict[str, Sequence[str]], totals: dict[str, tuple[int, int]]) -> list[str]:
    """What is wrong with a run: sets that lost members, totals that fell; empty if it may be written."""
    bad = [f"{name}: {n} lost" for name in before if (n := lost(before[name], after[name], keys[name]).count())]
    return bad + [f"{name}: {a} to {b}" for name, (a, b) in totals.items() if b < a]


#: Fixed values. What powertrains are called in the index; the mark of a record that keeps its listing.
TYPES = {"ICE": "ДВС", "HEV": "HEV", "PHEV_series_parallel": "PHEV", "PHEV_parallel": "PHEV", "EREV": "EREV", "BEV": "BEV"}
LISTED = "да"


def shown_number(value: Column) -> Column:
    """A number as text, whole ones without a fraction."""
    return F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))


def index_rows(records: DataFrame) -> DataFrame:
    """The 20 columns of the index, one row per record.

    ``records``: slug, model, my, trim_key, generation, trims, powertrain_type, battery (kwh), match_fingerprint (array of
    battery_kwh and hp), listing_values (hp, battery_kwh, url), curb_weight_kg and accel_0_100_s (min, max),
    known_issues, known_issues_resolved, components (map), verification.
    """
    from specloom.functions.classify import looked_up

    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).otherwise(0)
    part = lambda kind: blank(F.try_element_at("components", F.lit(kind)))

    def shown(c: str) -> Column:
        low, high = shown_number(F.col(f"{c}.min")), shown_number(F.col(f"{c}.max"))
        return blank(F.when(low == high, low).otherwise(F.concat_ws("-", low, high)))

    hp = F.array_join(F.array_distinct(F.transform("match_fingerprint", lambda x: F.coalesce(x["hp"].cast("string"), F.lit("None")))), "/")
    return records.select(
        "slug", "model", F.col("my").alias("year"), F.col("trim_key").alias("trim"), blank(F.col("generation")).alias("generation"), size("trims").alias("trims_n"),
        looked_up(F.col("powertrain_type"), TYPES).alias("type"), blank(shown_number(F.col("battery.kwh"))).alias("battery_kwh"), blank(hp).alias("hp_official"),
        blank(F.col("listing_values.hp")).alias("hp_listing"), blank(shown_number(F.col("listing_values.battery_kwh"))).alias("battery_listing"),
        shown("curb_weight_kg").alias("weight_kg"), shown("accel_0_100_s").alias("accel_0_100_s"),
        F.when(F.nullif("listing_values.url", F.lit("")).isNotNull(), LISTED).otherwise("").alias("listing"), size("known_issues").alias("known_issues"), size("known_issues_resolved").alias("issues_resolved"),
        part("engine").alias("engine_comp"), part("transmission").alias("transmission_comp"), part("hybrid_system").alias("hybrid_comp"), "verification",
    )


def totals(records: DataFrame, components: DataFrame) -> DataFrame:
    """One row: records by verification, records with a listing, components, distinct issues of both, issues resolved.

    Two pre-aggregated passes and one distinct over (source, text); their single rows are joined.
    """
    kinds = [F.count_if(F.col("verification") == v).alias(v) for v in ("verified", "partial", "mismatch")]
    resolved = F.coalesce(F.sum(F.when(F.col("known_issues_resolved").isNotNull(), F.size("known_issues_resolved"))), F.lit(0))
    listed = F.count_if(F.nullif("listing_values.url", F.lit("")).isNotNull())
    one = records.agg(F.count("*").alias("records"), *kinds, listed.alias("listed"), resolved.alias("resolved"))
    issue = lambda df: df.select(F.explode("known_issues").alias("i")).select("i.source", "i.text")
    distinct = issue(records).union(issue(components)).distinct().agg(F.count("*").alias("issues"))
    return one.crossJoin(components.agg(F.count("*").alias("components"))).crossJoin(distinct)  # one row each


def by_verification(records: DataFrame) -> DataFrame:
    return records.groupBy("verification").agg(F.count("*").alias("records"))


def translations(entries: DataFrame) -> DataFrame:
    """(language, translated, stale, missing, problems) from (language, result, status, problems array)."""
    stale, missing = F.col("status") == "stale", F.col("result").isNull()
    bad = ~stale & ~missing & (F.size("problems") > 0)
    return entries.groupBy("language").agg(
        F.count_if(~stale & ~missing).alias("translated"), F.count_if(stale).alias("stale"), F.count_if(~stale & missing).alias("missing"), F.count_if(bad).alias("problems")
    )


def counted(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The sum of ``value`` by group."""
    return rows.groupBy(group).agg(F.coalesce(F.sum(value), F.lit(0)).alias(value))


def of_originals(records: DataFrame, but: Sequence[str] = ()) -> DataFrame:
    """Records that count in the coverage: no listing's copy and none of the families ``but``."""
    from specloom.operators.components import family

    rows = records.where(~F.coalesce("listing_copy", F.lit(False)))
    return rows.where(~family(F.col("slug")).isin(*but)) if but else rows
