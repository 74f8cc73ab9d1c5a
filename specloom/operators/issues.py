"""Reported issues: binding to configurations, moving to components, consolidation, inheritance with provenance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.functions.parse import years_in
from specloom.operators.firsts import first_rows
from specloom.session import settled

#: Fixed values. Order in which a record inherits from its components, and how each is called.
KINDS = (("engine", "двигатель"), ("transmission", "коробка"), ("hybrid_system", "гибридная система"))
OWN = "модель"
#: Issues of components up to this count are broadcast.
BROADCAST_ISSUES = 50_000


def from_reviews(raw: DataFrame) -> DataFrame:
    """(key, pos, text, source, more_sources, review_car, count) from (key, issues): the first source leads.

    ``more_sources`` is null for an issue with one source; a missing count is the number of sources.
    """
    rows = raw.select("key", F.posexplode("issues").alias("pos", "i"))
    more = F.slice(F.col("i.sources"), 2, F.greatest(F.size("i.sources"), F.lit(1)))
    return rows.select(
        "key", "pos", F.col("i.text").alias("text"), F.try_element_at("i.sources", F.lit(1)).alias("source"), F.when(F.size(more) > 0, more).alias("more_sources"),
        F.col("i.review_car").alias("review_car"), F.coalesce(F.col("i.count"), F.size("i.sources")).alias("count"),
    )


def bound(issues: DataFrame, groups: DataFrame, rule: Column | None = None) -> DataFrame:
    """Issues joined to the configurations they tell of: by ``rule`` where it is not null, else by the reviewed car's years.

    ``issues`` has key, pos and review_car, ``groups`` key and year; ``rule`` may read both. The years are exploded,
    so the join is an equality of key and year, not a range. Issues without a car bind by rule only.
    """
    years = issues.select("key", "pos", F.explode(years_in(F.coalesce("review_car", F.lit("")))).alias("year"), F.lit(True).alias("_by_year"))
    both = issues.join(groups, "key").join(years, ["key", "pos", "year"], "left")
    fits = F.coalesce(F.col("_by_year"), F.lit(False))
    return both.where(fits if rule is None else F.coalesce(rule, fits)).drop("_by_year")


def scoped(issues: DataFrame, scopes: DataFrame) -> DataFrame:
    """Issues with the scope, move and why of their (source, text); the query fails if one has none."""
    found = issues.join(scopes, ["source", "text"], "left")
    checked = F.when(F.col("scope").isNull(), F.raise_error(F.concat(F.lit("issue without scope: "), F.col("text")))).otherwise(F.col("scope"))
    return found.withColumn("scope", checked)


def moved(issues: DataFrame, linked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to components, kept): an issue moves if its scope says so and its record has a component of that kind.

    Kept issues that tell of a unit get a note why: ``no component`` or ``doubt``.
    """
    own = linked.select("slug", F.col("kind").alias("scope"), F.col("id").alias("component"))
    rows = issues.join(own, ["slug", "scope"], "left")
    goes = F.col("move") & F.col("component").isNotNull()
    unit = F.col("scope").isin(*[k for k, _ in KINDS])
    note = F.when(unit & F.col("component").isNull(), "no component").when(unit, "doubt")
    return rows.where(goes), rows.where(~F.coalesce(goes, F.lit(False))).withColumn("scope_note", note)


def consolidated(rows: DataFrame, position: str = "pos") -> DataFrame:
    """One row per (scope, component, source, text): first car, all other sources, models it is reported in, in order."""
    packed = F.array_sort(F.collect_list(F.struct(position, F.coalesce("more_sources", F.array().cast("array<string>")).alias("more"), "model")))
    out = rows.groupBy("scope", "component", "source", "text").agg(F.min_by("review_car", position).alias("review_car"), packed.alias("p"))
    more = F.array_remove(F.array_distinct(F.flatten(F.transform("p", lambda x: x["more"]))), F.col("source"))
    return out.select("scope", "component", "source", "text", "review_car", F.when(F.size(more) > 0, more).alias("more_sources"), F.array_distinct(F.transform("p", lambda x: x["model"])).alias("reported_in"))


def _told(rows: DataFrame) -> DataFrame:
    """``rows`` (slug, text, source, rank, pos, model, own, kind, id, label, reported_in) with where they come from in place of what tells it."""
    called = F.create_map(*[F.lit(x) for pair in KINDS for x in pair])
    here = F.coalesce(F.array_contains("reported_in", F.col("model")), F.lit(False))
    by = F.coalesce(F.nullif(F.array_join("reported_in", ", "), F.lit("")), F.lit("неизвестно"))
    origin = F.concat(F.element_at(called, F.col("kind")), F.lit(" "), F.col("label"), F.lit(", отзыв по "), by, F.when(here, F.lit(" (эта модель)")).otherwise(""))
    return rows.select("slug", "text", "source", "rank", "pos", F.when(~F.col("own"), F.col("id")).alias("component"), F.when(F.col("own"), OWN).otherwise(origin).alias("origin"), (F.col("own") | here).alias("own_model"))


def inherited(own: DataFrame, linked: DataFrame, shared: DataFrame, labels: DataFrame) -> DataFrame:
    """The issues of every record: its own, then those of its engine, transmission and hybrid system that are new to it.

    ``own``: slug, model, pos, text, source. ``linked``: slug, model, kind, id; a component that is linked twice counts once.
    ``shared``: kind, id, pos, text, source, reported_in. ``labels``: kind, id, label. Adds rank, component and origin: where
    the row comes from, by whose reports, and whether this model is among them.
    """
    order = F.create_map(*[F.lit(x) for i, (k, _) in enumerate(KINDS) for x in (k, i + 1)])
    keys, place, none = ["slug", "source", "text"], ["rank", "pos"], F.lit(None).cast("string")
    mine = own.select("slug", none.alias("model"), none.alias("kind"), none.alias("id"), F.lit(True).alias("own"), "text", "source", F.lit(0).alias("rank"), "pos")
    known = settled(shared.join(labels, ["kind", "id"]).withColumn("n", F.monotonically_increasing_id()))
    if known.count() > BROADCAST_ISSUES:
        theirs = linked.join(known, ["kind", "id"]).select("slug", "model", "kind", "id", F.lit(False).alias("own"), "text", "source", F.element_at(order, F.col("kind")).alias("rank"), "pos", "label", "reported_in")
        return first_rows(_told(mine.unionByName(theirs, allowMissingColumns=True)), keys, place)
    # A component may have a large part of all records, so where the components are few they go to the records. These are
    # brought together once, with links in place of issues; their issues are numbers of the known ones until the first are chosen.
    links = linked.select("slug", "model", "kind", "id", F.lit(False).alias("own"))
    records = mine.drop("rank").unionByName(links, allowMissingColumns=True).repartition("slug")
    issue = known.select("kind", "id", F.struct("text", "source", "pos", "n", F.element_at(order, F.col("kind")).alias("rank")).alias("i"))
    rows = records.join(F.broadcast(issue), ["kind", "id"], "left").where(F.col("own") | F.col("i").isNotNull())
    of = lambda c, mine: F.when(F.col("own"), mine).otherwise(F.col(f"i.{c}")).alias(c)
    first = first_rows(rows.select("slug", "model", "own", of("text", F.col("text")), of("source", F.col("source")), of("rank", F.lit(0)), of("pos", F.col("pos")), "i.n"), keys, place)
    return _told(first.join(F.broadcast(known.select("n", "kind", "id", "label", "reported_in")), "n", "left"))


def merged_where_none(records: DataFrame, keys: DataFrame, raw: DataFrame, shown: Callable[[Column], Column] | None = None) -> DataFrame:
    """``records`` (slug, known_issues) without issues take those of their key: (slug, key) and raw issues (key, issues).

    Records with issues, without a key or whose key has none stay as they are. ``shown`` is applied to known_issues: to
    those of a key once, before records take them, as many may share a key.
    """
    issue = F.struct(F.col("text"), F.col("source"), F.col("more_sources"), F.col("review_car"))
    shown = shown or (lambda c: c)
    new = F.transform(F.array_sort(F.collect_list(F.struct("pos", issue.alias("i")))), lambda x: x["i"])
    found = from_reviews(raw).groupBy("key").agg(shown(new).alias("_new"))
    none = F.col("known_issues").isNull() | (F.size("known_issues") == 0)
    own = records.select("*", none.alias("_none"), shown(F.col("known_issues")).alias("_own"))
    rows = own.join(keys.select("slug", F.col("key").alias("_key")), "slug", "left").join(found, F.col("_key") == F.col("key"), "left")
    return rows.select(*[F.when(F.col("_none") & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col("_own")).alias(c) if c == "known_issues" else F.col(c) for c in records.columns])
