"""Records: completeness, new over old, copies, matches by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.operators.firsts import united
from specloom.operators.prefix import pairs
from specloom.session import settled


def verification(*core: Column) -> Column:
    """``verified`` if every core field is there, else ``partial``."""
    return F.when(F.forall(F.array(*[c.isNotNull() for c in core]), lambda x: x), "verified").otherwise("partial")


def merged(new: DataFrame, old: DataFrame, key: Sequence[str], old_wins: Sequence[str] = (), maps: Sequence[str] = ()) -> DataFrame:
    """``new`` left-joined to ``old``: ``old_wins`` take the old value where there is one, ``maps`` unite with old first."""
    right = old.select(*key, *[F.col(c).alias(f"_o_{c}") for c in [*old_wins, *maps]])
    both = new.join(right, list(key), "left")
    out = []
    for c in new.columns:
        if c in old_wins:
            out.append(F.coalesce(f"_o_{c}", c).alias(c))
        elif c in maps:
            empty = F.create_map().cast(new.schema[c].dataType)
            out.append(united(F.coalesce(F.col(c), empty), F.coalesce(F.col(f"_o_{c}"), empty)).alias(c))
        else:
            out.append(F.col(c))
    return both.select(*out)


def notes(old: Column, new: Column) -> Column:
    """The old text before its first `` | ``, then the new one."""
    return F.concat_ws(" | ", F.nullif(F.substring_index(old, " | ", 1), F.lit("")), F.nullif(new, F.lit("")))


def by_first_match(groups: DataFrame, ids: str, existing: DataFrame, existing_id: str, key: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """Groups with ``carry`` of the existing record that holds the first of their ids that any record holds."""
    rows = groups.select(*key, F.posexplode(ids).alias("_pos", existing_id))
    found = rows.join(existing.select(existing_id, *carry), existing_id)
    best = found.groupBy(*key).agg(*[F.min_by(c, "_pos").alias(c) for c in carry])
    return groups.join(best, list(key), "left")


def synced_copies(records: DataFrame, key: str, copy_of: str, fields: Sequence[str]) -> DataFrame:
    """Records with ``copy_of`` take ``fields`` from the record it names; others stay, as do copies of none."""
    origin = records.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_f_{f}") for f in fields])
    both = records.join(origin, F.col(copy_of) == F.col("_k"), "left")
    return both.select(*[F.when(F.col("_k").isNotNull(), F.col(f"_f_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in records.columns])


def in_name_order(records: DataFrame, name: str = "slug") -> DataFrame:
    """Records as their files are read: by name in code-point order, with ``place`` from 1.

    Places come from ranges of names: each task numbers its own, on top of how many the ranges before have.
    """
    ranged = settled(records.repartitionByRange(name).withColumn("_part", F.spark_partition_id()))
    sizes = sorted((r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect())  # a row a range
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    first = records.sparkSession.createDataFrame(before, "_part int, _before long")
    place = F.expr(f"row_number() over (partition by _part order by `{name}`)") + F.col("_before")
    return ranged.join(F.broadcast(first), "_part").withColumn("place", place).select(*records.columns, "place")


def unique_prefix(wanted: DataFrame, prefix: str, names: DataFrame, name: str) -> DataFrame:
    """Each prefix with the one name that begins with it; the query fails if there is none or more than one."""
    met = pairs(names, name, wanted.select(prefix).distinct(), prefix).groupBy(prefix).agg(F.count(name).alias("n"), F.first(name).alias(name))
    found = wanted.select(prefix).distinct().join(met, prefix, "left")
    return found.select(prefix, F.when(F.col("n") == 1, F.col(name)).otherwise(F.raise_error(F.concat(F.lit("not one match: "), F.col(prefix)))).alias(name))
