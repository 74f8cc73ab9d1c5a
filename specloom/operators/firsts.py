"""First-wins merges, ordered groups and top-N: what dictionaries and lists in arrival order do, with positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in ``order``; columns as they are."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def first_values(df: DataFrame, keys: Sequence[str], position: Column | str, values: Sequence[str]) -> DataFrame:
    """One row per key with each of ``values`` from the key's first row: a pre-aggregated minimum, no sort."""
    return df.groupBy(*keys).agg(*[F.min_by(v, position).alias(v) for v in values])


def appended_unseen(first: DataFrame, second: DataFrame, keys: Sequence[str], position: str = "pos") -> DataFrame:
    """All rows of ``first``, then those of ``second`` whose keys are new, each key once: an ordered anti-join.

    Duplicates within either side keep their first row. The result has ``position`` renumbered from 0 by side and place.
    """
    both = first.withColumn("_side", F.lit(0)).unionByName(second.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    kept = first_rows(both, keys, ["_side", position])
    return kept.drop("_side")


def unseen(first: Column, second: Column, same) -> Column:
    """Array form: ``first`` and those items of ``second`` for which ``same(a, b)`` holds for no ``a`` of ``first``."""
    return F.concat(first, F.filter(second, lambda b: ~F.exists(first, lambda a: same(a, b))))


def in_order(position: Column | str, *fields: Column | str) -> Column:
    """An aggregate: the group's ``fields`` as an array of structs in order of ``position``."""
    packed = F.struct(F.col(position) if isinstance(position, str) else position, *fields)
    return F.array_sort(F.collect_list(packed))


def distinct_sorted(value: Column | str) -> Column:
    """An aggregate: the sorted distinct values, null for a group that has none."""
    found = F.sort_array(F.collect_set(value))
    return F.when(F.size(found) > 0, found)


def united(base: Column, over: Column) -> Column:
    """The entries of two maps; ``over`` wins where both have a key, whatever the session says of duplicates."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(over), k)), over)


def with_failures(good: DataFrame, failed: DataFrame) -> DataFrame:
    """Good rows, then failed ones, as one table: columns that a side lacks are null there."""
    return good.unionByName(failed, allowMissingColumns=True)
