"""Joins by prefix as joins by equality: what has the length of a prefix is cut from each name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Different lengths of prefixes at most: each name is looked up once for each.
LENGTHS = 256


def pairs(names: DataFrame, name: str, prefixes: DataFrame, prefix: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(name, prefix, carry): each distinct name with each of ``prefixes`` that it begins with. Null and empty ones begin nothing."""
    known = prefixes.select(F.col(prefix).alias("_prefix"), *carry).where("_prefix <> ''")
    lengths = sorted(r[0] for r in known.select(F.length("_prefix")).distinct().limit(LENGTHS + 1).collect())
    if len(lengths) > LENGTHS:
        raise ValueError(f"prefixes of more than {LENGTHS} lengths")
    fits = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("_name"))
    cut = names.select(F.col(name).alias("_name")).where("_name is not null").distinct().select("_name", F.explode(fits).alias("_n"))
    cut = cut.select("_name", F.substring(F.col("_name"), F.lit(1), F.col("_n")).alias("_prefix"))
    return cut.join(known, "_prefix").select(F.col("_name").alias(name), F.col("_prefix").alias(prefix), *carry)


def first_prefixed(rows: DataFrame, key: str, prefixes: DataFrame, prefix: str, position: str, value: str) -> DataFrame:
    """``rows`` with ``value`` of the first prefix, by ``position``, that their key begins with; null for none."""
    found = pairs(rows, key, prefixes, prefix, (position, value)).groupBy(F.col(key).alias("_key")).agg(F.min_by(value, position).alias(value))
    return rows.join(found, F.col(key) == F.col("_key"), "left").drop("_key")
