"""Dictionaries and ordered rules as Column functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values. Parts of powertrain, drive, chemistry and aspiration names, tried in this order, and what they mean.
POWERTRAIN = (("插电", "PHEV_series_parallel"), ("增程", "EREV"), ("纯电", "BEV"), ("油电混合", "HEV"), ("汽油", "ICE"))
DRIVE = (("四驱", "AWD"), ("后驱", "RWD"), ("前驱", "FWD"))
CHEMISTRY = (("磷酸铁锂", "LFP"), ("三元", "NCM"))
ASPIRATION = {"自然吸气": "NA", "涡轮增压": "turbo"}
GEARBOX = (("双离合", "dct"), ("手动", "mt"), ("手自一体", "at"), ("自动", "at"), ("CVT", "cvt"), ("DHT", "dht"))

#: Fixed values. What records call kinds of gearboxes.
TRANSMISSION = {"dct": "DCT", "mt": "MT", "at": "AT", "cvt": "CVT"}


def looked_up(value: Column, names: Mapping[str, str]) -> Column:
    """``names[value]``; values without an entry pass through."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, value), value)


def first_containing(text: Column, rules: Sequence[tuple[str, str]], default: Column | None = None) -> Column:
    """What the first rule whose part is in the text says; else ``default``, or the text itself (empty: null)."""
    out = None
    for part, meaning in rules:
        out = (F if out is None else out).when(text.contains(part), F.lit(meaning))
    return out.otherwise(F.nullif(text, F.lit("")) if default is None else default)


def gearbox_slug(text: Column) -> Column:
    """Leading digits and the kind of gearbox, ``gb`` if unknown; null for none."""
    return F.when(text.isNotNull(), F.concat(F.regexp_extract(text, r"^\d*", 0), first_containing(text, GEARBOX, F.lit("gb"))))


def transmission(text: Column) -> Column:
    """What a record calls a gearbox: first by marks of hybrids and reducers, then by kind; others keep their name, none is null."""
    kind = F.try_element_at(F.create_map(*[F.lit(x) for pair in TRANSMISSION.items() for x in pair]), F.regexp_replace(gearbox_slug(text), r"^\d*", ""))
    return (
        F.when(F.contains(text, F.lit("ECVT")), "E-CVT")
        .when(F.contains(text, F.lit("单速")), "Редуктор 1 ст.")
        .when(F.contains(text, F.lit("DHT")), F.replace(text, F.lit("档"), F.lit("-ступ. ")))
        .otherwise(F.coalesce(kind, F.nullif(text, F.lit(""))))
    )


def without(text: Column, parts: Sequence[str]) -> Column:
    """``text`` with each of ``parts`` removed, one after the other."""
    for p in parts:
        text = F.replace(text, F.lit(p), F.lit(""))
    return text


def contained(text: Column, names: Mapping[str, str]) -> Column:
    """The sorted distinct names whose key is in the text: a join by substring as one pass over a literal."""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in names.items()])
    return F.array_sort(F.array_distinct(F.transform(F.filter(pairs, lambda p: F.contains(text, p["k"])), lambda p: p["v"])))


def origin(title: Column, imported: str = "进口", domestic: str = "国产") -> Column:
    """both, import, domestic or unknown, by the words in a title."""
    a, b = title.contains(imported), title.contains(domestic)
    return F.when(a & b, "both").when(a, "import").when(b, "domestic").otherwise("unknown")
