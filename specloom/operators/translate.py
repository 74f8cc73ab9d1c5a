"""Dictionary translation: texts to translate, exact hits, folded fragments, checks, stale entries."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from specloom.functions.text import CYRILLIC, collapsed, folded, nfc, problems, text_key
from specloom.operators.firsts import first_rows


def _named(pos: int, kind: str):
    return lambda t: F.struct(F.lit(pos).alias("pos"), F.lit(kind).alias("kind"), t.alias("text"))


def texts(records: DataFrame, fields: Mapping[str, Column]) -> DataFrame:
    """(key, text, kind): the distinct translatable texts of ``fields`` (kind to a text or an array of texts).

    The first kind, in the order of ``fields``, that holds a text names it. Texts without Cyrillic letters need none.
    """
    parts = []
    for i, (kind, value) in enumerate(fields.items()):
        array = value if "array" in records.select(value).dtypes[0][1] else F.array(value)
        parts.append(F.transform(array, _named(i, kind)))
    rows = records.select(F.explode(F.flatten(F.array(*[F.coalesce(p, F.array().cast("array<struct<pos:int,kind:string,text:string>>")) for p in parts]))).alias("x")).select("x.*")
    rows = rows.where(F.col("text").rlike(CYRILLIC)).withColumn("key", text_key(F.col("text")))
    return first_rows(rows, ["key"], ["pos", "text"]).select("key", "text", "kind")


class Path(NamedTuple):
    """Where texts of a kind stand: names between dots, ``[]`` after one for the items of an array or the values of a map.

    Texts may be single or in arrays. ``split`` parts them first; ``also`` is a part that makes a text count without Cyrillic letters.
    """

    kind: str
    at: str
    split: str | None = None
    also: str | None = None


#: Fixed values. The texts of records and of components that are translated, in the order in which a text's kind is told.
RECORD_PATHS = (
    Path("cn_issue", "known_issues[].text"), Path("cn_scope_note", "known_issues[].scope_note"), Path("cn_review_car", "known_issues[].review_car"), Path("cn_buyer_check", "buyer_checks"),
    Path("cn_note", "notes", split=" | "), Path("cn_generation", "generation"), Path("cn_status", "status_china"), Path("cn_hybrid_system", "hybrid_system"),
    Path("cn_fuel_cycle", "fuel_l_100km.cycle", also="工信部"), Path("cn_closest_trim", "closest_official.trim"), Path("cn_closest_why", "closest_official.why"),
)
COMPONENT_PATHS = (
    Path("cn_issue", "known_issues[].text"), Path("cn_scope_note", "known_issues[].scope_note"), Path("cn_review_car", "known_issues[].review_car"), Path("cn_component_name", "name"),
    Path("cn_component_note", "note"), Path("cn_component_spec", "specs[]"),
)
#: Fixed values. Kinds whose translation must not hold a part any more.
NOT_LEFT = {"cn_fuel_cycle": "工信部"}


def _leaves(value: Column, kind: DataType, steps: Sequence[str]) -> Column | None:
    """The texts at ``steps`` below a column of type ``kind`` as one array of strings; null if the type has none there."""
    none = F.array().cast("array<string>")
    if isinstance(kind, ArrayType | MapType) and not (steps and steps[0] != "[]"):
        items = value if isinstance(kind, ArrayType) else F.map_values(value)
        inner = kind.elementType if isinstance(kind, ArrayType) else kind.valueType
        if _leaves(F.lit(None), inner, steps[1:]) is None:
            return None
        return F.coalesce(F.flatten(F.transform(items, lambda x: _leaves(x, inner, steps[1:]))), none)
    if isinstance(kind, StructType):
        if steps and steps[0] == "[]":
            parts = [_leaves(value[f.name], f.dataType, steps[1:]) for f in kind.fields]
            parts = [p for p in parts if p is not None]
            return F.concat(*parts) if parts else None
        found = [f for f in kind.fields if steps and f.name == steps[0]]
        return _leaves(value[found[0].name], found[0].dataType, steps[1:]) if found else None
    if isinstance(kind, StringType) and not [s for s in steps if s != "[]"]:
        return F.array(value)
    return None


def _parted(by: str):
    return lambda t: F.split(t, re.escape(by))


def _counts(also: str | None):
    return lambda t: t.rlike(CYRILLIC) | (F.contains(t, F.lit(also)) if also else F.lit(False))


def _placed(kind: str, n: int):
    return lambda t, i: F.struct(F.lit(kind).alias("kind"), t.alias("text"), F.lit(n).alias("path"), i.cast("int").alias("item"))


def extracted(records: DataFrame, paths: Sequence[Path], name: str, source: int = 0) -> DataFrame:
    """(key, kind, text, place): the translatable texts of ``records`` at ``paths``, compiled to one array a record.

    A path whose columns or types are not there gives nothing. ``place`` orders texts by ``source``, the record's ``name`` and the
    paths. Null texts and records give nothing.
    """
    parts = []
    for n, path in enumerate(paths):
        steps = [s for part in path.at.split(".") for s in ([part[:-2], "[]"] if part.endswith("[]") else [part])]
        found = _leaves(F.struct(*[F.col(f"`{c}`") for c in records.columns]), records.schema, steps)
        if found is None:
            continue
        if path.split is not None:
            found = F.flatten(F.transform(F.filter(found, lambda t: t.isNotNull()), _parted(path.split)))
        parts.append(F.transform(F.filter(found, _counts(path.also)), _placed(path.kind, n)))
    if not parts:
        return records.sparkSession.createDataFrame([], "key string, kind string, text string, place struct<source:int,name:string,item:int,path:int>")
    rows = records.select(F.col(name).cast("string").alias("name"), F.explode(F.concat(*parts)).alias("x"))
    issues = F.when(F.col("x.path") < 3, F.col("x.item")).otherwise(F.lit(1 << 30))  # an issue's texts stand together, before all others
    place = F.struct(F.lit(source).alias("source"), "name", issues.alias("item"), F.col("x.path").alias("path"))
    return rows.select(text_key(F.col("x.text")).alias("key"), "x.kind", "x.text", place.alias("place"))


def gathered(*found: DataFrame) -> DataFrame:
    """(key, text, kind): each text of ``extracted`` rows once, of the kind it has first; composed, while the key is of the text as it stands."""
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    once = rows.groupBy("key").agg(F.min_by(F.struct("kind", "text"), F.struct("place", "kind", "text")).alias("x"))
    return once.select("key", nfc(collapsed(F.col("x.text"))).alias("text"), F.col("x.kind").alias("kind"))


#: Patterns at most: they become one expression each, so they must stay data that people write.
MOST_PATTERNS = 500


def _grams(text: Column) -> Column:
    """The distinct runs of three letters of a text."""
    last = F.length(text) - 2
    return F.array_distinct(F.transform(F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(text, i, 3)))


def indexed(fragments: DataFrame, texts: DataFrame) -> DataFrame:
    """``fragments`` (source, target, kinds, pos) with ``gram``: the run of three letters, rarest in ``texts``, under which they are looked up.

    A fold goes from fragment to fragment over the text that those before have left. A run that has no letter that any target has
    stands in that text only if it stands in the first one, as long as no target is empty; so only such runs count, and fragments
    without one have a null gram: they are tried on every text of their kinds.
    """
    letters = fragments.select(F.explode(F.split("target", "")).alias("l")).distinct()  # as many as there are letters
    told = fragments.agg(F.count_if(F.coalesce(F.col("target"), F.lit("")) == "").alias("empty")).first()
    own = fragments.select("pos", "source", F.explode(_grams(F.col("source"))).alias("gram"))
    reached = own.select("gram").distinct().select("gram", F.explode(F.split("gram", "")).alias("l")).join(letters, "l").select("gram").distinct()
    safe = own.join(reached, "gram", "left_anti") if not told["empty"] else own.limit(0)
    seen = texts.select(F.explode(_grams(F.col("text"))).alias("gram")).join(safe.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rare = safe.join(seen, "gram", "left").groupBy("pos", "source").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("gram"))
    return fragments.join(rare, ["pos", "source"], "left")


def may_occur(texts: DataFrame, fragments: DataFrame) -> DataFrame:
    """(key, fragments): for each text (key, text, kind) the fragments of its kind that may occur in it, the longer first.

    Texts meet fragments by equality of kind and gram, so no text is held against all fragments.
    """
    each = indexed(fragments, texts).select("pos", "source", "target", "gram", F.explode("kinds").alias("kind"))
    grams = texts.select("key", "kind", "text", F.explode(_grams(F.col("text"))).alias("gram"))
    hit = grams.join(each.where("gram is not null"), ["kind", "gram"]).where(F.contains("text", F.col("source"))).select("key", "pos", "source", "target")
    loose = texts.select("key", "kind").join(each.where("gram is null"), "kind").select("key", "pos", "source", "target")
    order = F.struct((-F.length("source")).alias("len"), "pos", "source", "target")
    both = hit.union(loose).groupBy("key").agg(F.array_sort(F.collect_set(order)).alias("fragments"))
    return both


def _template(replacement: str) -> str:
    """A replacement that names groups by backslash and number, in the form that the engine takes."""
    return re.sub(r"\\(\d)", r"$\1", replacement.replace("$", r"\$"))


def folded_patterns(text: Column, kind: Column, patterns: Sequence[tuple[Sequence[str], str, str]]) -> Column:
    """Patterns (kinds, expression, replacement) put in one after the other, those of the text's kind only."""
    if len(patterns) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns")
    for kinds, pattern, replacement in patterns:
        text = F.when(kind.isin(*kinds), F.regexp_replace(text, pattern, _template(replacement))).otherwise(text)
    return text


def translated(wanted: DataFrame, phrases: DataFrame, fragments: DataFrame, patterns: Sequence[tuple[Sequence[str], str, str]] = (), not_left: Mapping[str, str] = NOT_LEFT) -> DataFrame:
    """(key, text, kind, result, method): a phrase for the whole text wins, else folded fragments of the text's kind, then patterns.

    A fold counts only if no Cyrillic letter is left, nor what ``not_left`` names for the kind; otherwise result and method are
    null. ``phrases`` has one row per source text (checked: a repeated one fails the query).
    """
    once = phrases.groupBy("source").agg(F.count("*").alias("n"), F.first("target").alias("target"))
    once = once.select("source", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("phrase twice: "), F.col("source")))).otherwise(F.col("target")).alias("target"))
    rows = wanted.join(once, F.col("text") == F.col("source"), "left").drop("source")
    found = may_occur(wanted.join(once, F.col("text") == F.col("source"), "left_anti").select("key", "text", "kind"), fragments)
    none = F.array().cast(found.schema["fragments"].dataType)
    rows = rows.join(found, "key", "left").withColumn("fragments", F.coalesce("fragments", none))
    fold = folded_patterns(folded(F.col("text"), F.col("fragments")), F.col("kind"), patterns)
    rows = rows.withColumn("fold", fold)
    left = F.lit(False)
    for kind, part in not_left.items():
        left = left | ((F.col("kind") == kind) & F.contains("fold", F.lit(part)))
    good = ~F.col("fold").rlike(CYRILLIC) & ~left
    result = F.coalesce(F.col("target"), F.when(good, nfc(collapsed(F.col("fold"))) if patterns else F.col("fold")))
    return rows.select("key", "text", "kind", result.alias("result"), F.when(F.col("target").isNotNull(), "phrase").when(good, "fragments").alias("method"))


def checked(rows: DataFrame, protected: Sequence[str] = (), language: str = "other") -> DataFrame:
    """``rows`` with the array of what is wrong with each result; missing ones have the problem ``missing``."""
    found = problems(F.col("text"), F.col("result"), protected, language)
    return rows.withColumn("problems", F.when(F.col("result").isNull(), F.array(F.lit("missing"))).otherwise(found))


def kept_stale(old: DataFrame, current: DataFrame) -> DataFrame:
    """The dictionary after a run: current entries as ``ok``, old ones whose text is gone as ``stale``."""
    gone = old.join(current, "key", "left_anti").withColumn("status", F.lit("stale"))
    return current.withColumn("status", F.lit("ok")).unionByName(gone, allowMissingColumns=True)
