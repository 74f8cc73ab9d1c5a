"""Text keys, folds and checks as Column functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

CYRILLIC = "[А-Яа-яЁё]"


def collapsed(text: Column) -> Column:
    """Runs of any white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def text_key(text: Column) -> Column:
    """SHA-256 of the collapsed text: the key of a translation."""
    return F.sha2(collapsed(text), 256)


def replaced(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Literal replacements one after the other, longer sources first (ties in the given order)."""
    for old, new in sorted(pairs, key=lambda p: -len(p[0])):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def folded(text: Column, fragments: Column, kind: Column | None = None) -> Column:
    """As ``replaced`` with an array of (source, target, kinds) in data: those of ``kind`` only, in the array's order."""
    chosen = fragments if kind is None else F.filter(fragments, lambda f: F.array_contains(f["kinds"], kind))
    return F.aggregate(chosen, text, lambda t, f: F.replace(t, f["source"], f["target"]))


def numbers_of(text: Column) -> Column:
    """The sorted numbers of a text: thousands commas joined, decimal commas as points."""
    joined = F.regexp_replace(F.regexp_replace(text, r"(?U)(\d),(\d{3})(?!\w)", "$1$2"), r"(\d),(\d)", "$1.$2")
    return F.sort_array(F.regexp_extract_all(joined, F.lit(r"(\d+(?:\.\d+)?)")))


def nfc(text: Column) -> Column:
    """Unicode composition; Spark has none, so this is an Arrow function."""
    compose = F.pandas_udf(lambda s: s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x)), "string")
    return compose(text)


def problems(source: Column, target: Column, protected: Sequence[str] = (), kind: str = "other") -> Column:
    """What is wrong with a translation, as an array of names; empty if nothing is."""
    found = [
        F.when(F.trim(F.coalesce(target, F.lit(""))) == "", "empty"),
        F.when(numbers_of(source) != numbers_of(target), "numbers"),
        F.when(target.rlike(CYRILLIC), "cyrillic"),
    ]
    found += [F.when(source.contains(p) & ~target.contains(p), f"term {p}") for p in protected]
    if kind == "az":
        words = F.size(F.regexp_extract_all(target, F.lit(r"(?U)(\p{L}{4,})")))
        found.append(F.when((words >= 3) & ~target.rlike("[əıöüçşğ]"), "letters"))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


#: Fixed values. Han letters; a thousand as a word; letters of Azerbaijani words, and those that only these have.
HAN, THOUSANDS, AZ_WORD, AZ_LETTERS = "([一-鿿]+)", r"(\d+)\s*тыс\.", "([a-zəıöüçşğ]{4,})", "[əıöüçşğ]"


def lost_labels(source: Column, target: Column, translated: Sequence[str] = ()) -> Column:
    """The Chinese labels of a text that its translation neither has whole nor, after terms that have translations are taken out (the
    longest first), has the rest of."""
    runs = F.regexp_extract_all(source, F.lit(HAN), F.lit(1))

    def rest(run: Column) -> Column:
        for term in sorted(translated, key=len, reverse=True):
            run = F.replace(run, F.lit(term), F.lit(""))
        return run

    return F.filter(runs, lambda r: (rest(r) != "") & ~F.contains(target, rest(r)) & ~F.contains(target, r))


def translation_problems(source: Column, target: Column, protected: Sequence[str] = (), translated_labels: Sequence[str] = (), language: str = "other") -> Column:
    """All that is wrong with a translation, as an array of texts; an empty one has no other problem. Null sources have none but that.

    Numbers must be the same multiset, thousands commas joined, decimal commas as points; ``70 тыс.`` may stand for 70000.
    """
    target = F.coalesce(target, F.lit(""))
    ours, theirs = numbers_of(source), numbers_of(target)
    other = numbers_of(F.regexp_replace(source, THOUSANDS, "$1" + "000"))
    found = [F.when((theirs != ours) & (theirs != other), F.concat(F.lit("numbers "), F.array_join(ours, " "), F.lit(" -> "), F.array_join(theirs, " ")))]
    found += [F.when(F.contains(source, F.lit(p)) & ~F.contains(target, F.lit(p)), F.lit(f"term {p}")) for p in protected]
    labels = F.transform(lost_labels(source, target, translated_labels), lambda r: F.concat(F.lit("label "), r))
    last = [F.when(target.rlike(CYRILLIC), "cyrillic")]
    if language == "az":
        last.append(F.when((F.size(F.regexp_extract_all(target, F.lit(AZ_WORD))) >= 3) & ~target.rlike(AZ_LETTERS), "letters"))
    there = F.concat(F.array(*found), F.coalesce(labels, F.array().cast("array<string>")), F.array(*last))
    return F.when(F.trim(target) == "", F.array(F.lit("empty"))).otherwise(F.filter(there, lambda x: x.isNotNull()))


def replaced_patterns(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Regular expressions replaced one after the other, in the given order; groups are ``$1``."""
    for pattern, new in pairs:
        text = F.regexp_replace(text, pattern, new)
    return text
