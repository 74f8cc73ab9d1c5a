"""Ordered rules as rows: compiled to one expression, and told apart from those that can never decide."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules of one table at most: they become one expression, so they must stay data that people write.
MOST = 2000


class Rule(NamedTuple):
    """One row: what must hold, and what then is said.

    ``family``, ``code`` and ``powertrain`` are lists of which one must fit, whole or, with a final ``*``, as a beginning;
    ``*`` alone is any text but the empty one. ``year`` lists years. ``gearbox`` lists parts of which one must occur (``*``: any
    text). All parts of ``has`` must occur in the generation's label, none of ``lacks``. Empty lists ask for nothing.
    ``id`` or ``reason`` may name computed columns and fields in braces; a rule whose computed id is null does not hold.
    """

    kind: str
    place: int
    id: str | None = None
    reason: str | None = None
    family: Sequence[str] = ()
    code: Sequence[str] = ()
    powertrain: Sequence[str] = ()
    year: Sequence[int] = ()
    gearbox: Sequence[str] = ()
    has: Sequence[str] = ()
    lacks: Sequence[str] = ()


SCHEMA = (
    "kind string, place int, id string, reason string, family array<string>, code array<string>, powertrain array<string>, "
    "year array<int>, gearbox array<string>, has array<string>, lacks array<string>"
)
PATTERNS, FIELDS = ("family", "code", "powertrain"), ("family", "code", "powertrain", "year", "gearbox", "generation")


def read(table: DataFrame) -> list[Rule]:
    """The rules of a table with the columns of SCHEMA, at most MOST; a null list is empty."""
    rows = table.select(*Rule._fields).limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} rules")
    return [Rule(*(tuple(v or ()) if n in (*PATTERNS, "year", "gearbox", "has", "lacks") else v for n, v in r.asDict().items())) for r in rows]


def _any(conditions: Iterable[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _fits(value: Column, pattern: str) -> Column:
    if pattern == "*":
        return value != ""
    return value.startswith(pattern[:-1]) if pattern.endswith("*") else value == pattern


def condition(rule: Rule, fields: Mapping[str, Column]) -> Column:
    """Whether a rule holds; a null field fits nothing, lacks everything."""
    parts = [_any(_fits(fields[n], p) for p in getattr(rule, n)) for n in PATTERNS if getattr(rule, n)]
    if rule.year:
        parts.append(fields["year"].isin(*rule.year))
    if rule.gearbox:
        parts.append(_any(fields["gearbox"] != "" if p == "*" else F.contains(fields["gearbox"], F.lit(p)) for p in rule.gearbox))
    parts += [F.contains(fields["generation"], F.lit(p)) for p in rule.has]
    parts += [~F.coalesce(F.contains(fields["generation"], F.lit(p)), F.lit(False)) for p in rule.lacks]
    out = F.lit(True)
    for p in parts:
        out = out & F.coalesce(p, F.lit(False))
    return out


def _said(template: str | None, values: Mapping[str, Column]) -> tuple[Column, bool]:
    """A text with what stands in braces put in, and whether anything does; null if one of these is."""
    if template is None:
        return F.lit(None).cast("string"), False
    pieces, out, computed = template.replace("}", "{").split("{"), [], False
    for n, piece in enumerate(pieces):
        if n % 2:
            computed = True
            out.append(values[piece].cast("string"))
        elif piece:
            out.append(F.lit(piece))
    return (F.concat(*out) if out else F.lit("")), computed


def compiled(rules: Sequence[Rule], fields: Mapping[str, Column], computed: Mapping[str, Column] | None = None) -> dict[str, list[tuple[Column, Column, Column]]]:
    """For each kind its (condition, id, reason) in order of ``place``, as ``components.with_components`` takes them.

    ``fields`` has the columns of FIELDS; ``computed`` ids that other columns give. No join, no shuffle.
    """
    values = {**fields, **(computed or {})}
    out: dict[str, list[tuple[Column, Column, Column]]] = {}
    for rule in sorted(rules, key=lambda r: r.place):
        own, made = _said(rule.id, values)
        why, _ = _said(rule.reason, values)
        holds = condition(rule, fields)
        out.setdefault(rule.kind, []).append((holds & own.isNotNull() if made else holds, own, why))
    return out


def _within(patterns: Sequence[str], wider: Sequence[str]) -> bool:
    """Whether all that ``patterns`` fit fits one of ``wider`` too."""
    if not wider or not patterns:
        return not wider
    one = lambda p, w: w == "*" or p == w or (w.endswith("*") and p.startswith(w[:-1]))
    return all(any(one(p, w) for w in wider) for p in patterns)


def implies(rule: Rule, earlier: Rule) -> bool:
    """Whether ``earlier`` holds wherever ``rule`` does, as far as the conditions tell one by one."""
    if "{" in (earlier.id or ""):
        return False  # its id may be null
    lists = all(_within(getattr(rule, n), getattr(earlier, n)) for n in PATTERNS)
    years = not earlier.year or (bool(rule.year) and set(rule.year) <= set(earlier.year))
    boxes = not earlier.gearbox or (bool(rule.gearbox) and all(any(w == "*" or (p != "*" and w in p) for w in earlier.gearbox) for p in rule.gearbox))
    has = all(any(w in p for p in rule.has) for w in earlier.has)
    lacks = all(any(p in w for p in rule.lacks) for w in earlier.lacks)
    return lists and years and boxes and has and lacks


def unreachable(rules: Sequence[Rule]) -> list[tuple[Rule, Rule]]:
    """Rules that never decide, each with the first earlier rule of its kind that always holds where it does."""
    out = []
    for rule in sorted(rules, key=lambda r: (r.kind, r.place)):
        before = [e for e in rules if e.kind == rule.kind and e.place < rule.place and implies(rule, e)]
        if before:
            out.append((rule, min(before, key=lambda e: e.place)))
    return out


def decided_by(rules: Sequence[Rule], kind: str, fields: Mapping[str, Column], computed: Mapping[str, Column] | None = None) -> Column:
    """The place of the rule of ``kind`` that decides; null if none holds: for counts of what each rule does."""
    own = sorted((r for r in rules if r.kind == kind), key=lambda r: r.place)
    out = F.lit(None).cast("int")
    for rule, (holds, _, _) in reversed(list(zip(own, compiled(own, fields, computed).get(kind, []), strict=True))):
        out = F.when(holds, F.lit(rule.place)).otherwise(out)
    return out
