"""Four-valued rules, compiled from trees to Catalyst expressions.

Truth values are F < U < L < T (no, unknown, likely, yes) as TINYINT 0 to 3.
A rule is a dict with one of `all`, `any`, `not`, `fact`, `age`, and maybe
`say`, a text for its explanation. Facts are a MAP<STRING, TINYINT> in which a
missing fact is unknown; an age is an interval of two INT columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = "FULT"
CODE = {name: k for k, name in enumerate(NAMES)}
AGE_LEAST, AGE_MOST = 0, 120
INVERSE = (3, 1, 1, 0)


class Scope:
    """Where a rule finds facts and ages: columns, with some facts or the age set aside for a test."""

    def __init__(self, facts: Column, age_low: Column, age_high: Column, changes: dict[str, int] | None = None):
        self.facts, self.age_low, self.age_high, self.changes = facts, age_low, age_high, changes or {}

    def fact(self, name: str) -> Column:
        if name in self.changes:
            return F.lit(self.changes[name])
        return F.coalesce(F.try_element_at(self.facts, F.lit(name)).cast("int"), F.lit(CODE["U"]))

    def given(self, changes: dict[str, int]) -> Scope:
        return Scope(self.facts, self.age_low, self.age_high, self.changes | changes)

    def aged(self, age: int) -> Scope:
        return Scope(self.facts, F.lit(age), F.lit(age), self.changes)


class Vector(Scope):
    """A scope whose facts are an array of values, none of them null, in the order of `names`."""

    def __init__(self, names: list[str], facts: Column, age_low: Column, age_high: Column, changes: dict[str, int] | None = None):
        super().__init__(facts, age_low, age_high, changes)
        self.places = {name: k for k, name in enumerate(names)}

    def fact(self, name: str) -> Column:
        if name in self.changes:
            return F.lit(self.changes[name])
        return F.get(self.facts, F.lit(self.places[name])).cast("int")

    def given(self, changes: dict[str, int]) -> Vector:
        return Vector(list(self.places), self.facts, self.age_low, self.age_high, self.changes | changes)


def age_truth(bounds: list, low: Column, high: Column) -> Column:
    """T if the whole interval is inside, F if none of it is, else U."""
    least, most = bounds[0], AGE_MOST if bounds[1] is None else bounds[1]
    return F.when((low >= least) & (high <= most), CODE["T"]).when((high < least) | (low > most), CODE["F"]).otherwise(CODE["U"])


def _fold(parts: list[Column], pick: Callable[..., Column], empty: int) -> Column:
    return F.lit(empty) if not parts else parts[0] if len(parts) == 1 else pick(*parts)


def truth(rule: dict, scope: Scope) -> Column:
    """The rule's value as an INT column; never null."""
    return trail(rule, scope)[0]


def trail(rule: dict, scope: Scope) -> tuple[Column, list[tuple[dict, Column]]]:
    """The rule's value and what it says: (text, value) of its nodes with `say`, children first; a `not` says nothing of what is below."""
    said: list[tuple[dict, Column]] = []

    def children(nodes: list[dict]) -> list[Column]:
        found = [trail(n, scope) for n in nodes]
        said.extend(x for _, below in found for x in below)
        return [value for value, _ in found]

    if "all" in rule:
        value = _fold(children(rule["all"]), F.least, CODE["T"])
    elif "any" in rule:
        value = _fold(children(rule["any"]), F.greatest, CODE["F"])
    elif "not" in rule:
        value = F.element_at(F.array(*map(F.lit, INVERSE)), truth(rule["not"], scope) + 1)
    elif "fact" in rule:
        value = scope.fact(rule["fact"])
    elif "age" in rule:
        value = age_truth(rule["age"], scope.age_low, scope.age_high)
    else:
        raise ValueError(f"unknown rule: {sorted(rule)}")
    if "say" in rule:
        said.append((rule["say"], value))
    return value, said


def name_of(value: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, NAMES)), value + 1)


def nodes(rule: dict) -> Iterator[dict]:
    yield rule
    for key in ("all", "any"):
        for child in rule.get(key, []):
            yield from nodes(child)
    if "not" in rule:
        yield from nodes(rule["not"])


def evaluate(rule: dict, facts: dict[str, int], age: tuple[int, int]) -> int:
    """The same value in plain Python, for tests and single records."""
    if "all" in rule:
        return min((evaluate(r, facts, age) for r in rule["all"]), default=CODE["T"])
    if "any" in rule:
        return max((evaluate(r, facts, age) for r in rule["any"]), default=CODE["F"])
    if "not" in rule:
        return INVERSE[evaluate(rule["not"], facts, age)]
    if "fact" in rule:
        return facts.get(rule["fact"], CODE["U"])
    low, high = rule["age"][0], AGE_MOST if rule["age"][1] is None else rule["age"][1]
    return CODE["T"] if low <= age[0] and age[1] <= high else CODE["F"] if age[1] < low or age[0] > high else CODE["U"]


def age_probes(rules: list[dict]) -> list[int]:
    """Ages that stand for all: where some rule's answer may change."""
    bounds = [n["age"] for r in rules for n in nodes(r) if "age" in n]
    edges = {AGE_LEAST, AGE_MOST} | {b[0] for b in bounds} | {b[1] + 1 for b in bounds if b[1] is not None and b[1] < AGE_MOST}
    return sorted(edges)


def any_of(conditions: list[Column], empty: bool = False) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(empty)
