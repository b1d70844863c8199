"""I: contracts over nested documents. Constraints are declared, compiled into one projection, and give a row for each violation.

A document is a row whose parts are arrays of structs, so keys, order, sums and references inside it are array expressions: a table of documents is
checked in one scan without a shuffle, and a reference to another document is one join on its key beforehand.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Relative and absolute slack of sums against their budget.
SLACK, LEAST_SLACK = 1e-5, 1e-9


@dataclass(frozen=True)
class Check:
    """A named condition that must not hold. With `part`, it is asked of each element of that array, given the element and its index."""

    name: str
    bad: Callable[..., Column]
    part: str | None = None


# ---------------------------------------------------------------- values


def no_text(value: Column) -> Column:
    return ~F.coalesce(value, F.lit("")).rlike(r"\S")


def no_identifier(value: Column) -> Column:
    """Empty, or with white space in it."""
    return no_text(value) | value.rlike(r"\s")


def not_among(*allowed) -> Callable[[Column], Column]:
    return lambda value: ~F.coalesce(value.isin(*allowed), F.lit(False))


def not_finite(value: Column) -> Column:
    return value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))


def negative(value: Column) -> Column:
    return not_finite(value) | (value < 0)


def not_positive(value: Column) -> Column:
    return not_finite(value) | (value <= 0)


def no_probability(value: Column) -> Column:
    return negative(value) | (value > 1)


def no_digest(value: Column) -> Column:
    """Neither null nor 64 hexadecimal digits."""
    return value.isNotNull() & ~value.rlike("^[0-9a-fA-F]{64}$")


def no_texts(value: Column) -> Column:
    """No list, or one with an empty entry."""
    return value.isNull() | F.exists(value, no_text)


def no_texts_at_all(value: Column) -> Column:
    return no_texts(value) | (F.size(value) == 0)


# ---------------------------------------------------------------- declarations


def field(name: str, path: str, bad: Callable[[Column], Column], part: str | None = None) -> Check:
    """A condition on one value, of the document or of each element of a part."""
    if part is None:
        return Check(name, lambda: bad(F.col(path)))
    return Check(name, lambda e, i: bad(e[path]), part)


def empty(name: str, part: str) -> Check:
    return Check(name, lambda: F.coalesce(F.size(part), F.lit(0)) <= 0)


def repeated(name: str, part: str, key: str) -> Check:
    """An element whose key an earlier element has."""
    return Check(name, lambda e, i: F.array_position(F.transform(part, lambda x: x[key]), e[key]) <= i, part)


def out_of_sequence(name: str, part: str, index: str) -> Check:
    """Indices must be 1, 2, 3, ... in the order of the part."""
    return Check(name, lambda e, i: F.coalesce(e[index] != i + 1, F.lit(True)), part)


def dangling(name: str, part: str, refs: Callable[[Column], Column], known: Callable[[], Column]) -> Check:
    """A reference, up to its '#', that is not among the known keys."""
    return Check(name, lambda e, i: F.exists(refs(e), lambda r: ~F.array_contains(known(), F.substring_index(r, "#", 1))), part)


def wrong_members(name: str, part: str, key: str, expected: Sequence[str]) -> Check:
    """The keys of a part must be exactly the expected ones."""
    return Check(name, lambda: F.array_sort(F.array_distinct(F.transform(part, lambda e: e[key]))) != F.array(*map(F.lit, sorted(expected))))


def off(value: Column, budget: Column) -> Column:
    return F.abs(value - budget) > LEAST_SLACK + SLACK * F.abs(budget)


def total(part: str, value: str) -> Column:
    return F.aggregate(part, F.lit(0.0), lambda a, e: a + F.coalesce(e[value], F.lit(0.0)))


def sweep(name: str, part: str, start: str, end: str) -> Check:
    """Intervals of a part must follow each other without meeting."""
    return Check(name, lambda e, i: e[start] <= F.when(i > 0, F.get(F.col(part), i - 1)[end]).otherwise(-1), part)


def no_partition(name: str, parts: Callable[[], Sequence[Column]], whole: Callable[[], Column]) -> Check:
    """The lists, one after another, must be the whole list in its order."""
    return Check(name, lambda: F.concat(*parts()) != whole())


def if_then(name: str, when: Callable[[], Column], must: Callable[[], Column]) -> Check:
    return Check(name, lambda: when() & ~F.coalesce(must(), F.lit(False)))


def violations(docs: DataFrame, keys: Sequence[str], checks: Sequence[Check]) -> DataFrame:
    """keys, item, violation: a row for each check that a document or an element of it fails; item is '' or part[number], numbers from 1.

    An unknown condition (null) is no violation unless the check says so. A missing part has no elements.
    """
    flag = lambda check, bad: F.when(F.coalesce(bad, F.lit(False)), F.lit(check.name))

    def of_element(part: str, own: list[Check]):
        def names(e: Column, i: Column) -> Column:
            failed = F.array_compact(F.array(*[flag(c, c.bad(e, i)) for c in own]))
            item = F.concat(F.lit(f"{part}["), (i + 1).cast("string"), F.lit("]"))
            return F.transform(failed, lambda v: F.struct(item.alias("item"), v.alias("violation")))

        return names

    found = [F.transform(F.array_compact(F.array(*[flag(c, c.bad()) for c in checks if c.part is None])), lambda v: F.struct(F.lit("").alias("item"), v.alias("violation")))]
    for part in dict.fromkeys(c.part for c in checks if c.part is not None):
        own = [c for c in checks if c.part == part]

        found.append(F.coalesce(F.flatten(F.transform(part, of_element(part, own))), F.array().cast("array<struct<item:string,violation:string>>")))
    return docs.select(*keys, F.inline(F.concat(*found)))
