"""Scalar helpers of the checks as Column expressions; halves go to even everywhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def numeric(value: Column) -> Column:
    """The leading number of an attribute; ".5" and "+5" have none, "1e3" is 1."""
    return F.nullif(F.regexp_extract(value, r"^\s*(-?\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")


def snap(value: Column, grid: float) -> Column:
    return F.bround(value / F.lit(grid)) * F.lit(grid)


def first_least(values: list[Column]) -> Column:
    """Struct (d, i) of the least number and its place, the first of equals; nulls are passed over, of nulls alone the first counts.

    One array of plain numbers: an object for each place would make the row's method too long for the JVM to compile.
    """
    return place_of_least(F.array(*values))


def place_of_least(every: Column) -> Column:
    """The same of an array that is there already."""
    least = F.array_min(every)
    return F.struct(least.alias("d"), F.coalesce(F.array_position(every, least).cast("int") - 1, F.lit(0)).alias("i"))


def nearest(value: Column, scale: tuple[float, ...]) -> Column:
    """The nearest step of a scale, the first of equals."""
    return F.get(F.array(*map(F.lit, scale)), first_least([F.abs(value - F.lit(s)) for s in scale])["i"])


def is_step(value: Column, scale: tuple[float, ...]) -> Column:
    """Whether a value is a step of a scale, but for rounding; the nearest step is not looked for."""
    return reduce(lambda a, b: a | b, [F.abs(value - F.lit(s)) <= F.greatest(F.abs(value), F.abs(F.lit(s))) * 1e-9 for s in scale])


def least_at_least(floor: float, scale: tuple[float, ...]) -> float:
    return min((s for s in scale if s >= floor), default=floor)


def family(value: Column) -> Column:
    """First family of a CSS list without quotes."""
    return F.trim(F.regexp_replace(F.trim(F.element_at(F.split(value, ","), 1)), "^[\"']|[\"']$", ""))


def is_bold(weight: Column) -> Column:
    return F.coalesce(F.lower(weight).isin("bold", "bolder") | (numeric(weight) >= 600), F.lit(False))


def clean_name(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), "[^a-z0-9]", "")


# Families that any face may stand for.
GENERIC = ("sansserif", "serif", "monospace", "cursive", "fantasy")


def families_match(requested: Column, matched: Column) -> Column:
    """Whether one of the families in a list is the one asked for: equal without marks, or one name within the other; generic ones always are."""
    asked = clean_name(F.coalesce(requested, F.lit("")))
    one = lambda name: (name != "") & (F.contains(name, asked) | F.contains(asked, name))
    listed = F.exists(F.split(F.coalesce(matched, F.lit("")), ","), lambda x: one(clean_name(x)))
    return (asked != "") & (listed | asked.isin(*GENERIC))


def format_mm(value: Column, dpi: Column) -> Column:
    return F.bround(value * dpi / F.lit(25.4), 1)
