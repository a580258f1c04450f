"""Affine maps as six Columns: reading transform lists, products, measures. All row-local built-ins."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE = "struct<a:double,b:double,c:double,d:double,e:double,f:double>"


class Matrix(NamedTuple):
    a: Column
    b: Column
    c: Column
    d: Column
    e: Column
    f: Column

    @classmethod
    def of(cls, *values) -> Matrix:
        return cls(*[v if isinstance(v, Column) else F.lit(float(v)) for v in values])

    @classmethod
    def read(cls, column: Column) -> Matrix:
        return cls(*[column[k] for k in "abcdef"])

    def struct(self) -> Column:
        return F.struct(*[v.alias(k) for v, k in zip(self, "abcdef", strict=True)])

    def __matmul__(self, other: Matrix) -> Matrix:
        """The map that does other first."""
        m, o = self, other
        return Matrix(m.a * o.a + m.c * o.b, m.b * o.a + m.d * o.b, m.a * o.c + m.c * o.d, m.b * o.c + m.d * o.d, m.a * o.e + m.c * o.f + m.e, m.b * o.e + m.d * o.f + m.f)

    def apply(self, x: Column, y: Column) -> tuple[Column, Column]:
        return self.a * x + self.c * y + self.e, self.b * x + self.d * y + self.f

    def scale_factor(self) -> Column:
        """Mean length of the images of the unit vectors."""
        return (F.hypot(self.a, self.b) + F.hypot(self.c, self.d)) / 2

    def rotation(self) -> Column:
        return F.degrees(F.atan2(self.b, self.a))

    def is_identity(self, tolerance: float = 1e-9) -> Column:
        out = F.lit(True)
        for v, i in zip(self, (1, 0, 0, 1, 0, 0), strict=True):
            out = out & (F.abs(v - float(i)) <= tolerance)
        return out

    def is_axis_aligned(self, tolerance: float = 1e-6) -> Column:
        return (F.abs(self.b) <= tolerance) & (F.abs(self.c) <= tolerance)

    def is_uniform_scale(self, tolerance: float = 1e-6) -> Column:
        sx, sy = F.hypot(self.a, self.b), F.hypot(self.c, self.d)
        return F.abs(sx - sy) <= tolerance * F.greatest(F.lit(1.0), sx)


def _of_call(name: Column, args: Column) -> Column:
    """Struct of one transform function by its name in lower case; null where it is unknown or has the wrong number of arguments."""
    n, at = F.size(args), lambda k: F.get(args, F.lit(k))
    turn = F.radians(at(0))
    rotate = Matrix.of(F.cos(turn), F.sin(turn), -F.sin(turn), F.cos(turn), 0, 0)
    about = Matrix.of(1, 0, 0, 1, at(1), at(2)) @ rotate @ Matrix.of(1, 0, 0, 1, -at(1), -at(2))
    known = [
        ("matrix", (6,), Matrix(*[at(k) for k in range(6)])), ("translate", (1, 2), Matrix.of(1, 0, 0, 1, at(0), F.coalesce(at(1), F.lit(0.0)))),
        ("scale", (1, 2), Matrix.of(at(0), 0, 0, F.coalesce(at(1), at(0)), 0, 0)), ("rotate", (1,), rotate), ("rotate", (3,), about),
        ("skewx", (1,), Matrix.of(1, 0, F.tan(turn), 1, 0, 0)), ("skewy", (1,), Matrix.of(1, F.tan(turn), 0, 1, 0, 0)),
    ]
    out = F.lit(None).cast(TYPE)
    for word, sizes, m in known:
        out = F.when((name == word) & n.isin(*sizes), m.struct()).otherwise(out)
    return out


# How a call and a number are written.
CALL = r"([A-Za-z]+)\s*\(([^)]*)\)"
NUMBER = r"([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"


def parse(value: Column) -> Column:
    """Struct of the product of a transform list; the identity for a blank or absent one, null where something in it can't be read."""
    value = F.coalesce(value, F.lit(""))
    names, inner = (F.regexp_extract_all(value, F.lit(CALL), F.lit(k)) for k in (1, 2))
    numbers = lambda s: F.transform(F.regexp_extract_all(s, F.lit(NUMBER), F.lit(1)), lambda x: x.cast("double"))
    # Numbers are read here once: written into the maps themselves, they would be read again for each use of an argument.
    calls = F.zip_with(names, inner, lambda n, s: F.struct(F.lower(n).alias("name"), numbers(s).alias("args")))
    maps = F.transform(calls, lambda c: _of_call(c["name"], c["args"]))
    rest = F.regexp_replace(F.regexp_replace(value, CALL, ""), r"[\s,]+", "")
    product = F.aggregate(maps, Matrix.of(1, 0, 0, 1, 0, 0).struct(), lambda acc, m: F.when(acc.isNotNull() & m.isNotNull(), (Matrix.read(acc) @ Matrix.read(m)).struct()))
    return F.when(rest == "", product)


def decimals(value: Column, n: int) -> Column:
    """A number as text with at most n decimals.

    One that is written without an exponent is rounded and cast: a formatter and its patterns cost many times as much.
    """
    near = F.round(value, n).cast("string")
    plain = F.when(near.endswith(".0"), F.substring_index(near, ".", 1)).otherwise(near)
    text = F.format_string(f"%.{n}f", value)
    short = F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")
    exact = F.when(short.isin("", "-"), "0").otherwise(short)
    return F.when((F.abs(value) >= max(1e-3, 10.0**-n)) & (F.abs(value) < 9_999_999.0), plain).otherwise(exact)


def two_decimals(value: Column) -> Column:
    return decimals(value, 2)
