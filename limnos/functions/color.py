"""Colour as Column expressions: parsing, sRGB, OKLab, contrast, press ink. All stay in generated code."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Named colours.
NAMED = {
    "black": "#000000", "white": "#ffffff", "red": "#ff0000", "green": "#008000", "blue": "#0000ff", "yellow": "#ffff00", "orange": "#ffa500", "purple": "#800080",
    "gray": "#808080", "grey": "#808080", "silver": "#c0c0c0", "maroon": "#800000", "navy": "#000080", "teal": "#008080", "aqua": "#00ffff", "cyan": "#00ffff",
    "fuchsia": "#ff00ff", "magenta": "#ff00ff", "lime": "#00ff00", "olive": "#808000", "pink": "#ffc0cb", "brown": "#a52a2a",
}
# The published OKLab matrices.
TO_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
TO_LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
FROM_LAB = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.2914855480))
FROM_LMS = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))
# Luminance weights.
LUMA = (0.2126, 0.7152, 0.0722)


class RGB(NamedTuple):
    r: Column
    g: Column
    b: Column

    @classmethod
    def of(cls, prefix: str) -> RGB:
        return cls(*(F.col(prefix + k) for k in "rgb"))

    @classmethod
    def lit(cls, rgb: tuple[int, int, int]) -> RGB:
        return cls(*(F.lit(float(v)) for v in rgb))


def _dot(row, values) -> Column:
    out = values[0] * F.lit(row[0])
    for k, v in zip(row[1:], values[1:], strict=True):
        out = out + v * F.lit(k)
    return out


def linear(c: Column) -> Column:
    """An 8-bit channel in linear light."""
    u = c.cast("double") / F.lit(255.0)
    return F.when(u <= 0.04045, u / F.lit(12.92)).otherwise(F.pow((u + F.lit(0.055)) / F.lit(1.055), F.lit(2.4)))


def encoded(c: Column) -> Column:
    """Linear light as an 8-bit channel, clipped, ties to even."""
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    v = F.when(u <= 0.0031308, u * F.lit(12.92)).otherwise(F.lit(1.055) * F.pow(u, F.lit(1 / 2.4)) - F.lit(0.055))
    return F.bround(v * 255).cast("int")


def _root(cone: Column) -> Column:
    return F.when(cone > 0, F.pow(cone, F.lit(1 / 3))).otherwise(F.lit(0.0))


def oklab(rgb: RGB) -> tuple[Column, Column, Column]:
    light = [linear(c) for c in rgb]
    roots = [_root(_dot(row, light)) for row in TO_LMS]
    return tuple(_dot(row, roots) for row in TO_LAB)


def with_oklab(df: DataFrame, rgb: RGB, names: tuple[str, str, str] = ("L", "A", "B")) -> DataFrame:
    """df with the OKLab of a colour in three columns.

    As one expression each, a channel's light would be computed up to 18 times for one row, in a method too long for the JVM to compile; so each step is a
    projection of its own.
    """
    light, cones, roots = ([f"_{k}{n}" for n in names] for k in ("light", "cone", "root"))
    c = F.col
    out = df.withColumns({n: linear(v) for n, v in zip(light, rgb, strict=True)})
    out = out.withColumns({n: _dot(row, [c(k) for k in light]) for n, row in zip(cones, TO_LMS, strict=True)})
    out = out.withColumns({n: _root(c(k)) for n, k in zip(roots, cones, strict=True)})
    return out.withColumns({n: _dot(row, [c(k) for k in roots]) for n, row in zip(names, TO_LAB, strict=True)}).drop(*light, *cones, *roots)


def cubes(lab: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    return tuple(v * v * v for v in (_dot(row, lab) for row in FROM_LAB))


def from_cubes(values: tuple[Column, Column, Column]) -> RGB:
    return RGB(*(encoded(_dot(row, values)) for row in FROM_LMS))


def from_oklab(lab: tuple[Column, Column, Column]) -> RGB:
    return from_cubes(cubes(lab))


def distance(a, b) -> Column:
    """Euclidean distance of two OKLab triples."""
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def luminance(rgb: RGB) -> Column:
    return _dot(LUMA, [linear(c) for c in rgb])


def contrast(a: Column, b: Column) -> Column:
    """WCAG ratio of two luminances."""
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def cmyk(rgb: RGB) -> tuple[Column, Column, Column, Column]:
    """Naive separation; black has K only."""
    u = [c.cast("double") / F.lit(255.0) for c in rgb]
    k = F.lit(1.0) - F.greatest(*u)
    return (*[F.when(k >= 1.0, F.lit(0.0)).otherwise((F.lit(1.0) - v - k) / (F.lit(1.0) - k)) for v in u], k)


def total_ink(rgb: RGB) -> Column:
    c, m, y, k = cmyk(rgb)
    return (c + m + y + k) * 100


def to_hex(rgb: RGB) -> Column:
    return F.lower(F.concat(F.lit("#"), *[F.lpad(F.hex(c.cast("long")), 2, "0") for c in rgb]))


def parse(value: Column) -> Column:
    """Struct of r, g, b (int) of a CSS colour; null where it is none. An alpha part is dropped."""
    v = F.lower(F.trim(value))
    named = F.element_at(F.create_map(*[F.lit(x) for kv in NAMED.items() for x in kv]), v)
    digits = F.regexp_extract(F.coalesce(named, v), r"^#?([0-9a-f]{3}|[0-9a-f]{6}|[0-9a-f]{8})$", 1)
    wide = F.when(F.length(digits) == 3, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    hexed = [F.conv(F.substring(wide, 1 + 2 * k, 2), 16, 10).cast("int") for k in range(3)]
    parts = F.filter(F.split(F.regexp_extract(v, r"^rgba?\(([^)]+)\)", 1), r"[,\s/]+"), lambda x: x != "")

    def channel(k: int) -> Column:
        """A number or percentage, halves to even, within 0 and 255."""
        raw = F.get(parts, F.lit(k))
        value = F.regexp_replace(raw, "%$", "").try_cast("double") * F.when(raw.endswith("%"), 2.55).otherwise(1.0)
        return F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.bround(value))).cast("int")

    def struct(cs) -> Column:
        return F.struct(*[c.alias(k) for c, k in zip(cs, "rgb", strict=True)])

    called = [F.when(F.size(parts) >= 3, channel(k)) for k in range(3)]
    return F.when(v.startswith("url("), F.lit(None)).when(digits != "", struct(hexed)).when(called[0].isNotNull() & called[1].isNotNull() & called[2].isNotNull(), struct(called))
