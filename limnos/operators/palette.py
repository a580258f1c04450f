"""Brand palettes derived from seed colours, one row for a pair of seeds. Every seed is for itself: rows are dealt out once, then all is row-local.

The search for a lightness goes through its steps in numpy, over all rows of an Arrow batch that still search, and ends with the last of them.

Tones keep the hue of the first seed at fixed lightness; those that carry text are moved in lightness until they reach the contrast asked.
A null seed channel gives null colours; repeated rows are derived one by one; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color as C
from ..plans import catalog as K

# Lightness and largest chroma of each tone, and the share of the seed's chroma that it takes (None: the chroma itself is fixed).
TONES = {
    "ink": (0.24, 0.03, 1.0), "text": (0.35, 0.035, 0.4), "surface": (0.955, 0.012, None), "paper": (0.985, 0.005, None),
    "neutral-800": (0.35, 0.035, 0.3), "neutral-500": (0.55, 0.035, 0.3), "neutral-300": (0.75, 0.035, 0.3), "neutral-100": (0.92, 0.035, 0.3),
}
# Roles of the tokens, in the order of the system.
ROLES = {
    "primary": "primary", "accent": "accent", "ink": "ink", "text": "text", "on-primary": "text", "surface": "surface", "paper": "surface",
    "neutral-800": "other", "neutral-500": "other", "neutral-300": "other", "neutral-100": "other",
}
# Pairs whose contrast is told.
PAIRS = (("text", "surface"), ("text", "paper"), ("ink", "surface"), ("on-primary", "primary"))
STEPS = 101  # of a hundredth of lightness, for each of three chromas


def _rgb(c: Column) -> C.RGB:
    """Channels of a colour held as one number; the optimiser would copy the making of a struct into every reading of its fields."""
    return C.RGB(*(F.shiftright(c, k).bitwiseAND(F.lit(255)) for k in (16, 8, 0)))


def _packed(rgb) -> Column:
    r, g, b = (v.cast("int") for v in rgb)
    return r * 65_536 + g * 256 + b


def _with_lch(rows: DataFrame, rgb: C.RGB) -> DataFrame:
    rows = rows.withColumns(dict(zip(("_l", "_a", "_b"), C.oklab(rgb), strict=True)))
    return rows.withColumns({"_c": F.hypot("_a", "_b"), "_h": F.atan2("_b", "_a")})


def _tones(at: Column) -> Column:
    """Colours of an array of (l, c) at the hue ``_h``, in small steps, so that no step repeats another's expressions."""
    three = lambda values: F.struct(*[v.alias(k) for v, k in zip(values, "rgb", strict=True)])
    read = lambda x: [x[k] for k in "rgb"]
    mixed = F.transform(at, lambda x: three(C._dot(row, (x["l"], x["c"] * F.cos("_h"), x["c"] * F.sin("_h"))) for row in C.FROM_LAB))
    cubes = F.transform(mixed, lambda x: three(v * v * v for v in read(x)))
    light = F.transform(cubes, lambda x: three(C._dot(row, read(x)) for row in C.FROM_LMS))
    return F.transform(light, lambda x: _packed(C.encoded(v) for v in read(x)))


def _dots(matrix, values) -> list[np.ndarray]:
    return [sum((v * k for k, v in zip(row[1:], values[1:], strict=True)), values[0] * row[0]) for row in matrix]


_BYTE = np.arange(256) / 255.0
_LINEAR = np.where(_BYTE <= 0.04045, _BYTE / 12.92, ((_BYTE + 0.055) / 1.055) ** 2.4)


def _light(rgb: list[np.ndarray]) -> np.ndarray:
    return _dots([C.LUMA], [_LINEAR[v] for v in rgb])[0]


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (np.maximum(a, b) + 0.05) / (np.minimum(a, b) + 0.05)


def _bytes(light: np.ndarray) -> np.ndarray:
    u = np.clip(light, 0.0, 1.0)
    return np.rint(np.where(u <= 0.0031308, u * 12.92, 1.055 * u ** (1 / 2.4) - 0.055) * 255).astype(np.int64)


def contrasting(front: np.ndarray, back: np.ndarray, minimum: float) -> np.ndarray:
    """The colours ``front``, those without ``minimum`` of contrast to ``back`` moved in lightness by whole steps until they have it; rows that have are left out of the later steps."""
    split = lambda v: [v >> k & 255 for k in (16, 8, 0)]
    rgb, behind = split(front), _light(split(back))
    out = front.copy()
    at = np.flatnonzero(_ratio(_light(rgb), behind) < minimum)
    lab = _dots(C.TO_LAB, [np.where(v > 0, np.abs(v) ** (1 / 3), 0.0) for v in _dots(C.TO_LMS, [_LINEAR[v[at]] for v in rgb])])
    light, chroma, hue, behind = lab[0], np.hypot(lab[1], lab[2]), np.arctan2(lab[2], lab[1]), behind[at]
    darken = _ratio(np.zeros(len(at)), behind) >= _ratio(np.ones(len(at)), behind)
    out[at] = np.where(darken, 0, 0xFFFFFF)
    todo = np.arange(len(at))
    for part in (1.0, 0.5, 0.0):
        here = todo
        for k in range(STEPS):
            if not len(here):
                break
            level, c = light[here] + np.where(darken[here], -0.01, 0.01) * k, chroma[here] * part
            cubes = [v * v * v for v in _dots(C.FROM_LAB, (level, c * np.cos(hue[here]), c * np.sin(hue[here])))]
            new = [_bytes(v) for v in _dots(C.FROM_LMS, cubes)]
            inside = (level >= 0.0) & (level <= 1.0)
            found = inside & (_ratio(_light(new), behind[here]) >= minimum)
            out[at[here[found]]] = (new[0] * 65_536 + new[1] * 256 + new[2])[found]
            here = here[~found]
        todo = here
    return out


def ensure_contrast(rows: DataFrame, front: str, back: str, out: str, minimum: float = K.CONTRAST_TEXT) -> DataFrame:
    """``out``: the colour ``front``, moved in lightness (at its chroma, half of it, then none) until it has ``minimum`` of contrast to ``back``; null where either is."""

    @F.arrow_udf("int")
    def moved(a: pa.Array, b: pa.Array) -> pa.Array:
        none = np.asarray(a.is_null()) | np.asarray(b.is_null())
        values = [np.asarray(x.fill_null(0)).astype(np.int64) for x in (a, b)]
        return pa.array(contrasting(*values, minimum), pa.int32(), mask=none)

    return rows.withColumn(out, moved(F.col(f"`{front}`"), F.col(f"`{back}`")))


def derived(seeds: DataFrame) -> DataFrame:
    """seed and a colour for each token, red in its high byte, of rows with seed, primary_r/g/b and accent_r/g/b."""
    given = seeds.dropna(subset=[f"{s}_{k}" for s in ("primary", "accent") for k in "rgb"])
    # A file of few row groups is dealt out anew, for the search costs more than reading.
    given = given.select("seed", _packed(C.RGB.of("primary_")).alias("primary"), _packed(C.RGB.of("accent_")).alias("accent")).repartition("seed")
    rows = _with_lch(given, _rgb(F.col("primary")))
    chroma = lambda most, part: F.lit(most) if part is None else F.least(F.col("_c") * part, F.lit(most))
    at = F.array(*[F.struct(F.lit(light).alias("l"), chroma(most, part).alias("c")) for light, most, part in TONES.values()])
    rows = rows.withColumn("_tones", _tones(at)).withColumns({n: F.col("_tones")[i] for i, n in enumerate(TONES)}).drop("_l", "_a", "_b", "_c", "_h", "_tones")
    for front, back, out in (("ink", "surface", "ink"), ("text", "surface", "text"), ("text", "paper", "text"), ("paper", "primary", "on-primary")):
        rows = ensure_contrast(rows, front, back, out)
    return rows


def palette_tokens(seeds: DataFrame) -> DataFrame:
    """seed, place, token, hex and role of the derived system; seeds with a null channel give no rows."""
    tokens = [F.struct(F.lit(i).alias("place"), F.lit(n).alias("token"), C.to_hex(_rgb(F.col(f"`{n}`"))).alias("hex"), F.lit(role).alias("role")) for i, (n, role) in enumerate(ROLES.items())]
    return derived(seeds).select("seed", F.inline(F.array(*tokens)))


def palette_contrasts(seeds: DataFrame) -> DataFrame:
    """seed, front, back and the contrast of the pairs that the derivation guarantees."""
    light = {n: C.luminance(_rgb(F.col(f"`{n}`"))) for n in {x for p in PAIRS for x in p}}
    pairs = [F.struct(F.lit(a).alias("front"), F.lit(b).alias("back"), C.contrast(light[a], light[b]).alias("ratio")) for a, b in PAIRS]
    rows = derived(seeds).select("seed", F.inline(F.array(*pairs)))
    return rows.select("seed", "front", "back", F.round("ratio", 4).alias("ratio"), (F.col("ratio") >= K.CONTRAST_TEXT).alias("passes"))
