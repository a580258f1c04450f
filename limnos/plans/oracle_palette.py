"""SQL that the derived palettes are held against: candidates of lightness as rows, the first that passes by aggregate."""

from __future__ import annotations

from ..functions import color as C
from ..operators import palette as P
from ..sources.desk import sql
from . import catalog as K
from .oracle import dot, lab_of, lum, num

BAR = num(K.CONTRAST_TEXT)


def encoded(v: str) -> str:
    u = f"greatest(0e0, least(1e0, {v}))"
    return f"CAST(round_even(255e0 * (CASE WHEN {u} <= 0.0031308e0 THEN {u} * 12.92e0 ELSE 1.055e0 * pow({u}, {num(1 / 2.4)}) - 0.055e0 END), 0) AS INT)"


def of_lch(light: str, chroma: str, hue: str) -> list[str]:
    cubes = [f"pow({v}, 3)" for v in (dot(row, (light, f"{chroma} * cos({hue})", f"{chroma} * sin({hue})")) for row in C.FROM_LAB)]
    return [encoded(dot(row, cubes)) for row in C.FROM_LMS]


def ratio(a: str, b: str) -> str:
    return f"((greatest({a}, {b}) + 0.05e0) / (least({a}, {b}) + 0.05e0))"


def names(token: str) -> list[str]:
    return [f"{token.replace('-', '_')}_{k}" for k in "rgb"]


def moved(before: str, front: str, back: str, out: str, after: str) -> str:
    f, b, o = names(front), names(back), names(out)
    lab = lab_of(f)
    old = f"* EXCLUDE ({', '.join(o)})" if front == out else "*"
    return f"""{after}_a AS (SELECT *, {lab[0]} AS ll, {lab[1]} AS la, {lab[2]} AS lb, {lum(f)} AS lf, {lum(b)} AS lk FROM {before}),
{after}_b AS (SELECT seed, ll, sqrt(la * la + lb * lb) AS lc, atan2(lb, la) AS lh, lk, {ratio("lk", "0e0")} >= {ratio("lk", "1e0")} AS darken FROM {after}_a WHERE {ratio("lf", "lk")} < {BAR}),
{after}_c AS (SELECT seed, lk, k, lh, ll + (CASE WHEN darken THEN -0.01e0 ELSE 0.01e0 END) * (k % {P.STEPS}) AS l, lc * (2 - k // {P.STEPS}) / 2e0 AS c FROM {after}_b, (SELECT range AS k FROM range({3 * P.STEPS}))),
{after}_d AS (SELECT seed, lk, k, {", ".join(f"{v} AS n{x}" for v, x in zip(of_lch("l", "c", "lh"), "rgb", strict=True))} FROM {after}_c WHERE l >= 0 AND l <= 1),
{after}_e AS (SELECT seed, arg_min([nr, ng, nb], k) AS n FROM {after}_d WHERE {ratio(lum(("nr", "ng", "nb")), "lk")} >= {BAR} GROUP BY seed),
{after} AS (SELECT t.{old}, {", ".join(f"coalesce(n[{i + 1}], t.{f[i]}) AS {o[i]}" for i in range(3))} FROM {before} t LEFT JOIN {after}_e e ON t.seed = e.seed)"""


def tone(token: str) -> str:
    light, most, part = P.TONES[token]
    chroma = num(most) if part is None else f"least(pc * {num(part)}, {num(most)})"
    return ", ".join(f"{v} AS {n}" for v, n in zip(of_lch(num(light), chroma, "ph"), names(token), strict=True))


LAB = lab_of(names("primary"))
DERIVED = f"""WITH {sql("seeds")}, p0 AS (SELECT *, {LAB[0]} AS pl, {LAB[1]} AS pa, {LAB[2]} AS pb FROM desk_seeds WHERE primary_r IS NOT NULL),
p1 AS (SELECT *, sqrt(pa * pa + pb * pb) AS pc, atan2(pb, pa) AS ph FROM p0), d0 AS (SELECT *, {", ".join(tone(t) for t in P.TONES)} FROM p1),
{moved("d0", "ink", "surface", "ink", "d1")}, {moved("d1", "text", "surface", "text", "d2")}, {moved("d2", "text", "paper", "text", "d3")}, {moved("d3", "paper", "primary", "on-primary", "d4")} """


def hexed(token: str) -> str:
    return f"format('#{{:02x}}{{:02x}}{{:02x}}', {', '.join(names(token))})"


SQL = {
    "palette_tokens": DERIVED + " UNION ALL ".join(f"SELECT seed, {i} AS place, '{t}' AS token, {hexed(t)} AS hex, '{role}' AS role FROM d4" for i, (t, role) in enumerate(P.ROLES.items())),
    "palette_contrasts": DERIVED + " UNION ALL ".join(f"SELECT seed, '{a}' AS front, '{b}' AS back, round({ratio(lum(names(a)), lum(names(b)))}, 4) AS ratio, {ratio(lum(names(a)), lum(names(b)))} >= {BAR} AS passes FROM d4" for a, b in P.PAIRS),
}
