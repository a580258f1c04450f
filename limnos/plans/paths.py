"""Queries over paths written from the shapes, in eight ways, and what they must give, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import matrix as M
from ..operators import paths as P
from ..sources.bridge import SHAPES_SQL, shapes


def path_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, shape_index, d, matrix: a rectangle, one with a hole, curves, shorthands, a circle of arcs with flags run together, and two that can't be read."""
    t = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    x, y, w, h, r = (F.col(k) for k in ("x", "y", "width", "height", "radius"))
    ways = [
        t("M", x, " ", y, "h", w, "v", h, "h-", w, "z"), t(" m", x, ",", y, " ", w, ",0 0,", h, " -", w, ",0z m2 2v", h / 2, "h", w / 2, "v-", h / 2, "z"),
        t("M", x, " ", y, "C", x, " ", y + h, " ", x + w, " ", y + h, " ", x + w, " ", y), t("M", x, " ", y, "c0 ", h, " ", w, " ", h, " ", w, " 0s", w, " ", h, " ", w, " 0Z"),
        t("M", x, " ", y, "q", w, " ", h, " ", w * 2, " 0t", w * 2, " ", h), t("M", x - r, " ", y, "a", r, " ", r, " 0 11", r * 2, " 0 ", r, " ", r, " 0 11-", r * 2, " 0z"),
        t("M", x, " ", y, "L", w), t(x, " ", y, " M 3 4"),
    ]
    way = (F.col("shape_index") + F.col("doc_id")) % 8
    d = F.when(way == 0, ways[0])  # a case, not an array: only the row's own way is written
    for k, text in enumerate(ways[1:], 1):
        d = d.when(way == k, text)
    return shapes(spark, sf_dir).select("doc_id", "shape_index", d.alias("d"), M.Matrix.of(2, 0, 0, 2, 3, 4).struct().alias("matrix"))


def _six(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) + 0.0 for n in names})  # no negative zeros


def path_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.commands(path_texts(spark, sf_dir)).select(*P.KEYS, F.coalesce(F.size("commands"), F.lit(0)).alias("n"), "fault")


def path_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(P.vertices(path_texts(spark, sf_dir)), "x", "y")


def path_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(P.areas(path_texts(spark, sf_dir)), "area")


def path_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(P.bounds(path_texts(spark, sf_dir)), "x0", "y0", "x1", "y1")


def path_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths scaled and moved, and by the matrix that does the same."""
    by_matrix, exact = P.mapped_text()
    read = P.commands(path_texts(spark, sf_dir), "matrix")
    return read.select(*P.KEYS, P.moved_text(2.0, 3.0, 4.0).alias("d"), by_matrix.alias("by_matrix"), exact.alias("exact"))


QUERIES = {f.__name__: f for f in (path_commands, path_flatten, path_area, path_bounds, path_transform)}

_T = f"{SHAPES_SQL}, t AS (SELECT doc_id, shape_index, (shape_index + doc_id) % 8 AS way, x, y, width AS w, height AS h, radius AS r FROM shapes)"


def _vertices(curve: int) -> str:
    """Lines corner by corner, curves by their weights, the circle by its angles."""
    corners = [
        (0, 1, "x y", "x+w y", "x+w y+h", "x y+h", "x y"), (1, 1, "x y", "x+w y", "x+w y+h", "x y+h", "x y"), (1, 2, "x+2 y+2", "x+2 y+2+h/2", "x+2+w/2 y+2+h/2", "x+2+w/2 y+2", "x+2 y+2"),
        (2, 1, "x y"), (3, 1, "x y"), (4, 1, "x y"), (5, 1, "x-r y"),
    ]
    rows = [f"SELECT doc_id, shape_index, {sub} AS sub, {i} AS o, {p.split()[0]} AS x, {p.split()[1]} AS y FROM t WHERE way = {way}" for way, sub, *points in corners for i, p in enumerate(points)]
    cubics = [(2, 10, "x y x y+h x+w y+h x+w y"), (3, 10, "x y x y+h x+w y+h x+w y"), (3, 30, "x+w y x+w y-h x+2*w y+h x+2*w y")]
    for way, o, points in cubics:
        p = points.split()
        mix = lambda k: f"pow(1-s,3)*({p[k]}) + 3*pow(1-s,2)*s*({p[k + 2]}) + 3*(1-s)*s*s*({p[k + 4]}) + s*s*s*({p[k + 6]})"  # noqa: E731, B023
        rows.append(f"SELECT doc_id, shape_index, 1, {o} + i, {mix(0)}, {mix(1)} FROM t, (SELECT i, i / {curve}e0 AS s FROM range(1, {curve + 1}) AS g(i)) WHERE way = {way}")
    rows.append("SELECT doc_id, shape_index, 1, 60, x, y FROM t WHERE way = 3")
    for o, points in ((10, "x y x+w y+h x+2*w y"), (30, "x+2*w y x+3*w y-h x+4*w y+h")):
        p = points.split()
        mix = lambda k: f"pow(1-s,2)*({p[k]}) + 2*(1-s)*s*({p[k + 2]}) + s*s*({p[k + 4]})"  # noqa: E731, B023
        rows.append(f"SELECT doc_id, shape_index, 1, {o} + i, {mix(0)}, {mix(1)} FROM t, (SELECT i, i / {curve}e0 AS s FROM range(1, {curve + 1}) AS g(i)) WHERE way = 4")
    n = 2 * curve
    rows.append(f"SELECT doc_id, shape_index, 1, 10 + i, x - r * cos(pi() * i / {n}), y - r * sin(pi() * i / {n}) FROM t, range(1, {2 * n + 1}) AS g(i) WHERE way = 5")
    return f"v AS (SELECT doc_id, shape_index, sub, row_number() OVER (PARTITION BY doc_id, shape_index, sub ORDER BY o) - 1 AS v, x, y FROM ({' UNION ALL '.join(rows)}))"


_N = lambda e: f"(CASE WHEN round({e}, 2) = 0 THEN '0' ELSE rtrim(rtrim(format('{{:.2f}}', {e}), '0'), '.') END)"
_TEXT = {
    0: ["M", "2*x+3", "2*y+4", "h", "2*w", "v", "2*h", "h", "-2*w", "z"], 1: ["m", "2*x", "2*y", "l", "2*w", "0", "l", "0", "2*h", "l", "-2*w", "0", "z", "m", "4", "4", "v", "h", "h", "w", "v", "-h", "z"],
    2: ["M", "2*x+3", "2*y+4", "C", "2*x+3", "2*(y+h)+4", "2*(x+w)+3", "2*(y+h)+4", "2*(x+w)+3", "2*y+4"], 3: ["M", "2*x+3", "2*y+4", "c", "0", "2*h", "2*w", "2*h", "2*w", "0", "s", "2*w", "2*h", "2*w", "0", "Z"],
    4: ["M", "2*x+3", "2*y+4", "q", "2*w", "2*h", "4*w", "0", "t", "4*w", "2*h"], 5: ["M", "2*(x-r)+3", "2*y+4", "a", "2*r", "2*r", "0", "1", "1", "4*r", "0", "a", "2*r", "2*r", "0", "1", "1", "-4*r", "0", "z"],
}


def _text(parts: list[str]) -> str:
    """A letter in capitals or followed by a value is a command; single letters w, h, r stand for sizes where a value is due."""
    due, out = 0, []
    for p in parts:
        if due == 0:
            due = len(P.VALUES[p.upper()])
            out.append(f"'{p}'")
        else:
            due -= 1
            out.append(f"CAST({p} AS VARCHAR)" if p in ("0", "1", "4") else _N(p))
    return " || ' ' || ".join(out)


_MOVED = "CASE way " + " ".join(f"WHEN {k} THEN {_text(v)}" for k, v in _TEXT.items()) + " END"

SQL = {
    "path_commands": f"WITH {_T} SELECT doc_id, shape_index, CAST(CASE way WHEN 0 THEN 5 WHEN 1 THEN 10 WHEN 2 THEN 2 WHEN 3 THEN 4 WHEN 4 THEN 3 WHEN 5 THEN 4 ELSE 0 END AS INTEGER) AS n, CASE way WHEN 6 THEN 'values do not fit' WHEN 7 THEN 'no command first' END AS fault FROM t",
    "path_flatten": f"WITH {_T}, {_vertices(8)} SELECT doc_id, shape_index, sub, v, round(x, 6) + 0e0 AS x, round(y, 6) + 0e0 AS y FROM v",
    "path_area": f"""WITH {_T}, {_vertices(8)}, n AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM v WINDOW w AS (PARTITION BY doc_id, shape_index, sub ORDER BY v))
SELECT doc_id, shape_index, count(DISTINCT sub) AS subpaths, count(*) AS vertices, round(abs(sum(x * ny - nx * y) / 2), 6) AS area FROM n GROUP BY doc_id, shape_index""",
    "path_bounds": f"WITH {_T}, {_vertices(4)} SELECT doc_id, shape_index, round(min(x), 6) + 0e0 AS x0, round(min(y), 6) + 0e0 AS y0, round(max(x), 6) + 0e0 AS x1, round(max(y), 6) + 0e0 AS y1 FROM v GROUP BY doc_id, shape_index",
    "path_transform": f"WITH {_T} SELECT doc_id, shape_index, {_MOVED} AS d, {_MOVED} AS by_matrix, way < 6 AS exact FROM t",
}
