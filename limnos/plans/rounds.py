"""Queries that decide in rounds: rings and boxes of the shapes, and vectors of 64 components as pictures of 8 by 8, light and dark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import outlines, raster
from ..sources.bridge import SHAPES_SQL, shapes

TOLERANCE = 60.0


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, y, x, label: 2 where a component is at least 0.1, 1 where it is at least 0, else 0; other vectors are no pictures."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter(F.size("embedding") == 64).select(F.col("vec_id").alias("doc_id"), F.posexplode("embedding").alias("i", "v"))
    v = F.col("v").cast("double")
    return rows.select("doc_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), F.when(v >= 0.1, 2).when(v >= 0, 1).when(v < 0, 0).alias("label"))


def ring_simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outlines.ring_simplify(shapes(spark, sf_dir), TOLERANCE)


def greedy_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outlines.greedy_boxes(shapes(spark, sf_dir))


def tile_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.regions(pictures(spark, sf_dir))


def region_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.region_boxes(pictures(spark, sf_dir))


def boundary_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.boundary_loops(pictures(spark, sf_dir))


QUERIES = {f.__name__: f for f in (ring_simplify, greedy_boxes, tile_components, region_boxes, boundary_loops)}

_W = raster.WIDE
_PIXELS = f"""pixels AS (SELECT doc_id, i // 8 AS y, i % 8 AS x, CAST(i // 8 AS BIGINT) * {_W} + i % 8 AS p, CASE WHEN v >= 0.1e0 THEN 2 WHEN v >= 0 THEN 1 WHEN v < 0 THEN 0 END AS label
  FROM (SELECT vec_id AS doc_id, CAST(unnest(embedding) AS DOUBLE) AS v, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS i FROM embeddings WHERE len(embedding) = 64))"""
_REGIONS = f"""{_PIXELS}, reach(doc_id, label, p, q) AS (
  SELECT doc_id, label, p, p FROM pixels
  UNION
  SELECT r.doc_id, r.label, r.p, n.p FROM reach r JOIN pixels n ON n.doc_id = r.doc_id AND n.label = r.label AND n.p IN (r.q - 1, r.q + 1, r.q - {_W}, r.q + {_W})),
regions AS (SELECT p.doc_id, y, x, p.label, min(q) AS region FROM pixels p JOIN reach r ON r.doc_id = p.doc_id AND r.p = p.p GROUP BY ALL)"""
_SIDES = """sides AS (
  SELECT a.doc_id, a.label, a.p * 4 + way AS e, way, a.x + u0 AS x0, a.y + v0 AS y0, a.x + u1 AS x1, a.y + v1 AS y1
  FROM pixels a CROSS JOIN (VALUES (0, 0, -1, 0, 0, 1, 0), (1, 1, 0, 1, 0, 1, 1), (2, 0, 1, 1, 1, 0, 1), (3, -1, 0, 0, 1, 0, 0)) AS s(way, dx, dy, u0, v0, u1, v1)
  LEFT JOIN pixels b ON b.doc_id = a.doc_id AND b.x = a.x + dx AND b.y = a.y + dy WHERE b.label IS NULL OR b.label <> a.label),
chain AS (SELECT a.doc_id, a.e, arg_min(b.e, CASE (b.way - a.way + 4) % 4 WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END) AS nxt
  FROM sides a JOIN sides b ON b.doc_id = a.doc_id AND b.label = a.label AND b.x0 = a.x1 AND b.y0 = a.y1 GROUP BY a.doc_id, a.e),
walk(doc_id, e, v) AS (SELECT doc_id, e, nxt FROM chain UNION SELECT w.doc_id, w.e, c.nxt FROM walk w JOIN chain c ON c.doc_id = w.doc_id AND c.e = w.v),
loops AS (SELECT doc_id, e, min(v) AS loop FROM walk GROUP BY doc_id, e)"""
_RING = f"""{SHAPES_SQL}, k AS (SELECT doc_id, shape_index, x, y, row_number() OVER (PARTITION BY doc_id ORDER BY shape_index) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n, avg(x) OVER (PARTITION BY doc_id) AS mx, avg(y) OVER (PARTITION BY doc_id) AS my FROM shapes),
s AS (SELECT *, arg_min(k, (-round(pow(x - mx, 2) + pow(y - my, 2), 6), k)) OVER (PARTITION BY doc_id) AS sk FROM k),
r AS (SELECT *, (k - sk + n) % n AS r, max(CASE WHEN k = sk THEN x END) OVER (PARTITION BY doc_id) AS sx, max(CASE WHEN k = sk THEN y END) OVER (PARTITION BY doc_id) AS sy FROM s),
f AS (SELECT *, arg_min(r, (-round(pow(x - sx, 2) + pow(y - sy, 2), 6), r)) OVER (PARTITION BY doc_id) AS far FROM r),
pts AS (SELECT doc_id, r, x, y FROM f UNION ALL SELECT doc_id, n, x, y FROM f WHERE r = 0),
segs(doc_id, a, b) AS (
  SELECT DISTINCT doc_id, unnest([0, far]), unnest([far, n]) FROM f WHERE n >= 4
  UNION ALL
  SELECT doc_id, unnest([a, m]), unnest([m, b]) FROM (
    SELECT doc_id, a, b, arg_min(r, (-d, r)) AS m, max(d) AS d FROM (
      SELECT s.doc_id, s.a, s.b, p.r, round(CASE WHEN hypot(q.x - o.x, q.y - o.y) = 0 THEN hypot(p.x - o.x, p.y - o.y) ELSE abs((q.x - o.x) * (p.y - o.y) - (q.y - o.y) * (p.x - o.x)) / hypot(q.x - o.x, q.y - o.y) END, 9) AS d
      FROM segs s JOIN pts o ON o.doc_id = s.doc_id AND o.r = s.a JOIN pts q ON q.doc_id = s.doc_id AND q.r = s.b JOIN pts p ON p.doc_id = s.doc_id AND p.r > s.a AND p.r < s.b) GROUP BY doc_id, a, b) WHERE d > {TOLERANCE}),
ends AS (SELECT doc_id, a AS r FROM segs UNION SELECT doc_id, b FROM segs),
marked AS (SELECT f.doc_id, shape_index, n < 4 OR e.r IS NOT NULL AS keep FROM f LEFT JOIN ends e ON e.doc_id = f.doc_id AND e.r = f.r)""".replace("hypot(", "_h(")


def _hypot(sql: str) -> str:
    """SQL has no length of a vector: _h(a, b) is written out."""
    import re

    return re.sub(r"_h\(([^,()]+(?:\.[xy])?[^,()]*), ([^,()]+)\)", r"sqrt(pow(\1, 2) + pow(\2, 2))", sql)


SQL = {
    "ring_simplify": _hypot(f"WITH RECURSIVE {_RING} SELECT doc_id, shape_index, keep OR count(*) FILTER (keep) OVER (PARTITION BY doc_id) < 3 AS keep FROM marked"),
    "greedy_boxes": f"""WITH RECURSIVE {SHAPES_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(-greatest(0e0, x1 - x0) * greatest(0e0, y1 - y0), 6), shape_index) AS k FROM shapes),
w(doc_id, k, won) AS (
  SELECT DISTINCT doc_id, 0::BIGINT, []::STRUCT(i BIGINT, a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE)[] FROM o
  UNION ALL
  SELECT w.doc_id, w.k + 1, CASE WHEN len(list_filter(won, lambda z: o.x0 < z.c AND z.a < o.x1 AND o.y0 < z.d AND z.b < o.y1)) > 0 THEN won ELSE list_append(won, {{'i': shape_index, 'a': x0, 'b': y0, 'c': x1, 'd': y1}}) END
  FROM w JOIN o ON o.doc_id = w.doc_id AND o.k = w.k + 1)
SELECT doc_id, unnest(won).i AS shape_index FROM (SELECT doc_id, arg_max(won, k) AS won FROM w GROUP BY doc_id)""",
    "tile_components": f"WITH RECURSIVE {_REGIONS} SELECT * FROM regions",
    "region_boxes": f"""WITH RECURSIVE {_REGIONS} SELECT doc_id, label, region, count(*) AS pixels, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1,
  round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY doc_id) AS DOUBLE), 6) AS share FROM regions GROUP BY doc_id, label, region""",
    "boundary_loops": f"WITH RECURSIVE {_PIXELS}, {_SIDES} SELECT s.doc_id, label, loop, count(*) AS sides, sum(x0 * y1 - x1 * y0) / 2 AS area FROM sides s JOIN loops USING (doc_id, e) GROUP BY s.doc_id, label, loop",
}
