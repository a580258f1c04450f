"""Drawings in SVG written from the shapes of the generic tables, a document for each order, and what reading them must give, in SQL.

A shape is painted in one of four ways by its number: by its own attributes, by a class of the sheet, by its group (which is moved by 10 20), or as a
``use`` (moved by 5 7) of a prototype with a style attribute. Rectangles have a stroke that names a gradient. Some documents hold what must be refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bridge import SHAPES_SQL, shapes


def _put(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) and not p.startswith("$") else F.col(p[1:]).cast("string") if isinstance(p, str) else p for p in parts])


def drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, markup."""
    way = F.col("shape_index") % 4
    hexa = lambda c: F.lpad(F.lower(F.hex(F.col(c).cast("long"))), 2, "0")
    rows = shapes(spark, sf_dir).withColumn("ink", F.concat(F.lit("#"), hexa("fill_r"), hexa("fill_g"), hexa("fill_b")))
    paint = F.when(way == 0, _put(' fill="', "$ink", '"')).when(way == 1, _put(' class="c', "$shape_index", '"')).when(way == 3, _put(' id="p', "$shape_index", '" style="fill:', "$ink", '"')).otherwise("")
    trap = F.when(F.col("doc_id") % 4 == 0, ' onclick="go()"').otherwise("")
    rect = _put('<rect x="', "$x", '" y="', "$y", '" width="', "$width", '" height="', "$height", '" stroke="url(#g)"', "$paint", "/>")
    circle = _put('<circle cx="', "$x", '" cy="', "$y", '" r="', "$radius", '"', "$paint", "/>")
    text = _put('<text x="', "$x", '" y="', "$y", '" font-size="', "$font_size", '"', "$paint", ">No &lt;", "$shape_index", "&gt;\n  here</text>")
    # Each is a column of its own before it is used: written out in every use, the row's method would be too long for the JVM to compile.
    rows = rows.withColumn("paint", F.concat(paint, trap))
    rows = rows.withColumn("body", F.when(F.col("tag") == "rect", rect).when(F.col("tag") == "circle", circle).otherwise(text))
    drawn = F.when(way == 2, _put('<g fill="', "$ink", '" transform="translate(10 20)">', "$body", "</g>")).when(way == 3, _put('<use href="#p', "$shape_index", '" x="5" y="7"/>')).otherwise(F.col("body"))
    rule = F.when(way == 1, _put(".c", "$shape_index", "{fill:", "$ink", "}")).otherwise("")
    one = rows.select("doc_id", "shape_index", drawn.alias("drawn"), F.when(way == 3, F.col("body")).otherwise("").alias("proto"), rule.alias("rule"), "ink")
    docs = one.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("shape_index", "drawn", "proto", "rule", "ink"))).alias("s"))
    every = lambda k: F.array_join(F.transform("s", lambda x: x[k]), "")
    bad = lambda n, what: F.when(F.col("doc_id") % n == 0, what).otherwise("")
    gradient = _put('<linearGradient id="g" x1="0" x2="10"><stop offset="0%" stop-color="', F.col("s")[0]["ink"], '"/><stop offset=".75" style="opacity:1; stop-color: #fff"/></linearGradient>')
    return docs.select(
        "doc_id",
        _put(
            '<?xml version="1.0"?><svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 1080 1080"><style>/* .no{} */', every("rule"), bad(6, "g rect{fill:#000}"), "</style><defs>", gradient, every("proto"), "</defs>",
            every("drawn"), bad(5, "<script>if (1 < 2) go()</script>"), bad(7, "<blink><rect/></blink>"), bad(3, '<use href="#nowhere"/>'), "</svg>",
        ).alias("markup"),
    )


_WAY = f"""{SHAPES_SQL}, w AS (SELECT *, shape_index % 4 AS way, format('#{{:02x}}{{:02x}}{{:02x}}', fill_r, fill_g, fill_b) AS ink,
  CASE shape_index % 4 WHEN 2 THEN 10e0 WHEN 3 THEN 5e0 ELSE 0e0 END AS mx, CASE shape_index % 4 WHEN 2 THEN 20e0 WHEN 3 THEN 7e0 ELSE 0e0 END AS my FROM shapes)"""
#: Two decimals without idle zeros where the shape was moved; as written where not.
_NUM = lambda v, plain: f"CASE WHEN way < 2 THEN CAST({plain} AS VARCHAR) ELSE rtrim(rtrim(format('{{:.2f}}', {v}), '0'), '.') END"

SVG_SHAPES_SQL = f"""WITH {_WAY}
SELECT doc_id, shape_index, tag, x + mx AS x, y + my AS y, CASE tag WHEN 'rect' THEN width END AS width, CASE tag WHEN 'rect' THEN height END AS height, CASE tag WHEN 'circle' THEN radius END AS r,
  CASE tag WHEN 'text' THEN font_size END AS font_size, ink AS fill, CASE tag WHEN 'text' THEN 'No <' || shape_index || '> here' ELSE '' END AS text, CASE WHEN way >= 2 THEN true END AS baked FROM w"""
SVG_PAINTS_SQL = f"""WITH {_WAY} SELECT doc_id, shape_index, 'stroke' AS property, 'linear' AS kind, 2 AS stops, 0.75e0 AS last_offset, first_value(ink) OVER (PARTITION BY doc_id ORDER BY shape_index) AS first_color, '#fff' AS last_color
FROM w QUALIFY tag = 'rect'"""
SVG_WARNINGS_SQL = """WITH k AS (SELECT * FROM (VALUES ('script', 'script', 5), ('unknown', 'blink', 7), ('use of missing id', '#nowhere', 3), ('unsafe attribute', 'onclick', 4), ('selector', 'g rect', 6)) AS t(kind, detail, n))
SELECT DISTINCT l_orderkey AS doc_id, kind, detail FROM lineitem, k WHERE l_orderkey % n = 0"""
_ID = "CASE way WHEN 3 THEN ' id=\"p' || shape_index || '\"' ELSE '' END"
SVG_MARKUP_SQL = f"""WITH {_WAY}
SELECT doc_id, shape_index, CASE tag
  WHEN 'rect' THEN '<rect fill="' || ink || '" height="' || {_NUM("height", "height")} || '"' || {_ID} || ' stroke="url(#g)" width="' || {_NUM("width", "width")} || '" x="' || {_NUM("x + mx", "x")} || '" y="' || {_NUM("y + my", "y")} || '"/>'
  WHEN 'circle' THEN '<circle cx="' || {_NUM("x + mx", "x")} || '" cy="' || {_NUM("y + my", "y")} || '" fill="' || ink || '"' || {_ID} || ' r="' || {_NUM("radius", "radius")} || '"/>'
  ELSE '<text fill="' || ink || '" font-size="' || {_NUM("font_size", "font_size")} || '"' || {_ID} || ' x="' || {_NUM("x + mx", "x")} || '" y="' || {_NUM("y + my", "y")} || '">No &lt;' || shape_index || '&gt; here</text>' END AS markup FROM w"""
