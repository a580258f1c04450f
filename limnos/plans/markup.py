"""Queries over markup: pages as they are given, and drawings written from the generic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drawing, drawn, styles
from ..sources import drawings as D
from ..sources.markup import PAGE_NODES_SQL, nodes, page_nodes
from ..sources.storage import kept


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(page_nodes(spark, sf_dir), "page-nodes")


def _drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(nodes(D.drawings(spark, sf_dir), markup="markup"), "svg-nodes")


def _page(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("doc_id", "page_id")


def markup_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(page_nodes(spark, sf_dir)).select("page_id", "node", "parent", "depth", "tag", "path", F.size("attrs").alias("n_attrs"))


def html_style_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = styles.style_rules(page_nodes(spark, sf_dir)).select("doc_id", "rule", "part", "selector", "kind", "name", "specificity", F.posexplode("declarations").alias("pos", "d"))
    return _page(rules).select("page_id", "rule", "part", "selector", "kind", "name", "specificity", "pos", F.col("d.name").alias("property"), F.col("d.value").alias("value"))


def css_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(styles.cascade(_pages(spark, sf_dir)))


def sanitize_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(styles.sanitized(page_nodes(spark, sf_dir)))


def svg_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drawing.baked(drawn.shapes(drawn.read(D.drawings(spark, sf_dir))))
    n = lambda *names: F.coalesce(*[drawing.number(F.col("attrs")[k]) for k in names])
    sizes = [n(k).alias(k.replace("-", "_")) for k in ("width", "height", "r", "font-size")]
    return out.select("doc_id", "shape_index", "tag", n("x", "cx").alias("x"), n("y", "cy").alias("y"), *sizes, F.col("attrs")["fill"].alias("fill"), "text", "baked")


def svg_paints(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = kept(drawn.read(D.drawings(spark, sf_dir), also=(*drawing.GRADIENTS, "stop"), wanted=("fill", "stroke")), "svg-paints")
    out = drawing.paints(table.filter("shape_index IS NOT NULL"), drawing.gradients(table.filter("shape_index IS NULL")))
    last = F.element_at("stops", -1)
    return out.select("doc_id", "shape_index", "property", "kind", F.size("stops").alias("stops"), last["offset"].alias("last_offset"), F.get("stops", F.lit(0))["color"].alias("first_color"), last["color"].alias("last_color"))


def svg_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawing.warnings(_drawn(spark, sf_dir))


def svg_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawing.written_shapes(drawing.baked(drawn.shapes(drawn.read(D.drawings(spark, sf_dir)))))


QUERIES = {f.__name__: f for f in (markup_tree, html_style_scan, css_cascade, sanitize_attrs, svg_shapes, svg_paints, svg_warnings, svg_markup)}

_ATTRS = r"""attrs AS (
  SELECT page_id, node, tag, name, value FROM (
    SELECT page_id, node, tag, unnest(regexp_extract_all(a, '([^\s=/>"]+)(?:\s*=\s*"([^"]*)")?', 1)) AS name, unnest(regexp_extract_all(a, '([^\s=/>"]+)(?:\s*=\s*"([^"]*)")?', 2)) AS value
    FROM (SELECT *, regexp_extract(m, '(?s)^<[A-Za-z][^\s/>]*((?:[^>"'']|"[^"]*"|''[^'']*'')*)>', 1) AS a FROM nodes WHERE tag <> '#text')))"""
_RULES = r"""blocks AS (
  SELECT page_id, node, unnest(regexp_extract_all(m, '([^{}>]+)\{([^{}]*)\}', 1)) AS selector, unnest(regexp_extract_all(m, '([^{}>]+)\{([^{}]*)\}', 2)) AS body FROM nodes WHERE tag = 'style')"""

SQL = {
    "markup_tree": f"""WITH RECURSIVE {PAGE_NODES_SQL}, {_ATTRS}, counted AS (SELECT page_id, node, count(*) AS c FROM attrs GROUP BY ALL)
SELECT page_id, CAST(node AS INTEGER) AS node, CAST(parent AS INTEGER) AS parent, CAST(depth AS INTEGER) AS depth, tag, path, CAST(coalesce(c, 0) AS INTEGER) AS n_attrs FROM nodes LEFT JOIN counted USING (page_id, node)""",
    "html_style_scan": f"""WITH RECURSIVE {PAGE_NODES_SQL}, {_RULES}
SELECT page_id, 0 AS rule, 0 AS part, selector, 'element' AS kind, selector AS name, 1 AS specificity, 0 AS pos, split_part(body, ':', 1) AS property, split_part(body, ':', 2) AS value FROM blocks""",
    "css_cascade": f"""WITH RECURSIVE {PAGE_NODES_SQL}, {_RULES}, hit AS (
  SELECT n.page_id, n.node, split_part(body, ':', 1) AS name, split_part(body, ':', 2) AS value FROM nodes n JOIN blocks b ON b.page_id = n.page_id AND b.selector = n.tag),
links AS (SELECT page_id, node, tag, unnest(chain) AS link FROM nodes WHERE tag <> '#text')
SELECT l.page_id, CAST(l.node AS INTEGER) AS node, l.tag, h.name, arg_max(h.value, l.link) AS value, CASE WHEN max(l.link) = l.node THEN 1 ELSE 0 END AS level
FROM links l JOIN hit h ON h.page_id = l.page_id AND h.node = l.link GROUP BY l.page_id, l.node, l.tag, h.name""",
    "sanitize_attrs": rf"""WITH RECURSIVE {PAGE_NODES_SQL}, {_ATTRS}
SELECT page_id, CAST(node AS INTEGER) AS node, tag, name, value, NOT starts_with(lower(name), 'on') AND (lower(name) <> 'href' OR regexp_matches(value, '(?i)^\s*(data:image/|https?:|/|\.{{0,2}}/|[\w.\-]+$)')) AS safe FROM attrs""",
    "svg_shapes": D.SVG_SHAPES_SQL,
    "svg_paints": D.SVG_PAINTS_SQL,
    "svg_warnings": D.SVG_WARNINGS_SQL,
    "svg_markup": D.SVG_MARKUP_SQL,
}
