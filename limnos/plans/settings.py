"""Settings of a system for each supplier: a base and what a tenant changes, merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import settings as S
from ..sources.storage import kept

BASE = """concat('{"color": {"tokens": {"primary": {"hex": "#1a56db", "role": "primary"}, "ink": "#111827"}, "max": ', CAST(s_suppkey % 9 AS {t}), '}, "grid": 8, "type": {"scale": [12, 14], "note": null}}')"""
OVER = """CASE s_suppkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '{}' WHEN 2 THEN concat('{"grid": ', CAST(s_nationkey AS {t}), '}') WHEN 3 THEN '{"color": {"tokens": {"primary": "#000000"}}}'
  WHEN 4 THEN '{"grid": {"x": 4, "y": {}}, "color": {"max": {}, "tokens": {"accent": {"hex": "#f59e0b"}}}, "type": {}}' ELSE 'no settings' END"""


def system_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("doc_id"), F.expr(BASE.replace("{t}", "STRING")).alias("base"), F.expr(OVER.replace("{t}", "STRING")).alias("over"))
    base, over = (kept(S.leaves(texts, side), f"{side}-leaves") for side in ("base", "over"))
    return S.merged(base, over).select(F.col("doc_id").alias("system"), F.array_join("path", ".").alias("path"), "value", "origin")


QUERIES = {"system_merge": system_merge}
_B = """('color.tokens.primary.hex', '"#1a56db"', 3), ('color.tokens.primary.role', '"primary"', 3), ('color.tokens.ink', '"#111827"', -1), ('color.max', NULL, 4), ('grid', '8', 2), ('type.scale', '[12,14]', -1), ('type.note', 'null', -1)"""
_O = """(2, 'grid', NULL), (3, 'color.tokens.primary', '"#000000"'), (4, 'grid.x', '4'), (4, 'grid.y', '{}'), (4, 'color.max', '{}'), (4, 'color.tokens.accent.hex', '"#f59e0b"')"""
#: What each layer holds and which base leaf goes under which change, stated leaf by leaf.
SQL = {
    "system_merge": f"""WITH b AS (SELECT * FROM (VALUES {_B}) AS t(path, value, gone)), o AS (SELECT * FROM (VALUES {_O}) AS t(way, path, value))
SELECT s_suppkey AS system, path, coalesce(value, CAST(s_suppkey % 9 AS VARCHAR)) AS value, 'base' AS origin FROM supplier, b WHERE s_suppkey % 6 <> gone AND NOT (s_suppkey % 6 = 4 AND path = 'grid')
UNION ALL SELECT s_suppkey, path, coalesce(value, CAST(s_nationkey AS VARCHAR)), 'override' FROM supplier, o WHERE s_suppkey % 6 = way""",
}
