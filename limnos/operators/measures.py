"""Measures of whole documents: area of the ring through their shapes, shares of colours, coverage by boxes.

Each takes one exchange by document. Shapes without a position or an area do not count; documents in which nothing counts give no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.bridge import CANVAS


def ring_area(shapes: DataFrame) -> DataFrame:
    """Signed area of the closed ring through the shapes' positions in the order of their index; of three positions and more."""
    at = Window.partitionBy("doc_id").orderBy("shape_index")
    ahead = {c: F.coalesce(F.lead(c).over(at), F.first(c).over(at)) for c in ("x", "y")}
    sides = shapes.filter("x IS NOT NULL AND y IS NOT NULL").select("doc_id", "x", "y", ahead["x"].alias("nx"), ahead["y"].alias("ny"))
    ring = sides.groupBy("doc_id").agg(F.count(F.lit(1)).alias("points"), (F.sum(F.expr("x * ny - nx * y")) / 2).alias("area"))
    return ring.filter("points >= 3").select("doc_id", "points", "area", F.abs("area").alias("size"))


def palette_report(shapes: DataFrame) -> DataFrame:
    """Colours of a document and the share of its shapes that have them, the commonest first."""
    fill = ["fill_r", "fill_g", "fill_b"]
    n = shapes.groupBy("doc_id", *fill).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("doc_id")
    return n.select(
        "doc_id", *fill, "n", F.round(F.col("n") / F.sum("n").over(whole), 6).alias("coverage"),
        F.row_number().over(whole.orderBy(F.desc("n"), *fill)).cast("long").alias("rank"),
    )


def box_coverage(shapes: DataFrame, canvas: float = CANVAS * CANVAS) -> DataFrame:
    """Share of the canvas that the areas of a document's rectangles add up to, not over 1."""
    area = shapes.filter("tag = 'rect' AND area IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("boxes"), F.sum("area").alias("area"))
    return area.select("doc_id", "boxes", F.round(F.least(F.lit(1.0), F.col("area") / canvas), 6).alias("coverage"))
