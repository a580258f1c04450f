"""Design data derived from the generic tables, by the same rules in Spark and in SQL.

shapes: a row for each line item, its order the document; candidates: a row for each order, its customer the request;
lifecycle: a row for each event, its user the request.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CANVAS = 1080.0
ORDER = "l_linenumber l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
# Width of a character, ascent and descent of the fallback font, in em.
ADVANCE, ASCENT, DESCENT = 0.58, 0.80, 0.20


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    at = Window.partitionBy("doc_id").orderBy(*ORDER)
    # Numbered under the name that all readers know, before anything is derived: the one exchange carries no derived column, is the same for all
    # readers of a plan, and serves what they do by document.
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(c("l_orderkey").alias("doc_id"), *ORDER).withColumn("shape_index", (F.row_number().over(at) - 1).cast("long"))
    d = lambda x: c(x).cast("double")
    out = line.select(
        "doc_id", "shape_index",
        F.when(c("l_returnflag") == "A", "rect").when(c("l_returnflag") == "N", "circle").otherwise("text").alias("tag"),
        (d("l_quantity") * 20).alias("x"), (d("l_partkey") / 2).alias("y"), (d("l_suppkey") * 2 + 8).alias("width"), (d("l_linenumber") * 24 + 8).alias("height"),
        (d("l_suppkey") / 4 + 1).alias("radius"), (c("l_partkey") * 37 % 256).cast("int").alias("fill_r"), (c("l_suppkey") * 91 % 256).cast("int").alias("fill_g"),
        (F.floor("l_extendedprice") % 256).cast("int").alias("fill_b"), (d("l_discount") * 50).alias("stroke_width"), (d("l_tax") * 500 + 10).alias("font_size"),
        F.when(c("l_linestatus") == "O", "Inter").otherwise("Comic Sans MS").alias("font_family"), (c("l_linenumber") * 3).cast("long").alias("text_len"),
        (c("l_suppkey") * 53 % 256).cast("int").alias("stroke_r"), (c("l_partkey") * 71 % 256).cast("int").alias("stroke_g"), (c("l_linenumber") * 29 % 256).cast("int").alias("stroke_b"),
        (1 - d("l_discount") * 2).alias("opacity"),
    )
    return out.withColumns(box(out))


def box(_: DataFrame) -> dict:
    """Bounds and area of a shape; a text's area is unknown."""
    c = F.col
    pick = lambda rect, circle, text: F.when(c("tag") == "rect", rect).when(c("tag") == "circle", circle).otherwise(text)
    return {
        "x0": pick(c("x"), c("x") - c("radius"), c("x")),
        "y0": pick(c("y"), c("y") - c("radius"), c("y") - c("font_size") * ASCENT),
        "x1": pick(c("x") + c("width"), c("x") + c("radius"), c("x") + c("font_size") * ADVANCE * c("text_len")),
        "y1": pick(c("y") + c("height"), c("y") + c("radius"), c("y") + c("font_size") * DESCENT),
        "area": F.when(c("tag") == "rect", c("width") * c("height")).when(c("tag") == "circle", F.lit(3.14159) * c("radius") * c("radius")),
    }


SHAPES_SQL = f"""
shapes0 AS (
  SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ORDER)}) - 1 AS shape_index,
         CASE l_returnflag WHEN 'A' THEN 'rect' WHEN 'N' THEN 'circle' ELSE 'text' END AS tag,
         l_quantity * 20e0 AS x, l_partkey / 2e0 AS y, l_suppkey * 2e0 + 8e0 AS width, l_linenumber * 24e0 + 8e0 AS height, l_suppkey / 4e0 + 1e0 AS radius,
         CAST(l_partkey * 37 % 256 AS INT) AS fill_r, CAST(l_suppkey * 91 % 256 AS INT) AS fill_g, CAST(CAST(floor(l_extendedprice) AS BIGINT) % 256 AS INT) AS fill_b,
         l_discount * 50e0 AS stroke_width, l_tax * 500e0 + 10e0 AS font_size, CASE l_linestatus WHEN 'O' THEN 'Inter' ELSE 'Comic Sans MS' END AS font_family,
         CAST(l_linenumber * 3 AS BIGINT) AS text_len, CAST(l_suppkey * 53 % 256 AS INT) AS stroke_r, CAST(l_partkey * 71 % 256 AS INT) AS stroke_g,
         CAST(l_linenumber * 29 % 256 AS INT) AS stroke_b, 1e0 - l_discount * 2e0 AS opacity
  FROM lineitem),
shapes AS (
  SELECT *, CASE tag WHEN 'circle' THEN x - radius ELSE x END AS x0,
         CASE tag WHEN 'rect' THEN y WHEN 'circle' THEN y - radius ELSE y - font_size * {ASCENT}e0 END AS y0,
         CASE tag WHEN 'rect' THEN x + width WHEN 'circle' THEN x + radius ELSE x + font_size * {ADVANCE}e0 * text_len END AS x1,
         CASE tag WHEN 'rect' THEN y + height WHEN 'circle' THEN y + radius ELSE y + font_size * {DESCENT}e0 END AS y1,
         CASE tag WHEN 'rect' THEN width * height WHEN 'circle' THEN 3.14159e0 * radius * radius END AS area
  FROM shapes0)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("candidate"), F.col("o_custkey").alias("request"), F.row_number().over(at).cast("long").alias("attempt"),
        F.least(F.lit(100.0), (F.floor("o_totalprice") % 1010).cast("double") / 10).alias("score_after"), F.col("o_orderdate").alias("creation"),
    )


CANDIDATES_SQL = """
candidates AS (
  SELECT o_orderkey AS candidate, o_custkey AS request, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS attempt,
         least(100e0, (CAST(floor(o_totalprice) AS BIGINT) % 1010) / 10e0) AS score_after, o_orderdate AS creation
  FROM orders)"""

STATUS = {"signup": "Draft", "view": "Queued", "click": "Processing", "purchase": "Ready", "error": "Failed"}


def status_of(kind):
    out = None
    for k, v in STATUS.items():
        out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
    return out


def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", F.col("user_id").alias("request"), "ts", status_of(F.col("event_type")).alias("status"))


LIFECYCLE_SQL = f"""
lifecycle AS (
  SELECT event_id, user_id AS request, ts, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items())} END AS status
  FROM events)"""
