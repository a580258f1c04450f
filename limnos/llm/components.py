"""Connected components of an edge table by alternating large-star and small-star steps.

Both steps are one aggregate and one join on the edge table, never a collected group; each round is written to the
shared folder. The joins can be split where a node has very many edges. An empty edge table gives no labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Each node's neighbours that are larger (or not larger) are tied to its least neighbour or itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if small:
        both = both.filter(F.col("v") < F.col("u"))
    least = both.groupBy("u").agg(F.min("v").alias("w")).withColumn("m", F.least("w", "u")).drop("w")
    tied = both.join(least, "u")
    if small:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = tied.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node reachable, for every node that has an edge; edges: two long columns u, v."""
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(F.col("u") != F.col("v")).distinct(), "edges")

    def state(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()

    seen = state(now)
    while seen[0]:
        before, now = now, written(_star(_star(now, small=False), small=True), "edges")
        drop_written(before)
        last, seen = seen, state(now)
        if last == seen:
            break
    labels = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
    return labels.unionByName(roots.join(labels, "node", "left_anti"))
