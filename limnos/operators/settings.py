"""Nested settings as rows: a leaf for each path, and layers merged by joins on paths.

A text in JSON is opened level by level, as many levels as the deepest document has; arrays and empty objects are leaves. Where two layers meet, the later
one wins for each path: its leaf replaces whatever the earlier has at that path or below, its objects replace an earlier leaf above them, and all
else stays side by side. Paths meet by equality, each path once for each of its beginnings, so nothing is compared in pairs.

Defined cases: null or blank texts, and texts that are no JSON object, have no leaves and change nothing; an empty object changes nothing where the
earlier layer has an object, and replaces a leaf; null values are leaves; keys may hold any character, paths are arrays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def leaves(texts: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, path, value (as JSON) of every leaf."""
    kind = lambda: F.schema_of_variant("v")
    is_object = lambda: F.coalesce(kind().startswith("OBJECT<") & (kind() != "OBJECT<>"), F.lit(False))
    now = texts.select(F.col(f"`{doc_id}`").alias("doc_id"), F.array().cast("array<string>").alias("path"), F.try_parse_json(F.col(f"`{text}`")).alias("v")).filter(kind().startswith("OBJECT<"))
    found = []
    while True:
        found.append(now.filter(~is_object()).select("doc_id", "path", F.to_json("v").alias("value")))
        inner = now.filter(is_object())
        if inner.isEmpty():
            break
        names = F.json_object_keys(F.to_json("v"))
        entries = F.from_json(F.to_json("v"), "map<string,variant>")
        now = inner.select("doc_id", "path", F.explode(F.transform(names, lambda k: F.struct(k.alias("k"), entries[k].alias("v")))).alias("e"))
        now = now.select("doc_id", F.concat("path", F.array("e.k")).alias("path"), F.coalesce("e.v", F.parse_json(F.lit("null"))).alias("v"))
    return reduce(DataFrame.unionByName, found).filter(F.size("path") > 0)


def beginnings(path: Column, least: int, less: int) -> Column:
    """The paths that a path begins with, from ``least`` keys to all but ``less``."""
    return F.transform(F.filter(F.sequence(F.lit(least), F.greatest(F.size(path) - less, F.lit(least))), lambda n: n <= F.size(path) - less), lambda n: F.slice(path, 1, n))


def merged(base: DataFrame, over: DataFrame) -> DataFrame:
    """doc_id, path, value, origin (base or override) of two layers of leaves merged."""
    at = ["doc_id", "path"]
    empty = F.col("value") == "{}"
    above = base.select("doc_id", F.explode(beginnings(F.col("path"), 1, 1)).alias("path")).distinct()
    wins = over.join(above.withColumn("object", F.lit(True)), at, "left").filter(~(empty & F.coalesce("object", F.lit(False)))).drop("object")
    replaced = wins.select(*at).distinct()
    under = over.select("doc_id", F.explode(beginnings(F.col("path"), 1, 1)).alias("path")).distinct()
    begins = base.select(*at, "value", F.explode(beginnings(F.col("path"), 1, 0)).alias("start"))
    gone = begins.join(replaced.withColumnRenamed("path", "start"), ["doc_id", "start"]).select(*at).unionByName(base.join(under, at).select(*at)).distinct()
    stays = base.join(gone, at, "left_anti")
    return stays.withColumn("origin", F.lit("base")).unionByName(wins.withColumn("origin", F.lit("override")))
