"""Not-modified revisits of web archives, resolved to the responses that they confirm.

Records are ordered by canonical URL, time, kind and id over range partitions, so one URL with a third of all
records is spread over many of them. Each partition is read as a stream that carries the last full response of
the current URL; what a partition's first URL needs from partitions before it comes from a table with
two rows a partition. A revisit takes the latest response strictly earlier than itself. It is resolved if the validators agree
(entity tag if both have one, weak tags by their value; else the modification date; else the payload digest) and
then gets the response's headers, overlaid with those of its own that a 304 may update. Payloads
are never copied: ``resolved_from`` names the record that holds the payload.

Defined cases: records without URL or time resolve to nothing; among responses at one time the largest id is the latest;
repeated records are each resolved; null headers count as none, header names are taken in lower case, the last of repeated ones in
sorted order counts; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .urls import canonical

# Header fields that a 304 response may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")

BASE = "record_id long, etag string, last_modified string, digest string, headers map<string,string>"


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the last response of the same URL in this partition; a final row has the last URL and its last response."""
    part, first, key, base = TaskContext.get().partitionId(), None, None, None
    n = 0
    for batch in batches:
        bases, heads = [], []
        for k, response, described in zip(batch["key"].to_pylist(), batch["response"].to_pylist(), batch["described"].to_pylist(), strict=True):
            if k != key:
                key, base = k, None
                first = k if not n else first
            n += 1
            bases.append(base)
            heads.append(key == first and base is None)
            if response:
                base = described
        kind = pa.nulls(len(batch), pa.int32()).fill_null(part)
        yield pa.record_batch([*batch.columns, pa.array(bases, pa.string()), pa.array(heads, pa.bool_()), kind, pa.nulls(len(batch), pa.bool_()).fill_null(False)], names=[*batch.schema.names, "base", "head", "part", "edge"])
    if n:
        for at, (k, b) in enumerate(((first, None), (key, base))):
            row = {"key": k, "base": b, "part": 2 * part + at, "edge": True}
            names = [*batch.schema.names, "base", "head", "part", "edge"]
            kinds = [*batch.schema.types, pa.string(), pa.bool_(), pa.int32(), pa.bool_()]
            yield pa.record_batch([pa.array([row.get(c)], t) for c, t in zip(names, kinds, strict=True)], names=names)


def _lower(headers: Column) -> Column:
    pairs = F.array_sort(F.transform(F.map_entries(F.coalesce(headers, F.expr("cast(map() AS map<string,string>)"))), lambda e: F.struct(F.lower(e.key).alias("k"), e.value.alias("v"))))
    last = F.filter(pairs, lambda e, i: F.coalesce(F.get(pairs, i + 1).k != e.k, F.lit(True)))
    return F.map_from_entries(last)


def resolve(records: DataFrame) -> DataFrame:
    """Of records (record_id, url, ts, kind 'response' or 'revisit', etag, last_modified, digest, headers): record_id, kind,
    state, resolved_from, digest, headers (merged) for each."""
    kept = records.select("record_id", "url", "ts", "kind", "etag", "last_modified", "digest", _lower(F.col("headers")).alias("headers"))
    usable = (F.col("url").isNotNull() & F.col("ts").isNotNull()).alias("usable")
    rows = kept.select(
        F.when(usable, canonical(F.col("url"))).alias("key"), "ts", (F.col("kind") == "response").alias("response"), "record_id", "kind",
        F.to_json(F.struct("record_id", "etag", "last_modified", "digest", "headers")).alias("described"),
    )
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.filter("key IS NOT NULL").repartitionByRange(parts, "key", "ts", "response", "record_id").sortWithinPartitions("key", "ts", "response", "record_id")
    shape = "key string, ts timestamp, response boolean, record_id long, kind string, described string, base string, head boolean, part int, edge boolean"
    seen = written(ordered.mapInArrow(_carried, shape), "carried")
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    edges = seen.filter("edge").select("key", "part", F.last("base", ignorenulls=True).over(before).alias("carry")).filter("part % 2 = 0 AND carry IS NOT NULL")
    heads = edges.select("key", F.expr("part div 2").cast("int").alias("part"), "carry", F.lit(True).alias("head"))
    joined = seen.filter("NOT edge").join(heads, ["key", "part", "head"], "left")
    lost = rows.filter("key IS NULL").select("record_id", "kind", "described", F.lit(None).cast("string").alias("basis"))
    both = joined.select("record_id", "kind", "described", F.coalesce("base", "carry").alias("basis")).unionByName(lost)
    own, old = F.from_json("described", BASE), F.from_json("basis", BASE)
    both = both.select("record_id", "kind", own.alias("own"), old.alias("old"))
    tag = lambda c: F.regexp_replace(F.col(c), "^W/", "")
    same = F.coalesce(tag("own.etag") == tag("old.etag"), F.col("own.last_modified") == F.col("old.last_modified"), F.col("own.digest") == F.col("old.digest"), F.lit(False))
    state = F.when(F.coalesce(F.col("kind") == "response", F.lit(False)), "response").when(F.col("old").isNull(), "no response").when(same, "resolved").otherwise("changed")
    fresh = F.map_filter("own.headers", lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("old.headers", lambda k, _: ~F.map_contains_key(fresh, k)), fresh)
    done = F.col("state") == "resolved"
    return both.withColumn("state", state).select(
        "record_id", "kind", "state", F.when(done, F.col("old.record_id")).alias("resolved_from"),
        F.when(done, F.col("old.digest")).otherwise(F.col("own.digest")).alias("digest"),
        F.when(done, merged).otherwise(F.col("own.headers")).alias("headers"),
    )


def header_text(headers: Column) -> Column:
    """Headers as one line in order of their names."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e.key, F.lit(": "), e.value))), "; ")


