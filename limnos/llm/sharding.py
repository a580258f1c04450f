"""Two-pass external shuffle of records into shards, with built-in functions only.

Pass 1 writes every record once with a row number and a seeded hash of it, so that later steps read fixed rows
(a lost executor changes nothing). The hash scatters records uniformly, whatever their key, source or text, into buckets
that hold about ``bucket_rows`` records and ``bucket_bytes`` bytes. Pass 2 draws a Fisher-Yates permutation for each bucket
and lays the buckets end to end: the record at global place p goes to shard p mod n, slot p div n, so the
counts of shards differ by one at most and slots have no gaps.

One exchange carries the whole records, by ranges of buckets; a bucket is never held as a whole: its size and offset travel
as a row ahead of its records, the task that gets it draws the permutation from them, and the records, numbered in a spillable
sort, look their place up there. As the buckets of a
task lie end to end, so do its places, and the shards are written from there without another exchange.

Defined cases: a null text has size 1 and crc 0; null ids and repeated rows are records like any other, told apart by their row
numbers, so there are no ties; a very long text is a record of its bucket like any other;
an empty table gives an empty result; input columns keep their names inside the ``record`` struct, so they
cannot clash with the columns added here.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, written

SEED = 20_240_229
BUCKET_BYTES, BUCKET_ROWS = 8 << 20, 1024
GROUP = 1024  # buckets whose offsets are summed together first


def fisher_yates(n: Column, *seed: Column) -> Column:
    """A permutation of 0 .. n-1 as an array, drawn inside out with seeded hashes."""

    def step(a, i):
        j = F.pmod(F.xxhash64(*seed, i), i + 1).cast("int")
        swapped = F.concat(F.slice(a, F.lit(1), j), F.array(i), F.slice(a, j + 2, i - j - 1), F.array(F.get(a, j)))
        return F.when(j == i, F.concat(a, F.array(i))).otherwise(swapped)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.array().cast("array<int>"), step)


def measures(text: Column) -> tuple[Column, Column]:
    """size and text_crc32 of a text."""
    t = F.coalesce(text, F.lit(""))
    return (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32")


def scatter(records: DataFrame, text: str, seed: int) -> DataFrame:
    """Pass 1: record, size, text_crc32, row number and place hash, written to the shared folder."""
    out = records.select(
        F.struct(*[F.col(f"`{c}`") for c in records.columns]).alias("record"),
        *measures(F.col(f"`{text}`")),
        F.monotonically_increasing_id().alias("row"),
    )
    return written(out.withColumn("place", F.xxhash64(F.lit(seed), "row", "text_crc32")), "scatter")


def bucket_table(rows: DataFrame) -> DataFrame:
    """bucket, its offset in the whole order, its number of records; offsets are summed in two levels."""
    sized = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("g", F.floor(F.col("bucket") / GROUP))
    inner = Window.partitionBy("g").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    groups = sized.groupBy("g").agg(F.sum("n").alias("m")).select("g", F.coalesce(F.sum("m").over(whole), F.lit(0)).alias("base"))
    placed = sized.withColumn("below", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(groups, "g")
    return placed.select("bucket", (F.col("base") + F.col("below")).alias("offset"), "n")


def shuffle_records(
    records: DataFrame, shards: int = 8, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS, text: str = "text"
) -> DataFrame:
    """record, size, text_crc32, shard, slot: every record once, in a shuffled order."""
    first = scatter(records, text, seed)
    total = first.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
    buckets = max(1, -(-total["n"] // bucket_rows), -(-total["b"] // bucket_bytes))
    rows = first.withColumn("bucket", F.pmod(F.col("place"), F.lit(buckets))).drop("place")
    heads = bucket_table(rows).withColumn("row", F.lit(-1).cast("long"))
    dealt = rows.unionByName(heads, allowMissingColumns=True).repartitionByRange("bucket")
    dealt = dealt.withColumn("order", F.when(F.col("row") < 0, fisher_yates(F.col("n").cast("int"), F.lit(seed), F.col("bucket"))))
    within = Window.partitionBy("bucket").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = [F.first(c, ignorenulls=True).over(within).alias(c) for c in ("offset", "order")]
    numbered = dealt.select("record", "size", "text_crc32", "row", *told, (F.row_number().over(Window.partitionBy("bucket").orderBy("row")) - 1).alias("i"))
    at = F.col("offset") + F.element_at("order", F.col("i"))
    return numbered.filter("row >= 0").select(
        "record", "size", "text_crc32", (at % shards).cast("int").alias("shard"), F.floor(at / shards).cast("long").alias("slot")
    )


def write_shards(shuffled: DataFrame, path: str, slots_per_file: int = 1 << 20) -> None:
    """Writes path/shard=k/ with the records of shuffle_records in slot order, also from file to file; a file has at most so many slots."""
    shuffled.sortWithinPartitions("shard", "slot").write.option("maxRecordsPerFile", slots_per_file).option("compression", "zstd").partitionBy("shard").parquet(path)


def written_shards(shuffled: DataFrame) -> DataFrame:
    """The shuffled records as read from shards in the shared folder."""
    path = f"{shared_dir(shuffled.sparkSession)}/limnos-shards-{uuid.uuid4().hex}"
    write_shards(shuffled, path)
    return shuffled.sparkSession.read.schema(shuffled.schema).parquet(path)


def digests(shards: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every record, size and crc taken anew from the text in the shard."""
    size, crc = measures(F.col(f"record.`{text}`"))
    return shards.select("record.doc_id", size, crc, "shard", "slot")
