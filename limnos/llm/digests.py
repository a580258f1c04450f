"""Exact duplicates by a persistent index of digests, bucketed and sorted by digest.

The index holds one entry for each different text: its digest (SHA-256 of the text without white space), the row that
stands for it and the length of that row's original text. New rows are folded by digest first, so that copies meet in the
map-side aggregation, and dealt to the index's buckets; the sort-merge anti-join with the index then needs no exchange
of the index. What is left is appended to the same buckets. ``DigestIndex.open`` finds an index again from its folder
alone; ``compacted`` merges the files of each bucket into one sorted file, with another number of buckets if wanted.

Of new rows with equal texts the one with the most code points in its original text is kept, then the least id (null last),
then the first row; texts already in the index are never kept again. An index that takes arrivals in order of falling
length therefore keeps the longest of all.

Defined cases: a null text counts as empty, and empty and blank texts are equal; null ids and repeated rows are rows like any
other, exactly one row of a group is kept; a text of any length is one digest; an empty table gives no rows and an
empty index; columns other than the id and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, written

SPACES = " \t\n\x0b\x0c\r"
BUCKET_ROWS = 1 << 20  # entries that a bucket of a new index is meant to hold
LONG = 2_000  # code points from which a text arrives first in op12
HOT_SHARE = 1_000  # a group with a thousandth of all rows is hot: there are at most a thousand of them
ENTRY = "digest binary, keep_id {id}, keep_row long, keep_length int"


def digest(text: Column) -> Column:
    """SHA-256 of a text without the six characters of white space."""
    text = F.coalesce(text, F.lit(""))
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return F.unhex(F.sha2(text, 256))


def digested(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, digest, length (code points of the original) of every row, as a written table without texts."""
    got = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), digest(F.col(f"`{text}`")).alias("digest"),
        F.length(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("length"),
    )
    return written(got, "digests")


class DigestIndex:
    """A folder of Parquet files, bucketed and sorted by digest, known to this session as a table."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, id_type: str = "bigint"):
        self.spark, self.path, self.buckets, self.id_type = spark, path, buckets, id_type
        self.name = f"limnos_digests_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} ({ENTRY.format(id=id_type)}) USING parquet OPTIONS (compression 'zstd') "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    @classmethod
    def new(cls, spark: SparkSession, rows: int, id_type: str = "bigint", path: str | None = None) -> DigestIndex:
        """An empty index whose buckets fit so many entries; its number of buckets is part of the folder's name."""
        buckets = max(8, -(-rows // BUCKET_ROWS))
        return cls(spark, f"{path or f'{shared_dir(spark)}/limnos-index-{uuid.uuid4().hex}'}-{buckets}", buckets, id_type)

    @classmethod
    def open(cls, spark: SparkSession, path: str, id_type: str = "bigint") -> DigestIndex:
        return cls(spark, path, int(path.rpartition("-")[2]), id_type)

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, rows: DataFrame) -> None:
        """Appends an entry for each digest of rows (row, doc_id, digest, length) that the index does not have."""
        first = F.min(F.struct((-F.col("length")).alias("l"), F.isnull("doc_id").alias("u"), "doc_id", "row")).alias("k")
        best = rows.groupBy("digest").agg(first).repartition(self.buckets, "digest")
        new = best.join(self.entries().select("digest").hint("merge"), "digest", "left_anti")
        self._append(new.select("digest", F.col("k.doc_id").alias("keep_id"), F.col("k.row").alias("keep_row"), (-F.col("k.l")).alias("keep_length")))

    def _append(self, entries: DataFrame) -> None:
        entries.write.insertInto(self.name)

    def compacted(self, buckets: int | None = None, path: str | None = None) -> DigestIndex:
        """The same entries in a new folder, one sorted file for each bucket."""
        out = DigestIndex.new(self.spark, (buckets or self.buckets) * BUCKET_ROWS, self.id_type, path)
        out._append(self.entries().repartition(out.buckets, "digest"))
        return out


def deduplicated(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """Every row of ``digested`` with keep_id, group_size and kept, once the index has taken it in.

    A copied text may hold a third of all rows. Groups with a thousandth of the rows or more, of which there are a thousand
    at most, meet their rows by broadcast; the rest meet theirs by a join on the digest.
    """
    total = rows.count()
    sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size")).repartition(index.buckets, "digest")
    groups = written(sizes.join(index.entries().hint("merge"), "digest").select("digest", "keep_id", "keep_row", "group_size"), "groups")
    hot = groups.filter(F.col("group_size") * HOT_SHARE >= total)
    met = rows.join(F.broadcast(hot), "digest", "left")
    cold = met.filter("group_size IS NULL").drop("keep_id", "keep_row", "group_size").join(groups, "digest")
    both = met.filter("group_size IS NOT NULL").unionByName(cold)
    return both.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest")


def exact_duplicates(docs: DataFrame, arrivals: tuple[int, ...] = (LONG, 0), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs, by way of an index built from nothing.

    Rows arrive in the order of ``arrivals``, falling least lengths of which the last is 0: whatever is longer is in the
    index before, so the row kept is the longest of its whole group.
    """
    rows = digested(docs, doc_id, text)
    index = DigestIndex.new(docs.sparkSession, rows.count(), docs.schema[doc_id].dataType.simpleString())
    for least, longer in zip(arrivals, (None, *arrivals), strict=False):
        index.add(rows.filter((F.col("length") >= least) & (F.lit(True) if longer is None else F.col("length") < longer)))
    return deduplicated(rows, index).withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def oracle() -> str:
    return r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
), r AS (
  SELECT doc_id, text_sha256, first_value(doc_id) OVER w AS keep_id, row_number() OVER w = 1 AS kept, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY length(t) DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM r
"""
