"""Merkle manifest of a table, kept in an external-memory node store.

Leaves are digests of rows. They are sorted by tree (here: language) and id into runs, written as level 0 and numbered from the runs'
lengths. A node's coordinate is (tree, level, position). Levels are built in strata of ``STEP``: a task reads blocks of
2^STEP sorted nodes of a stratum's lowest level one after the other, holds one block, and streams the nodes above it into Parquet
partitioned by level; the last level of a stratum is the next one's input, a thousandth of it in length. Subroots form one more
tree of the same kind, in bytewise order of their keys with null first.

Proofs go downwards: the paths of a stratum's top nodes are known, each block's nodes come from the store sorted by coordinate,
and a merge-scan over (block: path, nodes, requests) appends to the path of the block what each request lacks. A block is never split and
never larger than 2^(STEP+1) nodes, however many rows a tree holds, so a tree with a third of all rows is many blocks.

Only the number of leaves of the largest tree (one number) and the digest of the root reach the driver.

Defined cases: null columns are `-`; leaves of one tree ascend by id, null first, ties by their digest, so equal rows stand side by side and
have leaves of their own; a null id is never tampered with; a null tree key is a tree of its own, the first; a text of any
length is one digest; an empty table has no nodes, no root and no rows; columns other than the leaf's are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, written

STEP = 10
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree string, level int, pos long, n long, hash binary"
PATH, NODES, ASKED = 0, 1, 2  # order of the kinds within a block


def field(value: Column) -> Column:
    """`-` for null, else the number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(row: dict[str, Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(row[c]) for c in COLUMNS]), 256))


def leaves(docs: DataFrame, forged: Column | None = None) -> DataFrame:
    """tree, id, leaf, other (leaf of the row with n_chars one higher where ``forged`` says so, else null) of every row."""
    row = {c: docs[c] for c in COLUMNS}
    more = row | {"n_chars": docs["n_chars"].cast("decimal(20,0)") + 1}
    forged = F.lit(False) if forged is None else forged
    return docs.select(
        docs["lang"].alias("tree"), docs["doc_id"].alias("id"), leaf(row).alias("hash"),
        F.when(forged & docs["n_chars"].isNotNull(), leaf(more)).alias("other"), F.monotonically_increasing_id().alias("row"),
    )


def numbered_runs(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes sorted into runs, with pos (place in the tree) and n (leaves of the tree); written.

    Runs are ranges of (tree, order), so that a tree of any size is spread over tasks; a run's rows are numbered in their order and the runs'
    lengths, a table of one row for each tree in each run, are summed up.
    """
    runs = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    runs = written(runs.withColumn("at", F.monotonically_increasing_id()), "runs").withColumn("run", F.shiftright("at", 33))
    same_tree = F.col("tree").eqNullSafe(F.col("t"))
    lengths = runs.groupBy("tree", "run").agg(F.count(F.lit(1)).alias("m"), F.min("at").alias("first"))
    before = Window.partitionBy("tree").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    lengths = lengths.select(
        F.col("tree").alias("t"), F.col("run").alias("u"), (F.coalesce(F.sum("m").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("m").over(Window.partitionBy("tree")).alias("n"),
    )
    placed = runs.join(lengths, same_tree & (F.col("run") == F.col("u"))).withColumn("pos", F.col("at") + F.col("shift"))
    return placed.drop("t", "u", "run", "at", "shift")


def block(levels: int) -> Column:
    return F.shiftright("pos", levels)


def _height(n: int) -> int:
    """Levels above n nodes until one remains."""
    return (n - 1).bit_length()


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def _grown(low: int, step: int):
    """Nodes of the next levels above ``low`` from blocks of sorted nodes; the leaves pass through."""
    kinds = {"tree": pa.string(), "level": pa.int32(), "pos": pa.int64(), "n": pa.int64(), "hash": pa.binary()}

    def above(tree, block, n, hashes):
        level, first = low, block << step
        for _ in range(min(step, _height(n))):
            level, first, n = level + 1, first >> 1, (n + 1) >> 1
            hashes = [sha256("".join(hashes[i : i + 2]).encode()).hexdigest() for i in range(0, len(hashes), 2)]
            yield from ((tree, level, first + i, n, bytes.fromhex(h)) for i, h in enumerate(hashes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, held, n = [], None, [], 0
        for batch in batches:
            if low == 0:
                yield pa.record_batch([batch[c] for c in kinds], names=list(kinds))
            for tree, pos, size, h in zip(*[batch[c].to_pylist() for c in ("tree", "pos", "n", "hash")], strict=True):
                if now != (tree, pos >> step):
                    if now:
                        out.extend(above(*now, n, held))
                    now, held, n = (tree, pos >> step), [], size
                held.append(h.hex())
                if len(out) >= 1 << step:
                    yield _batch(out, kinds)
                    out = []
        if now:
            out.extend(above(*now, n, held))
        yield _batch(out, kinds)

    return run


class NodeStore:
    """Nodes of a forest in Parquet partitioned by level, built from numbered runs (tree, pos, n, hash).

    n is the number of nodes of the tree on the node's level; a tree ends at the level where it is 1.
    """

    def __init__(self, runs: DataFrame, step: int = STEP):
        self.step = step
        self.spark, self.runs = runs.sparkSession, runs
        self.path = f"{shared_dir(self.spark)}/limnos-nodes-{uuid.uuid4().hex}"
        most = runs.agg(F.max("n")).first()[0] or 0
        self.strata = list(range(0, max(1, _height(most)), self.step)) if most else []
        now = runs.select("tree", F.lit(0).alias("level"), "pos", "n", "hash")
        for low in self.strata:
            blocks = now.filter((F.col("n") > 1) | F.lit(low == 0)).repartitionByRange("tree", block(self.step)).sortWithinPartitions("tree", "pos")
            grown = blocks.mapInArrow(_grown(low, self.step), NODE).sortWithinPartitions("level", "tree", "pos")
            grown.write.mode("append").option("compression", "zstd").partitionBy("level").parquet(self.path)
            now = self.nodes().filter(F.col("level") == low + self.step)

    def nodes(self) -> DataFrame:
        if not self.strata:
            return self.spark.createDataFrame([], NODE)
        return self.spark.read.schema(NODE).parquet(self.path)

    def subroots(self) -> DataFrame:
        """tree, height and hash of the last node of each tree."""
        return self.nodes().filter("n = 1").select("tree", F.col("level").alias("height"), "hash")

    def paths(self, asked: DataFrame, tops: DataFrame) -> DataFrame:
        """asked (tree, pos, n and whatever else) with path: the steps from a leaf to its subroot, then those of tops (tree, height, path).

        Steps are joined by commas: L or R and the digest of the sibling on that side, or N where there is none.
        """
        above = None
        for low in reversed(self.strata):
            here = self.nodes().filter((F.col("level") >= low) & (F.col("level") < low + self.step) & (F.col("n") > 1))
            inside = here.select("tree", F.expr(f"shiftright(pos, {low + self.step} - level)").alias("block"), F.lit(NODES).alias("kind"), "level", "pos", "n", "hash")
            start = tops.filter(F.greatest(F.lit(0), F.floor((F.col("height") - 1) / self.step) * self.step) == low).select("tree", F.lit(0).cast("long").alias("block"), "path")
            start = start if above is None else start.unionByName(above)
            if low == 0:
                ask = asked.select("tree", block(self.step).alias("block"), F.lit(ASKED).alias("kind"), "pos", "n", F.struct(*asked.columns).alias("row"))
            else:
                ask = here.filter(F.col("level") == low).select("tree", block(self.step).alias("block"), F.lit(ASKED).alias("kind"), "pos", "n", F.struct("tree", "pos").alias("row"))
            every = start.withColumn("kind", F.lit(PATH)).unionByName(inside, allowMissingColumns=True).unionByName(ask, allowMissingColumns=True)
            every = every.repartitionByRange("tree", "block").sortWithinPartitions("tree", "block", "kind")
            met = every.mapInArrow(_merged(low, self.step), f"row {every.schema['row'].dataType.simpleString()}, path string")
            if low:
                above = written(met.select("row.tree", F.col("row.pos").alias("block"), "path"), "paths")
        return met.select("row.*", "path")


def _merged(low: int, step: int):
    """A path for each request of a block: its siblings among the block's nodes, then the block's own path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tail, known = None, "", {}
        for batch in batches:
            rows, paths = [], []
            columns = [batch[c].to_pylist() for c in ("tree", "block", "kind", "level", "pos", "n", "hash", "path")]
            for i, (tree, block, kind, level, pos, n, h, path) in enumerate(zip(*columns, strict=True)):
                if now != (tree, block):
                    now, tail, known = (tree, block), "", {}
                if kind == PATH:
                    tail = path
                elif kind == NODES:
                    known[level, pos] = h.hex()
                else:
                    steps, level = [], low
                    while n > 1 and level < low + step:
                        other = pos ^ 1
                        steps.append(("L" if pos & 1 else "R") + known[level, other] if other < n else "N")
                        level, pos, n = level + 1, pos >> 1, (n + 1) >> 1
                    rows.append(i)
                    paths.append(",".join([*steps, tail] if tail else steps))
            asked = batch["row"].take(pa.array(rows, pa.int64()))
            for k in range(0, len(rows), 1 << step):
                yield pa.record_batch([asked.slice(k, 1 << step), pa.array(paths[k : k + (1 << step)], pa.string())], names=["row", "path"])

    return run


def folded(h: str, steps: list[str]) -> str:
    """The root that a leaf and its path lead to."""
    for s in steps:
        if s[0] != "S":
            h = sha256((s[1:] + h if s[0] == "L" else h + s[1:]).encode()).hexdigest()
    return h


class Manifest:
    """Merkle forest of a table's rows, one tree for each value of lang, and the tree of their subroots."""

    def __init__(self, docs: DataFrame, forged: Column | None = None, step: int = STEP):
        self.rows = numbered_runs(leaves(docs, forged), ["id", "hash", "row"])
        self.rows = written(self.rows, "leaves")
        self.trees = NodeStore(self.rows, step)
        subroots = self.trees.subroots().select(F.lit(None).cast("string").alias("tree"), F.col("tree").alias("key"), "height", "hash")
        self.subroots = written(numbered_runs(subroots, ["key"]), "subroots")
        self.top = NodeStore(self.subroots, step)
        root = self.top.subroots().first()
        self.root = root and bytes(root["hash"]).hex()

    def proofs(self, asked: DataFrame | None = None) -> DataFrame:
        """Rows of self.rows (all, or those asked) with path: steps to the subroot, then S and the subroot's digest, then steps to the root."""
        ends = self.top.subroots().select("tree", "height", F.lit("").alias("path"))
        tops = self.top.paths(self.subroots.drop("row"), ends) if self.root else self.subroots.withColumn("path", F.lit(""))
        marked = F.concat_ws(",", F.concat(F.lit("S"), F.lower(F.hex("hash"))), F.when(F.col("path") != "", F.col("path")))
        tops = written(tops.select(F.col("key").alias("tree"), "height", marked.alias("path")), "tops")
        asked = self.rows if asked is None else asked
        return self.trees.paths(asked, tops) if self.root else asked.withColumn("path", F.lit(""))


def _checked(root: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for leaf, other, path in zip(*[batch[c].to_pylist() for c in ("hash", "other", "path")], strict=True):
                steps = path.split(",")
                subroot = next(s[1:] for s in steps if s[0] == "S")
                proof = "".join(s[1:] for s in steps if s[0] != "S")
                got = folded((leaf if other is None else other).hex(), steps)
                out.append((leaf.hex(), subroot, root, sha256(proof.encode()).hexdigest(), got, got == root))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.string()] * 5 + [pa.bool_()]
            names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
            yield pa.record_batch([batch["id"], *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=names)

    return run


def checked(manifest: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row: each forged leaf, or else the leaf itself, folded along the original path."""
    kind = manifest.rows.schema["id"].dataType.simpleString()
    names = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return manifest.proofs().select("id", "hash", "other", "path").mapInArrow(_checked(manifest.root), f"doc_id {kind}, {names}")


def seventh(doc_id: Column) -> Column:
    """Whether the crc32 of the id in decimal is divisible by 7; never for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, F.lit(False))


def oracle() -> str:
    """The same with all nodes of a level made at once, by recursion over levels and, for the folds, over steps."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda n: "sha256(" + " || ".join(field(n if c == "n_chars" else c) for c in COLUMNS) + ")"
    crc_byte = "list_reduce(list_prepend(xor(c, b) & 255, range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: xor({crc_byte}, c >> 8)))"
    grow = lambda t, k: f"""SELECT level + 1, {k}, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM {t} WHERE n > 1 GROUP BY level, {k}, pos // 2, n"""
    return f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, {leaf("n_chars")} AS leaf,
    CASE WHEN n_chars IS NOT NULL AND {crc} % 7 = 0 THEN {leaf("(CAST(n_chars AS HUGEINT) + 1)")} END AS other FROM documents
), p AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d
), nodes(level, lang, pos, n, h) AS (
  SELECT 0, lang, pos, n, leaf FROM p UNION ALL {grow("nodes", "lang")}
), subs AS (SELECT lang, h, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops(level, t, pos, n, h) AS (
  SELECT 0, 1, pos, n, h FROM subs UNION ALL {grow("tops", "t")}
), levels AS (SELECT lang, level, max(n) AS n FROM nodes GROUP BY lang, level
), upper AS (SELECT level, max(n) AS n FROM tops GROUP BY level
), steps AS (
  SELECT p.r, l.level AS k, (p.pos >> l.level) & 1 AS odd, s.h FROM p JOIN levels l ON p.lang IS NOT DISTINCT FROM l.lang AND l.n > 1
  LEFT JOIN nodes s ON s.level = l.level AND s.lang IS NOT DISTINCT FROM p.lang AND s.pos = xor(p.pos >> l.level, 1)
  UNION ALL
  SELECT p.r, 1000 + u.level, (s.pos >> u.level) & 1, t.h FROM p JOIN subs s ON s.lang IS NOT DISTINCT FROM p.lang JOIN upper u ON u.n > 1
  LEFT JOIN tops t ON t.level = u.level AND t.pos = xor(s.pos >> u.level, 1)
), ranked AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY k) AS k, odd, h FROM steps
), folds(r, k, h) AS (
  SELECT r, 0, coalesce(other, leaf) FROM p
  UNION ALL
  SELECT f.r, CAST(f.k + 1 AS INTEGER), sha256(CASE WHEN s.h IS NULL THEN f.h WHEN s.odd = 1 THEN s.h || f.h ELSE f.h || s.h END) FROM folds f JOIN ranked s ON s.r = f.r AND s.k = f.k + 1
), ends AS (SELECT r, arg_max(h, k) AS h FROM folds GROUP BY r
), proofs AS (SELECT r, sha256(coalesce(string_agg(h, '' ORDER BY k), '')) AS h FROM ranked GROUP BY r
)
SELECT p.doc_id, p.leaf, s.h AS subroot, (SELECT h FROM tops WHERE n = 1) AS root, coalesce(q.h, sha256('')) AS proof_sha256, e.h AS folded_root,
  e.h = (SELECT h FROM tops WHERE n = 1) AS verified
FROM p JOIN subs s ON s.lang IS NOT DISTINCT FROM p.lang JOIN ends e USING (r) LEFT JOIN proofs q USING (r)
"""
