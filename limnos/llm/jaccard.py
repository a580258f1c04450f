"""N-gram Jaccard join by parity sketches.

A text's set of hashed word shingles is dealt into segments; the XOR of a segment's members is its word.
One member more or less changes one segment, so two sets whose symmetric difference is at most D agree in one of any
D + 1 segments. Sizes are cut into bands such that linked sets lie in one band or in neighbours; each pair of
bands has its own number of segments, and every set announces the words of its non-empty segments for the pairs of bands
it is part of (a set with too many empty segments does so again under another dealing; one that stays
so joins a bucket of its kind). Sets that share a word are candidates. Their parity sketches
(one bit for each of 2^k slots: the parity of the members there; a larger sketch folds onto a smaller one) are
compared: the Hamming distance is never above the symmetric difference, so pairs beyond the limit fall.
Those left are verified on the whole texts.

Groups of copies are drawn together before all words are compared, so that they are never expanded: equal sets are one node
(named by the least id that has the set). First only the ``LOW`` least words of each set are compared, every bucket's
members with its least node (in two levels, so that no word is too hot). Then all words are, packed by parts of the words: a
pair comes out only where a bucket's least node lies in another component than the member. At last the members of
buckets that still lie in several components are compared with the others there. No pair is lost: sets that
share a word end in one component or have been compared.

Defined cases: texts that are null, empty or blank have an empty set, no links and themselves as component; rows without
an id have no component; rows repeated with one id share its component; an empty table gives an empty result; very
long texts are sets like others; of ties the least id is named; other columns are ignored. Ids are whole numbers (others are refused).
Sets are compared by 64-bit hashes of their shingles and named by a 64-bit hash. The join's result is components, not the links in them.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bits import bit_filter, maybe, slot
from .common import LOWER, UPPER, drop_written, numbered, written
from .components import components
from .shingles import WordHash, mix, set_id, shingle_set

DEALINGS = 4
BLOCK_DOCS, BLOCK_WORDS = 8192, 1 << 22  # sets and words that are packed together before they travel
PACKED_BYTES = 8 << 20  # input for each packed partition of words
KEY_BYTES = 5  # of a word below the bits that name its part: parts hold as many words at every size, so chance meetings stay as rare
LOW = 4  # words of each pair of bands that the first comparison uses
SALTS = 64  # shares of one word there
SIDE, MEMBERS = 1024, 4096  # block sizes of the last comparison
LEADER_SHARE = 256  # members verified with one copy of the leader's text


class Bands:
    """Size bands for linking at percent, and the segments of each pair of neighbouring bands."""

    def __init__(self, percent: int, most: int = 1 << 40):
        self.percent, self.low = percent, [1]
        while self.low[-1] <= most:
            self.low.append(100 * self.low[-1] // percent + 1)
        self.edges = np.array(self.low, np.int64)
        self.known: dict[int, tuple[int, int]] = {}

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.edges, n, "right")) - 1

    def segments(self, band: int) -> tuple[int, int]:
        """Segments for sets of this band with this band and the next, and the most that may differ."""
        if band not in self.known:
            small = self.low[band + 1] - 1
            d = (100 - self.percent) * (small + 100 * small // self.percent) // (100 + self.percent)
            empty = (d + 1) * exp(-self.low[band] / (d + 1))
            self.known[band] = (d + 1 + (max(1, ceil(empty + 3 * sqrt(empty))) if d else 0), d)
        return self.known[band]


def words_by_band(x: np.ndarray, bands: Bands) -> list[np.ndarray]:
    """The 64-bit words that a sorted set announces for each pair of bands it is part of."""
    found, top = [], bands.of(len(x))
    with np.errstate(over="ignore"):
        for band in (top - 1, top):
            if band < 0:
                continue
            out: list[np.ndarray] = []
            s, d = bands.segments(band)
            for dealing in range(DEALINGS + 1):
                salt = mix(np.array([(band * (DEALINGS + 1) + dealing) * (1 << 32)], np.uint64))[0]
                if dealing == DEALINGS:
                    out.append(mix(np.array([salt], np.uint64)))
                    break
                y = x if not dealing else np.sort(mix(x ^ salt))
                part = ((y >> np.uint64(32)) * np.uint64(s)) >> np.uint64(32)
                starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                xor = np.bitwise_xor.reduceat(y, starts)
                out.append(mix(xor ^ mix(part[starts] + salt)))
                if s - len(starts) < s - d:
                    break
            found.append(np.concatenate(out))
    return found


def words_of_set(x: np.ndarray, bands: Bands) -> np.ndarray:
    """All words that a sorted set announces."""
    return np.concatenate(words_by_band(x, bands))


def parity_sketch(x: np.ndarray) -> bytes:
    """The parity of the members in each of 2^k slots, at least four slots a member."""
    m = max(64, 1 << (4 * len(x) - 1).bit_length())
    return np.packbits(np.bincount((x & np.uint64(m - 1)).astype(np.int64), minlength=m).astype(np.uint8) & 1, bitorder="little").tobytes()


def distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two parity sketches, the larger folded: a lower bound of the symmetric difference."""
    p, q = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    return int(np.bitwise_count(p ^ np.bitwise_xor.reduce(q.reshape(-1, len(p)), axis=0)).sum())


def within(h: np.ndarray | int, n: np.ndarray | int, m: np.ndarray | int, percent: int):
    """Whether a symmetric difference of h still lets sets of n and m members link."""
    return h * (100 + percent) <= (100 - percent) * (n + m)


def to_bytes(key: np.ndarray, width: int) -> bytes:
    """The highest bytes of words."""
    return (key >> np.uint64(64 - 8 * width)).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def from_bytes(blob: bytes, width: int, n: int = -1, at: int = 0) -> np.ndarray:
    """Words of which the highest bytes are known."""
    known = np.frombuffer(blob, np.uint8, n if n < 0 else n * width, at).reshape(-1, width)
    out = np.zeros((len(known), 8), np.uint8)
    out[:, 8 - width :] = known
    return out.view(np.uint64).reshape(-1)


def width_of(part_bits: int) -> int:
    """Bytes of a word that tell its part and KEY_BYTES below."""
    return min(8, KEY_BYTES - -part_bits // 8)


def pack(nodes: list[int], comps: list[int], keys: list[np.ndarray], part_bits: int) -> Iterator[tuple[int, bytes]]:
    """Words, their nodes and the components of these as bytes for each part."""
    ids, labels = np.array(nodes, np.int64), np.array(comps, np.int64)
    by_id = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.uint16)
    rank[by_id] = np.arange(len(ids))
    ids, labels = ids[by_id], labels[by_id]
    at = np.repeat(rank, [len(k) for k in keys])
    key = np.concatenate(keys)
    part = (key >> np.uint64(64 - part_bits)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part, key, at = part[order], (key << np.uint64(part_bits))[order], at[order]
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
    squeeze = zstandard.ZstdCompressor(1)
    for i, j in zip(starts, [*starts[1:], len(part)], strict=True):
        used, short = np.unique(at[i:j], return_inverse=True)
        head = squeeze.compress(np.diff(ids[used], prepend=0).tobytes() + (labels[used] - ids[used]).tobytes())
        yield int(part[i]), np.array([len(head), j - i], np.int64).tobytes() + head + short.astype(np.uint16).tobytes() + to_bytes(key[i:j], KEY_BYTES)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (as far as they travel), their nodes, the components of these."""
    head, n = np.frombuffer(blob, np.int64, 2).tolist()
    diffs, to_label = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[16 : 16 + head]), np.int64).reshape(2, -1)
    ids = np.cumsum(diffs)
    at = np.frombuffer(blob, np.uint16, n, 16 + head)
    return from_bytes(blob, KEY_BYTES, n, 16 + head + 2 * n), ids[at], (ids + to_label)[at]


SETS = "doc_id long, n long, set_id long, sketch binary, words binary, low array<long>"
SETS_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set_id", pa.int64()), ("sketch", pa.binary()), ("words", pa.binary()), ("low", pa.list_(pa.int64()))])


def _sets(size: int, percent: int, width: int):
    """The documents' sets; sketch and words come with the first row of a set in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, bands, local = WordHash(), Bands(percent), set()
        for whole in batches:
            for i in range(0, len(whole), 1000):
                batch, rows = whole.slice(i, 1000), []
                for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                    x = shingle_set(text, size, seen)
                    name = set_id(x) if len(x) else None
                    row = {"doc_id": doc, "n": len(x), "set_id": name}
                    if name is not None and doc is not None and name not in local:
                        if len(local) >= 1_000_000:
                            local.clear()
                        local.add(name)
                        keys = words_by_band(x, bands)
                        low = [np.partition(k, LOW)[:LOW] if len(k) > LOW else k for k in keys]
                        row |= {"sketch": parity_sketch(x), "words": to_bytes(np.concatenate(keys), width), "low": np.concatenate(low).astype(np.int64)}
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, SETS_ARROW)

    return run


def _packed(part_bits: int):
    """Of rows (root, comp, words): words by part."""
    width = width_of(part_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots: list[int] = []
        comps: list[int] = []
        keys: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for p, blob in pack(roots, comps, keys, part_bits) if roots else ():
                yield pa.record_batch([pa.array([p], pa.int32()), pa.array([blob], pa.binary())], names=["part", "packed"])
            for x in (roots, comps, keys):
                x.clear()

        for batch in batches:
            for root, comp, words in zip(batch["root"].to_pylist(), batch["comp"].to_pylist(), batch["words"].to_pylist(), strict=True):
                roots.append(root)
                comps.append(comp)
                keys.append(from_bytes(words, width))
                held += len(keys[-1])
                if len(roots) >= BLOCK_DOCS or held > BLOCK_WORDS:
                    yield from flush()
                    held = 0
        yield from flush()

    return run


BUCKETS = "a long, b long, members binary"
BUCKETS_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("members", pa.binary())])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by part: pairs of each bucket's least node with members of other components, and the members of buckets of three or more where there are such."""

    def close(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        got = [unpack(b) for b in blobs]
        key, node, comp = (np.concatenate([g[k] for g in got]) for k in range(3))
        order = np.lexsort((node, key))
        key, node, comp = key[order], node[order], comp[order]
        fresh = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
        key, node, comp = key[fresh], node[fresh], comp[fresh]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        lead = np.repeat(starts, sizes)
        other = comp != comp[lead]
        pairs = np.unique(np.stack([node[lead[other]], node[other]], 1), axis=0) if other.any() else np.empty((0, 2), np.int64)
        for i in range(0, len(pairs), 20_000):
            p = pairs[i : i + 20_000]
            yield pa.record_batch([pa.array(p[:, 0]), pa.array(p[:, 1]), pa.nulls(len(p), pa.binary())], BUCKETS_ARROW)
        mixed = (sizes > 2) & np.logical_or.reduceat(other, starts)
        seen: set[bytes] = set()
        for i, n in zip(starts[mixed], sizes[mixed], strict=True):
            seen.add(node[i : i + n].tobytes())
            if len(seen) >= 500:
                yield pa.record_batch([pa.nulls(len(seen), pa.int64())] * 2 + [pa.array(list(seen), pa.binary())], BUCKETS_ARROW)
                seen.clear()
        if seen:
            yield pa.record_batch([pa.nulls(len(seen), pa.int64())] * 2 + [pa.array(list(seen), pa.binary())], BUCKETS_ARROW)

    part, blobs = None, []
    for batch in batches:
        for p, blob in zip(batch["part"].to_pylist(), batch["packed"].to_pylist(), strict=True):
            if p != part and blobs:
                yield from close(blobs)
                blobs = []
            part = p
            blobs.append(blob)
    if blobs:
        yield from close(blobs)


def _near(percent: int):
    """Keeps pairs whose sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch[c].to_pylist() for c in ("na", "nb", "xa", "xb")]
            keep = [100 * min(n, m) >= percent * max(n, m) and within(distance(x, y), n, m, percent) for n, m, x, y in zip(*cols, strict=True)]
            yield batch.select(["a", "sa", "b", "sb"]).filter(pa.array(keep, pa.bool_()))

    return run


def _squeezed(bits: np.ndarray):
    """Texts of the ids that the filter lets pass, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(1)
        for batch in batches:
            batch = batch.filter(pa.array(maybe(bits, batch["slot"].to_numpy(zero_copy_only=False))))
            texts = [squeeze.compress((t or "").encode()) for t in batch["text"].to_pylist()]
            yield pa.record_batch([batch["doc_id"], pa.array(texts, pa.binary())], names=["doc_id", "z"])

    return run


def _verified(size: int, percent: int):
    """Of rows sorted by leader, share and kind: the members that link with the leader. Texts of another row of the same id are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, open_, leader, x = WordHash(), zstandard.ZstdDecompressor(), None, None
        for batch in batches:
            a, b = [], []
            for lead, named, doc, name, z in zip(*[batch[c].to_pylist() for c in ("a", "sa", "b", "sb", "z")], strict=True):
                y = shingle_set(open_.decompress(z).decode(), size, seen)
                if set_id(y) != (named if doc is None else name):
                    continue
                if doc is None:
                    leader, x = (lead, named), y
                    continue
                assert (lead, named) == leader
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both * 100 >= percent * (len(x) + len(y) - both):
                    a.append(lead)
                    b.append(doc)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _cross(percent: int):
    """For members outside the leader's component: those of other components that their sketches let link, as packed ids."""

    def run(group: pa.Table) -> pa.Table:
        side = np.array(group["side"].to_pylist())
        ids, comp, n = (np.array(group[c].to_pylist(), np.int64) for c in ("doc_id", "comp", "n"))
        sketch = group["sketch"].to_pylist()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, found = [], []
        folded: dict[int, np.ndarray] = {}

        def at(i: int, words: int) -> np.ndarray:
            return np.bitwise_xor.reduce(np.frombuffer(sketch[i], np.uint64).reshape(-1, words), axis=0)

        lengths = np.array([len(s) // 8 for s in sketch])
        for i in left:
            mates = []
            ok = right[(comp[right] != comp[i]) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))]
            for words in np.unique(np.minimum(lengths[ok], lengths[i])):
                js = ok[np.minimum(lengths[ok], lengths[i]) == words]
                mine = at(i, words)
                if words not in folded:
                    folded[words] = np.zeros((len(sketch), words), np.uint64)
                    for j in np.flatnonzero(lengths >= words):
                        folded[words][j] = at(j, words)
                h = np.bitwise_count(folded[words][js] ^ mine).sum(1).astype(np.int64)
                mates.append(ids[js[within(h, n[js], n[i], percent)]])
            if sum(map(len, mates)):
                a.append(ids[i])
                found.append(np.concatenate(mates).tobytes())
        return pa.table({"a": pa.array(a, pa.int64()), "mates": pa.array(found, pa.binary())})

    return run


def _mates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by node: each pair that any bucket has found, once."""

    def pairs(node: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        mates = np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in blobs]))
        for i in range(0, len(mates), 20_000):
            part = mates[i : i + 20_000]
            yield pa.record_batch([pa.array(np.minimum(part, node)), pa.array(np.maximum(part, node))], names=["a", "b"])

    node, blobs = None, []
    for batch in batches:
        for a, mates in zip(batch["a"].to_pylist(), batch["mates"].to_pylist(), strict=True):
            if a != node and blobs:
                yield from pairs(node, blobs)
                blobs = []
            node = a
            blobs.append(mates)
    if blobs:
        yield from pairs(node, blobs)


def _verify(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The pairs of nodes whose whole texts link, and the written table of texts that they are read from; pairs (a, sa, b, sb) is a written table."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    thin = docs.select("doc_id", "text", slot("doc_id").alias("slot")).filter("doc_id IS NOT NULL").mapInArrow(_squeezed(bit_filter(ids, "doc_id")), "doc_id long, z binary")
    texts = written(thin.join(ids.distinct(), "doc_id").dropDuplicates(["doc_id", "z"]), "texts")
    shares = pairs.groupBy("a", "sa").agg(F.ceil(F.count(F.lit(1)) / LEADER_SHARE).alias("shares"))
    members = pairs.join(shares, ["a", "sa"]).select("a", "sa", F.pmod(F.xxhash64("b", "sb"), F.col("shares")).alias("share"), "b", "sb")
    members = members.join(texts.select(F.col("doc_id").alias("b"), "z"), "b")
    none = F.lit(None).cast("long")
    leaders = shares.join(texts.select(F.col("doc_id").alias("a"), "z"), "a").select("a", "sa", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), none.alias("b"), none.alias("sb"), "z")
    rows = leaders.unionByName(members).repartition("a", "sa", "share").sortWithinPartitions("a", "sa", "share", F.col("b").asc_nulls_first())
    return rows.mapInArrow(_verified(size, percent), "a long, b long"), texts


def jaccard_join(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: the least id reachable by links, for every row."""
    spark = docs.sparkSession
    if docs.select(f"`{doc_id}`").schema[0].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{doc_id} has to be a whole number")
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    bytes_in = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    part_bits = (max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), min(1 << 22, bytes_in // PACKED_BYTES)) - 1).bit_length()
    sets = written(docs.mapInArrow(_sets(size, percent, width_of(part_bits)), SETS), "sets")
    members = written(sets.select("doc_id", "n", "set_id"), "members")
    sized = members.filter("set_id IS NOT NULL AND doc_id IS NOT NULL")
    named = written(sized.groupBy("set_id").agg(F.min("doc_id").alias("root")), "roots")
    told = sets.filter("words IS NOT NULL")
    nodes = written(told.select("set_id", "n", "sketch", "low").dropDuplicates(["set_id"]).join(named, "set_id"), "nodes")

    def near(pairs: DataFrame, label: str) -> DataFrame:
        """Of pairs of roots, those of sets whose sketches allow a link."""
        side = lambda c: nodes.select(F.col("root").alias(c), F.col("n").alias("n" + c), F.col("set_id").alias("s" + c), F.col("sketch").alias("x" + c))
        wide = pairs.distinct().join(side("a"), "a").join(side("b"), "b").filter("sa <> sb")
        return written(wide.select("a", "sa", "b", "sb", "na", "nb", "xa", "xb").mapInArrow(_near(percent), "a long, sa long, b long, sb long"), label)

    # Sets of rows repeated with one id belong together.
    repeated = sized.groupBy("doc_id").agg(F.min("set_id").alias("s"), F.max("set_id").alias("t")).filter("s <> t").select("doc_id")
    linked = written(sized.join(repeated, "doc_id").join(named, "set_id").select(F.col("doc_id").alias("a"), F.col("root").alias("b")).distinct(), "links")
    comps = named.select("set_id", "root", F.col("root").alias("comp"))

    def join_links(found: DataFrame) -> bool:
        """Verifies candidate pairs and draws the components of their links together; whether there were any."""
        nonlocal linked, comps
        if not found.head(1):
            return False
        new, texts = _verify(found, docs, size, percent)
        linked = linked.unionByName(written(new, "links"))
        drop_written(found, texts)
        label = components(linked.select(F.col("a").alias("u"), F.col("b").alias("v")))
        comps = written(named.join(label.withColumnRenamed("node", "root"), "root", "left").select("set_id", "root", F.coalesce("label", "root").alias("comp")), "labels")
        return True

    # First the least words of each set: in each share of a word with the least node there, and these with the word's least node.
    low = nodes.select("root", F.pmod(F.xxhash64("root"), F.lit(SALTS)).alias("salt"), F.explode("low").alias("word"))
    share = low.groupBy("word", "salt").agg(F.min("root").alias("a"))
    least = share.groupBy("word").agg(F.min("a").alias("a"))
    inner = low.join(share, ["word", "salt"]).select("a", F.col("root").alias("b"))
    outer = share.withColumnRenamed("a", "b").join(least, "word").select("a", "b")
    join_links(near(inner.unionByName(outer).filter("a <> b"), "near"))

    # Then all words, between components.
    packed = told.select("set_id", "words").join(comps, "set_id").select("root", "comp", "words").mapInArrow(_packed(part_bits), "part int, packed binary")
    found = written(packed.repartition("part").sortWithinPartitions("part").mapInArrow(_buckets, BUCKETS), "buckets")
    drop_written(sets)
    join_links(near(found.filter("members IS NULL").select("a", "b"), "near"))

    # Buckets with members outside their least node's component: these are compared with all the others there.
    opened = found.filter("members IS NOT NULL").select("members").distinct().select(F.xxhash64("members").alias("bucket"), "members").mapInArrow(_open, "bucket long, lead long, root long")
    c = comps.select("root", "comp").distinct()
    placed = opened.join(c, "root").join(c.select(F.col("root").alias("lead"), F.col("comp").alias("lead_comp")), "lead")
    placed = written(placed.select("bucket", "root", "comp", (F.col("comp") != F.col("lead_comp")).alias("minor")), "placed")
    counts = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("minor").cast("long")).alias("k")).filter("k > 0")
    blocks = counts.select("bucket", F.ceil(F.col("k") / SIDE).alias("sides"), F.ceil(F.col("m") / MEMBERS).alias("blocks"))
    todo = placed.join(blocks, "bucket").join(nodes.select("root", "n", "sketch"), "root")
    here = F.xxhash64("root", "bucket")
    upto = lambda k: F.sequence(F.lit(0).cast("long"), F.col(k) - 1)
    both = todo.filter("minor").select("*", F.lit(0).alias("side"), F.pmod(here, "sides").alias("i"), F.explode(upto("blocks")).alias("j")).unionByName(
        todo.select("*", F.lit(1).alias("side"), F.explode(upto("sides")).alias("i"), F.pmod(here, "blocks").alias("j"))
    )
    crossed = both.select("bucket", "i", "j", "side", F.col("root").alias("doc_id"), "comp", "n", "sketch").groupBy("bucket", "i", "j").applyInArrow(_cross(percent), "a long, mates binary")
    join_links(near(crossed.repartition("a").sortWithinPartitions("a").mapInArrow(_mates, "a long, b long"), "near"))
    drop_written(nodes, found, placed)
    out = members.join(comps, "set_id", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each member of a bucket."""
    for batch in batches:
        for name, blob in zip(batch["bucket"].to_pylist(), batch["members"].to_pylist(), strict=True):
            ids = np.frombuffer(blob, np.int64)
            yield pa.record_batch([pa.array(np.full(len(ids), name)), pa.array(np.full(len(ids), ids[0])), pa.array(ids)], names=["bucket", "lead", "root"])


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, that with the least id (an id before none), with its own columns; rows are told apart by number, whatever their ids."""
    rows, row = numbered(docs)
    found = jaccard_join(rows, size, percent, row, text).select(F.col("doc_id").alias(row), F.col("component_id").alias("_component"))
    named = found.join(rows.select(row, F.col(f"`{doc_id}`").alias("_id")), row)
    best = named.groupBy("_component").agg(F.min_by(row, F.struct(F.col("_id").isNull(), "_id", row)).alias(row)).select(row)
    return rows.join(best, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle(size: int, percent: int) -> str:
    """DuckDB SQL for jaccard_join over documents with distinct ids: all pairs that share a shingle, and what is reachable by links."""
    return f"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
runs AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {size - 2}), lambda i: array_to_string(list_slice(w, i, i + {size - 1}), ' ')) END) AS g FROM split),
sizes AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM runs x JOIN runs y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
linked AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM sizes UNION SELECT b, root FROM reach JOIN both_ways ON a = reach.doc_id WHERE root < b),
least AS (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.doc_id = d.doc_id"""
