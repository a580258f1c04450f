"""Byte-pair encoding and decoding with reuse of content-defined chunks.

A rolling hash of the last bytes cuts every text where the content says so. Chunks that occur more than once
anywhere in the table are encoded once; a text's other stretches are encoded in place. Where two stretches meet, the
tokens around the joint are encoded again, from the last place before it to the first place behind it where
a printable ASCII character stands before a blank, and further out until two such windows agree. No pre-token of
a byte-level pattern crosses such a place, so the result is that of the whole text.

Texts without reused chunks need no exchange. For the others their chunks' tokens, never their texts, are
exchanged. A bit filter of fixed size tells which chunks may be reused; where it errs, a chunk is
encoded by itself and joined like any other.

Defined cases: a null or empty text has no tokens and decodes to the empty text; the special token's
string in a text becomes the special token; ids and repeated rows are carried as they are; an empty table gives an
empty result; only the id and the text of the input are read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bits import BITS, bit_filter, maybe
from .common import written

CUT_BITS = 9  # chunks of 512 bytes on average
CONTEXT = 16  # bytes that decide a cut
# Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, np.uint32)


class Codec:
    """A byte-level BPE vocabulary: encodes bytes, knows each token's bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        assert model["type"] == "BPE" and spec["pre_tokenizer"]["type"] == "ByteLevel" and not spec["pre_tokenizer"]["add_prefix_space"], "only byte-level BPE"
        assert spec.get("normalizer") is None and not any(t[k] for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word"))
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(shown[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
        for k, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            assert model["vocab"][a + b] == 256 + k, "a token's id must be the rank of its merge"
        self.coder = tiktoken.Encoding("table", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = added
        by_id = {i: t for t, i in ranks.items()} | {i: s.encode() for s, i in added.items()}
        self.bytes_of = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        opens = np.array([t[0] in b" \n" if t else False for t in self.bytes_of])
        closes = np.array([0x21 <= t[-1] <= 0x7E if t else False for t in self.bytes_of])
        self.opens, self.closes = opens, closes
        self.packed = "<u2" if len(self.bytes_of) <= 1 << 16 else "<u4"  # tokens while they travel
        self.seams: dict[bytes, np.ndarray] = {}

    def encode(self, text: bytes) -> np.ndarray:
        return self.coder.encode_to_numpy(text.decode(), disallowed_special=())

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def seam(self, text: bytes) -> np.ndarray:
        if text not in self.seams:
            if len(self.seams) > 50_000:
                self.seams.clear()
            self.seams[text] = self.encode(text)
        return self.seams[text]

    def parted(self, text: str) -> list[bytes | int]:
        """Stretches of ordinary text, and special tokens between them."""
        out: list[bytes | int] = [text.encode()]
        for s, i in self.special.items():
            if s in text:
                split = []
                for x in out:
                    for k, y in enumerate(x.split(s.encode()) if isinstance(x, bytes) else [x]):
                        split += [i, y] if k else [y]
                out = split
        return [x for x in out if x != b""]

    def cuts_before(self, ids: np.ndarray) -> Iterator[int]:
        """Token places, from the end backwards, at which a printable character ends and a blank begins; last 0."""
        hi = len(ids)
        step = 32
        while hi > 1:
            lo = max(1, hi - step)
            yield from (np.flatnonzero(self.opens[ids[lo:hi]] & self.closes[ids[lo - 1 : hi - 1]])[::-1] + lo).tolist()
            hi, step = lo, step * 2
        yield 0

    def cuts_after(self, ids: np.ndarray) -> Iterator[int]:
        """The same from the start forwards; last the end."""
        lo, step = 1, 32
        while lo < len(ids):
            hi = min(len(ids), lo + step)
            yield from (np.flatnonzero(self.opens[ids[lo:hi]] & self.closes[ids[lo - 1 : hi - 1]]) + lo).tolist()
            lo, step = hi, step * 2
        yield len(ids)

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Tokens of two texts put together, from the tokens of each."""
        if not len(left) or not len(right):
            return np.concatenate([left, right])
        before, after = self.cuts_before(left), self.cuts_after(right)
        i, j = next(before), next(after)
        now = self.seam(self.decode(left[i:]) + self.decode(right[:j]))
        while i > 0 or j < len(right):
            k, m = next(before, 0), next(after, len(right))
            wider = self.seam(self.decode(left[k:]) + self.decode(right[:m]))
            if np.array_equal(wider, np.concatenate([left[k:i], now, right[j:m]])):
                break
            i, j, now = k, m, wider
        return np.concatenate([left[:i], now, right[j:]])


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def chunks(text: bytes) -> list[bytes]:
    """Cuts where a rolling hash of the last bytes says so, between characters."""
    if len(text) <= CONTEXT:
        return [text]
    b = np.frombuffer(text, np.uint8)
    h = GEAR[b]
    span = 1
    while span < CONTEXT:
        h[span:] += h[:-span] << np.uint32(span)  # the right side is computed first
        span *= 2
    at = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0)
    at = at[at >= CONTEXT - 1] + 1
    while len(at) and (inside := (b[np.minimum(at, len(b) - 1)] & 0xC0 == 0x80) & (at < len(b))).any():
        at = at + inside
    at = np.unique(at[at < len(b)])
    ends = [*at.tolist(), len(text)]
    return [text[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]


def name(chunk: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(chunk)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _counted(path: str):
    """Names of chunks and how often each occurs among the rows of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            n: dict[tuple[int, int], int] = {}
            for text in batch["text"].to_pylist():
                for x in c.parted(text or ""):
                    for y in chunks(x) if isinstance(x, bytes) else ():
                        k = name(y)
                        n[k] = n.get(k, 0) + 1
            yield pa.record_batch([pa.array([k[0] for k in n], pa.int64()), pa.array([k[1] for k in n], pa.int64()), pa.array(n.values(), pa.int64())], names=["k1", "k2", "n"])

    return run


def _stretches(c: Codec, text: str, bits: np.ndarray) -> list[bytes | int | tuple[int, int, bytes]]:
    """A text as special tokens, stretches of its own, and chunks that may be reused (with their names)."""
    out: list = []
    for x in c.parted(text):
        if isinstance(x, int):
            out.append(x)
            continue
        fresh = True  # a stretch of its own never runs on across a special token
        parts = chunks(x)
        names = [name(y) for y in parts]
        hit = maybe(bits, np.array([k[0] for k in names], np.int64) & (BITS - 1))
        for y, k, shared in zip(parts, names, hit.tolist(), strict=True):
            if shared:
                out.append((*k, y))
            elif fresh or not isinstance(out[-1], bytes):
                out.append(y)
            else:
                out[-1] += y
            fresh = False
    return out


def _tokens(c: Codec, pieces: list[np.ndarray | int]) -> np.ndarray:
    """Puts encoded stretches and special tokens together."""
    done: list[np.ndarray] = []
    now = np.empty(0, np.uint32)
    for p in pieces:
        if isinstance(p, int):
            done += [now, np.array([p], np.uint32)]
            now = np.empty(0, np.uint32)
        else:
            now = c.join(now, p)
    return np.concatenate([*done, now])


def _out(ids: list, tokens: list[np.ndarray], c: Codec) -> pa.RecordBatch:
    texts = [c.decode(t).decode("utf-8", "replace") for t in tokens]
    return pa.record_batch([ids, pa.array([t.astype("<u4").tobytes() for t in tokens], pa.binary()), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])


ROWS = 256  # texts put out at once


def _own(path: str, bits: np.ndarray):
    """Encodes and decodes the texts that reuse nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for whole in batches:
            for i in range(0, len(whole), ROWS):
                batch = whole.slice(i, ROWS)
                keep, tokens = [], []
                for text in batch["text"].to_pylist():
                    parts = _stretches(c, text or "", bits)
                    keep.append(not any(isinstance(x, tuple) for x in parts))
                    if keep[-1]:
                        tokens.append(_tokens(c, [c.encode(x) if isinstance(x, bytes) else x for x in parts]))
                yield _out(batch["doc_id"].filter(pa.array(keep, pa.bool_())), tokens, c)

    return run


def _shared(path: str, bits: np.ndarray):
    """The other texts: a row for each piece, and one for each reused chunk of a batch with its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for whole in batches:
            for i in range(0, len(whole), ROWS):
                batch = whole.slice(i, ROWS)
                at, rows, seen = [], [], {}
                for k, text in enumerate(batch["text"].to_pylist()):
                    parts = _stretches(c, text or "", bits)
                    if not any(isinstance(x, tuple) for x in parts):
                        continue
                    for pos, x in enumerate(parts):
                        at.append(k)
                        if isinstance(x, tuple):
                            rows.append((pos, x[0], x[1], None, None))
                            seen[x[:2]] = x[2]
                        else:
                            ids = np.array([x], np.uint32) if isinstance(x, int) else c.encode(x)
                            rows.append((pos, None, None, isinstance(x, int), ids.astype(c.packed).tobytes()))
                n = len(seen)
                head = batch.select(["row", "doc_id"]).take(pa.array(at, pa.int64()))
                cols = list(zip(*rows, strict=True)) if rows else [()] * 5
                made = [*head.columns, *[pa.array(x, kind) for x, kind in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], pa.nulls(len(at), pa.binary())]
                yield pa.record_batch(made, names=PIECES)
                none = [pa.nulls(n, t) for t in (head["row"].type, head["doc_id"].type, pa.int32())]
                yield pa.record_batch([*none, pa.array([k[0] for k in seen], pa.int64()), pa.array([k[1] for k in seen], pa.int64()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary()), pa.array(seen.values(), pa.binary())], names=PIECES)

    return run


PIECES = ["row", "doc_id", "pos", "k1", "k2", "special", "ids", "chunk"]


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            ids = [c.encode(x).astype(c.packed).tobytes() for x in batch["chunk"].to_pylist()]
            yield pa.record_batch([batch["k1"], batch["k2"], pa.array(ids, pa.binary())], names=["k1", "k2", "shared"])

    return run


def _joined(path: str):
    """Of pieces sorted by row and place: the texts' tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, row, doc, pieces, kind = codec(path), None, None, [], None

        def close() -> pa.RecordBatch:
            return _out(pa.array([doc], kind), [_tokens(c, pieces)], c)

        for batch in batches:
            kind = batch["doc_id"].type
            for r, d, special, ids in zip(*(batch[x].to_pylist() for x in ("row", "doc_id", "special", "ids")), strict=True):
                if r != row and row is not None:
                    yield close()
                    pieces = []
                row, doc = r, d
                got = np.frombuffer(ids, c.packed).astype(np.uint32)
                pieces.append(int(got[0]) if special else got)
        if row is not None:
            yield close()

    return run


def encode_decode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), decoded (the text that the ids give) for every row."""
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.select("text").mapInArrow(_counted(path), "k1 long, k2 long, n long").groupBy("k1", "k2").agg(F.sum("n").alias("n"))
    bits = bit_filter(counted.filter("n > 1"), "k1", at=F.pmod(F.col("k1"), F.lit(BITS)))
    own = docs.mapInArrow(_own(path, bits), f"doc_id {kind}, ids binary, decoded string")
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    pieces = written(numbered.mapInArrow(_shared(path, bits), f"row long, doc_id {kind}, pos int, k1 long, k2 long, special boolean, ids binary, chunk binary"), "pieces")
    once = pieces.filter("chunk IS NOT NULL").groupBy("k1", "k2").agg(F.first("chunk").alias("chunk"))
    tokens = written(once.mapInArrow(_encoded(path), "k1 long, k2 long, shared binary"), "chunks")
    placed = pieces.filter("row IS NOT NULL").drop("chunk")
    known = placed.filter("k1 IS NOT NULL").join(tokens, ["k1", "k2"]).select("row", "doc_id", "pos", F.lit(False).alias("special"), F.col("shared").alias("ids"))
    rows = placed.filter("k1 IS NULL").select("row", "doc_id", "pos", "special", "ids").unionByName(known)
    rows = rows.repartition("row").sortWithinPartitions("row", "pos")
    return own.unionByName(rows.mapInArrow(_joined(path), f"doc_id {kind}, ids binary, decoded string"))


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode_decode's rows."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
