"""Benchmark decontamination by latent semantic retrieval.

Texts and benchmark items are cut into halves of ``STEP`` words; two halves that follow each other are a passage, so passages
overlap by half. Passages are TF-IDF vectors over the items' vocabulary, with the frequencies of its words over all texts. A
randomised SVD (one pass: every task multiplies its passages with a seeded random matrix, forward and back; the sums give a
Nystrom decomposition) yields the latent space. A passage and an item are a candidate pair if the passage holds ``WEAK`` of as many
of the item's words as half a passage (or the item) has, and if its cosine with one of the item's passages reaches ``COSINE``.
The counts of words come first, for all items at once: a word has a bit for each item, and the bits of a passage's words are
added up in bit planes. Pairs that pass, and around whose passage the text holds ``WEAK`` of the item's words at all, are projected
and compared.
The longest common subsequence of the item's words and the text around the candidate decides: ``STRONG`` of the item's words
suffice, ``WEAK`` do for a paraphrase if the item's answer (its last sentence) is found too.

Equal items are looked for once. Items are worked on in blocks of bounded number and size (``ITEMS``, ``ITEM_BYTES``), so what
tasks are given is bounded; texts are read once for each block, encoded, and never exchanged. Only sums of fixed size
(vocabulary by rank) are shuffled.

Defined cases: texts and items that are null or have no words match nothing; repeated rows and items are each
reported; rows without an id are reported without one; very long texts are read whole, 250,000 words at a time or one text; of places
with equally many words in common order the first is reported; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, written

STEP, RANK, COSINE, STRONG, WEAK, ANSWER = 12, 96, 0.3, 0.8, 0.6, 0.75
WORDS_KEPT = 300_000
ITEMS, ITEM_BYTES, SEED, BATCH_WORDS, REGIONS = 2_000, 4 << 20, 5, 250_000, 4_000
EDGES = re.compile(r"^\W+|\W+$")
SENTENCE = re.compile(r"[.?!\n]+")


def words(text: str | None) -> list[str]:
    """Lower-case words between blanks, without the marks around them."""
    return [w for x in (text or "").lower().split() if (w := EDGES.sub("", x))]


class Item(NamedTuple):
    key: int  # of its text
    ids: np.ndarray  # words as numbers from 1
    answer: np.ndarray  # those of the last sentence


def read_items(rows: list) -> tuple[list[Item], dict[str, int]]:
    """Items with words, and the number of each of their words."""
    number: dict[str, int] = {}
    code = lambda ws: np.array([number.setdefault(w, len(number) + 1) for w in ws], np.int64)
    items = []
    for r in rows:
        if ws := words(r["text"]):
            last = next((s for s in reversed([words(x) for x in SENTENCE.split(r["text"])]) if s), ws)
            items.append(Item(r["key"], code(ws), code(last)))
    return items, number


class Halves(NamedTuple):
    """Texts cut into halves of STEP words."""

    terms: np.ndarray  # a row of words for each half, 0 where the text has ended; one row of zeros at the end
    begins: np.ndarray  # halves at which a passage begins: all but the last of a text, or the only one
    first: np.ndarray  # each text's first half, and the number of halves

    @classmethod
    def of(cls, seqs: list[np.ndarray]) -> Halves:
        lengths = np.array([len(s) for s in seqs], np.int64)
        halves = -(-lengths // STEP)
        first = np.r_[0, np.cumsum(halves)]
        terms = np.zeros((int(first[-1]) + 1) * STEP, np.int32)
        if len(seqs):
            ends = np.cumsum(lengths)
            at = np.arange(int(ends[-1])) + np.repeat(first[:-1] * STEP - (ends - lengths), lengths)
            terms[at] = np.concatenate(seqs)
        begins = np.ones(int(first[-1]), bool)
        begins[first[1:][halves > 1] - 1] = False
        return cls(terms.reshape(-1, STEP), begins, first)

    def text_of(self, half: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, half, "right") - 1

    def follower(self, half: np.ndarray) -> np.ndarray:
        """The half that ends the passage that begins here: the next, or the row of zeros where the text has only this one."""
        alone = np.diff(self.first)[self.text_of(half)] == 1
        return np.where(alone, len(self.terms) - 1, half + 1)


def projected(terms: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Sums of the basis over each row's words; word 0 has to weigh nothing."""
    y = np.zeros((len(terms), basis.shape[1]), np.float32)
    got = np.empty_like(y)
    for j in range(STEP):
        y += np.take(basis, terms[:, j], axis=0, out=got, mode="clip")
    return y


def item_bits(items: list[Item], size: int) -> np.ndarray:
    """For each word a bit for each item that has it."""
    bits = np.zeros((size, -(-len(items) // 64)), np.uint64)
    for k, x in enumerate(items):
        bits[x.ids, k // 64] |= np.uint64(1) << np.uint64(k % 64)
    return bits


def _bit_planes(values: np.ndarray, width: int) -> list[np.ndarray]:
    """Numbers, one for each item (the highest for bits without an item), as planes of bits."""
    out, values = [], np.r_[values, np.full(64 * width - len(values), 31)]
    for p in range(5):
        plane = np.zeros(width, np.uint64)
        for k in np.flatnonzero((values >> p) & 1):
            plane[k // 64] |= np.uint64(1) << np.uint64(k % 64)
        out.append(plane)
    return out


def enough(cut: Halves, bits: np.ndarray, least: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Halves at which passages begin, and items of whose words they hold at least as many as asked (least: planes)."""
    planes = [np.zeros((len(cut.terms), bits.shape[1]), np.uint64) for _ in range(4)]
    for j in range(STEP):
        carry = bits[cut.terms[:, j]]
        for p in planes:
            both = p & carry
            p ^= carry
            carry = both
    here = np.flatnonzero(cut.begins)
    there = cut.follower(here)
    sums, carry = [], np.zeros((len(here), bits.shape[1]), np.uint64)
    for p in planes:
        a, b = p[here], p[there]
        half = a ^ b
        sums.append(half ^ carry)
        carry = (a & b) | (half & carry)
    more, same = np.zeros_like(carry), np.full_like(carry, ~np.uint64(0))
    for p, asked in zip([carry, *sums[::-1]], least[::-1], strict=True):
        more |= same & p & ~asked
        same &= ~(p ^ asked)
    passed = more | same
    some = np.flatnonzero(passed.any(1))
    row, item = np.nonzero(np.unpackbits(passed[some].view(np.uint8), axis=1, bitorder="little"))
    return here[some[row]], item


def decompose(z: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """Right singular vectors (terms by rank, or fewer where there are no more directions) from z = A'A omega."""
    core = omega.T @ z
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    kept = values > 1e-6 * max(values.max(initial=0), 1e-9)
    if not kept.any():
        return np.zeros((len(z), 1), np.float32)
    return np.linalg.svd(z @ (vectors[:, kept] / np.sqrt(values[kept])), full_matrices=False)[0].astype(np.float32)


def common_run(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    place: dict[int, int] = {}
    for k, x in enumerate(item.tolist()):
        place[x] = place.get(x, 0) | 1 << k
    full = (1 << len(item)) - 1
    v = full
    for x in text.tolist():
        m = place.get(x)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def judge(item: Item, text: np.ndarray) -> tuple[int, str] | None:
    """Words in common order and the kind of match, or None."""
    n = len(item.ids)
    lcs = common_run(item.ids, text)
    if lcs == n:
        return lcs, "whole"
    if lcs >= STRONG * n:
        return lcs, "near"
    if lcs >= WEAK * n and common_run(item.answer, text) >= ANSWER * len(item.answer):
        return lcs, "paraphrase"
    return None


class _Code(dict):
    """Number of a word as it stands between blanks; -1 where nothing is left of it, 0 where no item has it."""

    def __init__(self, number: dict[str, int]):
        super().__init__(number)
        self.number = number

    def __missing__(self, raw: str) -> int:
        if raw.isalnum():  # no marks around it, and not among the items' words
            return 0
        w = EDGES.sub("", raw)
        n = self.number.get(w, 0) if w else -1
        if len(self) < WORDS_KEPT:
            self[raw] = n
        return n


def _encoded(number: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _Code(number)
        for whole in batches:
            for i in range(0, len(whole), 500):
                batch = whole.slice(i, 500)
                seqs = []
                for text in batch["text"].to_pylist():
                    ws = (text or "").lower().split()
                    x = np.fromiter(map(code.__getitem__, ws), np.int32, len(ws))
                    seqs.append(x[x >= 0].tobytes())
                yield pa.record_batch([batch["doc_id"], pa.array(seqs, pa.binary())], names=["doc_id", "seq"])

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    docs, seqs, n = [], [], 0
    for batch in batches:
        for doc, seq in zip(batch["doc_id"].to_pylist(), batch["seq"].to_pylist(), strict=True):
            x = np.frombuffer(seq, np.int32)
            docs.append(doc)
            seqs.append(x)
            n += len(x)
            if n >= BATCH_WORDS:
                yield docs, seqs
                docs, seqs, n = [], [], 0
    if docs:
        yield docs, seqs


def overlap(cut: Halves, half: np.ndarray, item: Item, place: np.ndarray) -> np.ndarray:
    """How many of the item's words the text around each passage holds, each as often as the item has it: the longest common subsequence is never longer. place: zeros for all words."""
    terms, have = np.unique(item.ids, return_counts=True)
    place[terms] = np.arange(1, len(terms) + 1)
    flat, text, n = cut.terms.reshape(-1), cut.text_of(half), len(item.ids)
    out, wide = np.empty(len(half), np.int64), len(terms) + 1
    for i in range(0, len(half), REGIONS):
        part = slice(i, i + REGIONS)
        spot = half[part, None] * STEP + np.arange(-n, 2 * STEP + n)
        inside = (spot >= cut.first[text[part], None] * STEP) & (spot < cut.first[text[part] + 1, None] * STEP)
        found = np.where(inside, place[flat[np.clip(spot, 0, len(flat) - 1)]], 0)
        count = np.bincount((found + np.arange(len(found))[:, None] * wide).reshape(-1), minlength=len(found) * wide).reshape(-1, wide)[:, 1:]
        out[part] = np.minimum(count, have).sum(1)
    place[terms] = 0
    return out


def _frequencies(size: int):
    """In how many texts each word is; under 0 the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for _, seqs in _grouped(batches):
            for s in seqs:
                df[np.flatnonzero(np.bincount(s, minlength=1))] += 1
            df[0] += sum(not (s == 0).any() for s in seqs)
        yield pa.record_batch([pa.array(np.arange(size)), pa.array(df)], names=["term", "n"])

    return run


def _multiplied(idf: np.ndarray, omega: np.ndarray):
    """This task's share of A'A omega, by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = np.zeros(omega.shape)
        ready = (omega * idf[:, None]).astype(np.float32)
        for _, seqs in _grouped(batches):
            cut = Halves.of(seqs)
            y = projected(cut.terms, ready)
            here = np.flatnonzero(cut.begins)
            there = cut.follower(here)
            of_passage = y[here] + y[there]
            # Each half lies in the passage that begins there and in the one before, within its text.
            back = np.zeros_like(y)
            back[here] = of_passage
            back[there] += of_passage  # the row of zeros has no words
            flat = cut.terms.reshape(-1)
            at = np.flatnonzero(flat)
            term = flat[at].astype(np.uint16 if len(idf) <= 1 << 16 else np.int32)
            order = np.argsort(term, kind="stable")
            at, term = at[order] // STEP, term[order]
            edges = np.flatnonzero(np.r_[True, term[1:] != term[:-1], True]) if len(at) else np.empty(0, np.int64)
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                z[term[i]] += back[at[i:j]].sum(0) * idf[term[i]]
        used = np.flatnonzero(z.any(1))
        yield pa.record_batch([pa.array(used), pa.array([x.tobytes() for x in z[used]], pa.binary())], names=["term", "z"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of rows of one term, of those sorted by term."""
    term, total = None, None
    out: list[tuple[int, bytes]] = []
    for batch in batches:
        for t, z in zip(batch["term"].to_pylist(), batch["z"].to_pylist(), strict=True):
            x = np.frombuffer(z)
            if t == term:
                total = total + x
            else:
                if term is not None:
                    out.append((term, total.tobytes()))
                term, total = t, x
    if term is not None:
        out.append((term, total.tobytes()))
    yield pa.record_batch([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], names=["term", "z"])


FOUND = ["doc_id", "item", "kind", "words_found", "item_words", "from_word", "to_word", "cosine"]


def _searched(items: list[Item], idf: np.ndarray, basis: np.ndarray, cosine: float):
    """Verified matches of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = (basis * idf[:, None]).astype(np.float32)
        unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

        def vectors(cut: Halves, here: np.ndarray) -> np.ndarray:
            return unit(projected(cut.terms[here], ready) + projected(cut.terms[cut.follower(here)], ready))

        asked = Halves.of([x.ids.astype(np.int32) for x in items])
        begin = np.flatnonzero(asked.begins)
        q, owner = vectors(asked, begin), asked.text_of(begin)
        of_item = np.searchsorted(owner, np.arange(len(items) + 1))
        bits, least = item_bits(items, len(idf)), _bit_planes(np.array([-int(-WEAK * min(len(x.ids), STEP) // 1) for x in items]), -(-len(items) // 64))
        place = np.zeros(len(idf), np.int64)
        for kind, groups in _kinds(batches):
            for docs, seqs in groups:
                cut = Halves.of(seqs)
                half, item = enough(cut, bits, least)
                best: dict[tuple[int, int], tuple] = {}
                order = np.argsort(item, kind="stable")
                edges = np.searchsorted(item[order], np.arange(len(items) + 1))
                for k in np.flatnonzero(np.diff(edges)).tolist():
                    mine, n = half[order[edges[k] : edges[k + 1]]], len(items[k].ids)
                    mine = mine[overlap(cut, mine, items[k], place) >= WEAK * n]
                    cos = (vectors(cut, mine) @ q[of_item[k] : of_item[k + 1]].T).max(1) if len(mine) else mine
                    near = np.flatnonzero(cos >= cosine)
                    for x, begins, c in zip(cut.text_of(mine[near]).tolist(), mine[near].tolist(), cos[near].tolist(), strict=True):
                        word, seq = (begins - int(cut.first[x])) * STEP, seqs[x]
                        lo, hi = max(0, word - n), min(len(seq), word + 2 * STEP + n)
                        got = judge(items[k], seq[lo:hi])
                        if got and got[0] > best.get((x, k), (0,))[0]:
                            best[x, k] = (got[0], got[1], lo, hi, c)
                out = [(docs[x], n, how, words_found, len(items[n].ids), lo, hi, cos) for (x, n), (words_found, how, lo, hi, cos) in best.items()]
                cols = list(zip(*out, strict=True)) if out else [()] * len(FOUND)
                types = (kind, pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.record_batch([pa.array(v, t) for v, t in zip(cols, types, strict=True)], names=FOUND)

    return run


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.DataType, Iterator]]:
    """The batches' groups, once the type of the id is known."""
    first = next(batches, None)
    if first is not None:

        def again() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        yield first["doc_id"].type, _grouped(again())


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", cosine: float = COSINE, rank: int = RANK) -> DataFrame:
    """doc_id, item_id, kind, words_found, item_words, from_word, to_word (where it was looked for), cosine: a row for every text and item it contains."""
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    named = benchmark.select(F.col(f"`{item_id}`").alias("item_id"), F.xxhash64(F.col(f"`{text}`")).alias("key"), F.col(f"`{text}`").alias("text")).filter("text IS NOT NULL")
    distinct = written(named.select("key", "text").dropDuplicates(["key"]), "items")
    total = distinct.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    blocks = max(1, -(-total["n"] // ITEMS), -(-total["b"] // ITEM_BYTES))
    shape = "kind string, words_found long, item_words long, from_word long, to_word long, cosine double"
    found = spark.createDataFrame([], f"doc_id {kind}, key long, {shape}")
    for block in range(blocks):
        items, number = read_items(distinct.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block).collect())
        if not items:
            continue
        size = len(number) + 1
        coded = written(docs.mapInArrow(_encoded(number), f"doc_id {kind}, seq binary"), "coded")
        df = np.zeros(size)
        for r in coded.mapInArrow(_frequencies(size), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
            df[r["term"]] = r["n"]
        idf = np.log((df[0] + 1) / (df + 1)) + 1e-3
        idf[0] = 0
        omega = np.random.default_rng(SEED).standard_normal((size, min(rank, size)))
        omega[0] = 0
        shares = coded.mapInArrow(_multiplied(idf, omega), "term long, z binary").repartition("term").sortWithinPartitions("term")
        z = np.zeros(omega.shape)
        got = shares.mapInArrow(_added, "term long, z binary").toArrow()
        for t, x in zip(got["term"].to_pylist(), got["z"].to_pylist(), strict=True):
            z[t] = np.frombuffer(x)
        basis = decompose(z, omega)
        hits = coded.mapInArrow(_searched(items, idf, basis, cosine), f"doc_id {kind}, item int, {shape}")
        keys = spark.createDataFrame([(k, x.key) for k, x in enumerate(items)], "item int, key long")  # at most ITEMS rows
        found = found.unionByName(hits.join(F.broadcast(keys), "item").select("doc_id", "key", *FOUND[2:]))
    return found.join(named.select("item_id", "key"), "key").select("doc_id", "item_id", *FOUND[2:])


def drop_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows in which no item was found, with their own columns; rows are told apart by number, whatever their ids."""
    rows, row = numbered(docs)
    gone = written(leaks(rows.select(F.col(row).alias(doc_id), F.col(f"`{text}`")), benchmark, doc_id, text).select(F.col(f"`{doc_id}`").alias(row)).distinct(), "leaks")
    return rows.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
