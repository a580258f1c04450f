"""A hidden Markov language model over words, trained by Baum-Welch and scored by the exact scaled forward recursion.

Tokens are words with A-Z lowered, then one end. The first rounds of Baum-Welch run over classes of tokens: the ``OWN`` commonest
tokens have one each, the others share ``SHARED`` classes by their last bytes. The last round counts the expected visits of
each state for every token of the training texts, in a table that grows with the corpus; P(token | state) comes from these counts,
where a token of few occurrences leans on its class (``lean``). Each occurrence is shared out to the states in whole parts of 1 / ``GRAIN``,
so that sums of visits are whole numbers and depend neither on partitions nor on their order; they travel as digits of 16 bits. Every shared class has one place for tokens never seen.

Counts of all training tokens are summed over the partitions; the ``TOP`` commonest (a stated bound) are known to every
task, the others' counts and visits are joined by token. Each round of Baum-Welch is one pass over all training texts;
tasks add up their expected counts, which are summed by class, the last time by token. Texts are processed whole, many side by side.

Defined cases: null, empty and blank texts consist of the end alone; rows are scored one by one, also repeated ones and those without an
id (whose fold is that of the empty text); without training texts every token has count 0; very long texts are scored whole;
of equally common tokens the lesser in bytes counts as commoner; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, id_fold, written

STATES, ROUNDS = 8, 3
OWN, SHARED, TAIL = 2_000, 1_024, 3
TOP, LONGEST = 200_000, 64
HELD_COUNTS = 400_000  # tokens counted in a task before they are passed on
HELD_VISITS = 100_000  # the same with visits of states
GRAIN = 4_095  # parts that an occurrence is shared out in
LEAN = 5.0  # occurrences that a token's class counts for in its states
BATCH_TOKENS, GATHER_TOKENS = 600_000, 3_000_000
END = b""


def _tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: Counter[bytes] = Counter()

    def out() -> Iterator[pa.RecordBatch]:
        keys, values = list(n), list(n.values())
        for i in range(0, len(keys), 20_000):
            yield pa.record_batch([pa.array(keys[i : i + 20_000], pa.binary()), pa.array(values[i : i + 20_000], pa.int64())], names=["token", "n"])
        n.clear()

    for batch in batches:
        for text in batch["text"].to_pylist():
            n.update(_tokens(text))
            if len(n) >= HELD_COUNTS:
                yield from out()
    yield from out()


class Classes:
    """Class of each token, and what the commonest tokens' counts and classes are."""

    def __init__(self, top: list[tuple[bytes, int]]):
        self.count = dict(top)
        self.own = {t: SHARED + k for k, (t, _) in enumerate(top[:OWN])}
        self.size = SHARED + len(self.own)

    def of(self, token: bytes) -> int:
        return self.own[token] if token in self.own else zlib.crc32(token[-TAIL:]) % SHARED


def shared_class(token: Column) -> Column:
    """The class of a token that has none of its own, as Classes.of has it."""
    return F.crc32(F.substring(token, -TAIL, TAIL)) % SHARED


class _Code(dict):
    """Class of any token; those met besides the commonest are remembered up to a bound."""

    def __missing__(self, token: bytes) -> int:
        k = zlib.crc32(token[-TAIL:]) % SHARED
        if len(self) < 2 * TOP:
            self[token] = k
        return k


class Lookup:
    """The commonest tokens as bytes that travel; a worker unpacks them once, however many tasks it runs."""

    ready: tuple[str, dict[bytes, int], _Code] | None = None

    def __init__(self, classes: Classes):
        tokens = list(classes.count)
        self.name, self.n = uuid.uuid4().hex, len(tokens)
        self.tokens = zstandard.compress(b" ".join(tokens), 3)  # tokens have no blanks; the end is the empty one
        self.kinds = np.array([classes.of(t) for t in tokens], np.int16)

    def read(self) -> tuple[dict[bytes, int], _Code]:
        """token -> its place among the commonest, and the classes."""
        if not Lookup.ready or Lookup.ready[0] != self.name:
            Lookup.ready = None
            tokens = zstandard.decompress(self.tokens).split(b" ") if self.n else []
            Lookup.ready = (self.name, {t: k for k, t in enumerate(tokens)}, _Code(zip(tokens, self.kinds.tolist(), strict=True)))
        return Lookup.ready[1:]


def _placed(lookup: Lookup):
    """Of every text: classes, places of its tokens among the commonest (below 0: in the list of its other tokens) and that list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, codes = lookup.read()
        squeeze = zstandard.ZstdCompressor(1)
        for whole in batches:
            for i in range(0, len(whole), 500):
                batch = whole.slice(i, 500)
                docs: list[list] = [[] for _ in range(3)]
                for text in batch["text"].to_pylist():
                    tokens, other = _tokens(text), {}
                    at = np.fromiter((known[t] if t in known else ~other.setdefault(t, len(other)) for t in tokens), np.int32, len(tokens))
                    for c, value in zip(docs, (np.fromiter(map(codes.__getitem__, tokens), np.int16, len(tokens)).tobytes(), squeeze.compress(at.tobytes()), list(other)), strict=True):
                        c.append(value)
                yield pa.record_batch([batch["row"], batch["doc_id"], batch["held_out"], pa.array(docs[0], pa.binary()), pa.array(docs[1], pa.binary()), pa.array(docs[2], pa.list_(pa.binary()))], names=["row", "doc_id", "held_out", "seq", "at", "other"])

    return run


def _places(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int32).astype(np.int64)


class Model:
    """Start (S), moves (S, S) and emissions of classes (C, S)."""

    def __init__(self, start: np.ndarray, moves: np.ndarray, emit: np.ndarray):
        self.start, self.moves, self.emit = start, moves, emit

    @classmethod
    def from_counts(cls, start: np.ndarray, moves: np.ndarray, emit: np.ndarray, prior: np.ndarray, weight: float = 100.0) -> Model:
        s, m, e = start + 1, moves + 1, emit + weight * prior[:, None]
        return cls(s / s.sum(), m / m.sum(1, keepdims=True), e / e.sum(0))


class _Side:
    """Sequences side by side: time-major, the longest first, so that those still running are always a leading part."""

    def __init__(self, seqs: list[np.ndarray]):
        length = np.array([len(s) for s in seqs])
        self.order = np.argsort(-length, kind="stable")
        length = length[self.order]
        self.alive = np.searchsorted(-length, -np.arange(length[0]), "left")  # sequences longer than t
        self.at = np.r_[0, np.cumsum(self.alive)]
        self.obs = self.laid(seqs)

    def laid(self, seqs: list[np.ndarray]) -> np.ndarray:
        """Values of the sequences' places in the order of this batch."""
        out = np.empty(self.at[-1], np.int64)
        for k, s in enumerate(self.order):
            out[self.at[: len(seqs[s])] + k] = seqs[s]
        return out

    def forward(self, m: Model, keep: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
        """Natural log likelihoods in the order given; scaled forward variables and scales if kept."""
        d = self.alive[0]
        log = np.zeros(d)
        alpha = np.empty((len(self.obs), len(m.start))) if keep else None
        scale = np.empty(len(self.obs)) if keep else None
        now = None
        for t, n in enumerate(self.alive):
            i = self.at[t]
            now = (m.start if now is None else now[:n] @ m.moves) * m.emit[self.obs[i : i + n]]
            c = now.sum(1)
            now = now / c[:, None]
            log[:n] += np.log(c)
            if keep:
                alpha[i : i + n], scale[i : i + n] = now, c
        out = np.empty(d)
        out[self.order] = log
        return out, alpha, scale

    def expected(self, m: Model, classes: int, names: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts, moves and emissions; these by class, or by the names of the places in parts of 1 / GRAIN."""
        _, alpha, scale = self.forward(m, True)
        s = len(m.start)
        moves = np.zeros((s, s))
        beta = np.ones((self.alive[-1], s))
        gamma = alpha  # overwritten from the back
        for t in range(len(self.alive) - 2, -1, -1):
            n, k = self.alive[t], self.alive[t + 1]
            i, j = self.at[t], self.at[t + 1]
            ahead = m.emit[self.obs[j : j + k]] * beta / scale[j : j + k, None]
            moves += alpha[i : i + k].T @ ahead
            gamma[j : j + k] *= beta
            beta = np.ones((n, s)) if n > k else np.empty((n, s))
            beta[:k] = ahead @ m.moves.T
        gamma[: self.alive[0]] *= beta
        part = (lambda x: gamma[:, x]) if names is None else (lambda x: np.rint(gamma[:, x] * GRAIN))
        emit = np.stack([np.bincount(self.obs if names is None else names, part(x), classes) for x in range(s)], 1)
        return gamma[: self.alive[0]].sum(0), moves * m.moves, emit


def _gathered(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[tuple[list[dict], list[np.ndarray]]]:
    rows, seqs, n = [], [], 0
    for batch in batches:
        for i in range(0, len(batch), 500):
            some = batch.slice(i, 500)
            found = _matched(some["found"]) if "found" in some.schema.names else None
            for k, row in enumerate((some.drop_columns(["found"]) if found else some).to_pylist()):
                if found:
                    row["found"] = found[k]
                x = np.frombuffer(row.pop("seq"), np.int16) if "seq" in row else _places(row.pop("at"))
                rows.append(row)
                seqs.append(x)
                n += len(x)
                if n >= tokens:
                    yield rows, seqs
                    rows, seqs, n = [], [], 0
    if rows:
        yield rows, seqs


def _matched(lists: pa.ListArray) -> list[np.ndarray]:
    """For each row the columns i, c, k, low, high of its structs in the order of i, as one array of five rows."""
    ends = lists.offsets.to_numpy()
    flat = lists.values
    table = np.stack([flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("i", "c", "k", "low", "high")])
    out = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        part = table[:, a:b]
        out.append(part[:, np.argsort(part[0], kind="stable")])
    return out


def _batched(seqs: list[np.ndarray]) -> Iterator[list[int]]:
    """Places of sequences of like length, in batches of bounded size (or one very long sequence)."""
    part, n = [], 0
    for k in sorted(range(len(seqs)), key=lambda k: -len(seqs[k])):
        if part and n + len(seqs[k]) > BATCH_TOKENS:
            yield part
            part, n = [], 0
        part.append(k)
        n += len(seqs[k])
    if part:
        yield part


def _summed(start: np.ndarray, moves: np.ndarray, emit: np.ndarray) -> pa.RecordBatch:
    """Rows by key: classes from 0, then moves from each state, then starts."""
    keys = np.r_[np.flatnonzero(emit.any(1)), len(emit) + np.arange(len(moves)), len(emit) + len(moves)]
    rows = np.concatenate([emit[emit.any(1)], moves, start[None]])
    return pa.record_batch([pa.array(keys, pa.int64()), *[pa.array(np.ascontiguousarray(c)) for c in rows.T]], names=["key", *[f"s{k}" for k in range(len(moves))]])


def _first_guess(states: int, classes: int):
    """A text's tokens all count for one state, that of its commonest class: texts of one kind start together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, moves, emit = np.zeros(states), np.zeros((states, states)), np.zeros((classes, states))
        for _, seqs in _gathered(batches, GATHER_TOKENS):
            for x in seqs:
                n = np.bincount(x, minlength=classes)
                s = zlib.crc32(str(n[:-1].argmax() if len(x) > 1 else 0).encode()) % states
                emit[:, s] += n
                start[s] += 1
                moves[s] += 0.1 * len(x) / states
                moves[s, s] += 0.9 * len(x)
        yield _summed(start, moves, emit)

    return run


def _expected(m: Model, classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = len(m.start)
        total = [np.zeros(s), np.zeros((s, s)), np.zeros((classes, s))]
        for _, seqs in _gathered(batches, GATHER_TOKENS):
            for part in _batched(seqs):
                for a, b in zip(total, _Side([seqs[k] for k in part]).expected(m, classes), strict=True):
                    a += b
        yield _summed(*total)

    return run


def _visits(m: Model, classes: int, top: int):
    """Expected counts by token: code below ``top`` for the commonest, then moves from each state, then starts; the others by themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = len(m.start)
        start, moves, common, times = np.zeros(s), np.zeros((s, s)), np.zeros((top, s)), np.zeros(top, np.int64)
        ids: dict[bytes, int] = {}
        visits, seen = np.zeros((0, s)), np.zeros(0, np.int64)
        names = ["code", "token", "n", "digit", "low", "high", "sums"]

        def out(codes: np.ndarray | None, tokens: list | None, n: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            for digit, at, halves in packed(rows):
                count = n[at] if digit == 0 else np.zeros(len(at), np.int64)  # a token counts once
                for i in range(0, len(at), 20_000):
                    here = at[i : i + 20_000]
                    size = len(here)
                    code = pa.array(codes[here]) if codes is not None else pa.nulls(size, pa.int64())
                    token = pa.array([tokens[k] for k in here], pa.binary()) if tokens is not None else pa.nulls(size, pa.binary())
                    whole = [pa.array(count[i : i + size]), pa.array(np.full(size, digit, np.int32)), *[pa.array(h[i : i + size]) for h in halves]]
                    yield pa.record_batch([code, token, *whole, pa.nulls(size, pa.list_(pa.float64()))], names=names)

        for rows, seqs in _gathered(batches, GATHER_TOKENS):
            for part in _batched(seqs):
                tokens = []
                for k in part:
                    x = _places(rows[k]["at"])
                    if rows[k]["other"]:
                        mine = np.array([ids.setdefault(t, len(ids)) for t in rows[k]["other"]], np.int64)
                        x[x < 0] = top + mine[~x[x < 0]]
                    tokens.append(x)
                side = _Side([seqs[k] for k in part])
                used, local = np.unique(side.laid(tokens), return_inverse=True)
                a, b, e = side.expected(m, len(used), local)
                start, moves, n = start + a, moves + b, np.bincount(local, minlength=len(used))
                grown = len(ids) - len(visits)
                visits, seen = np.concatenate([visits, np.zeros((grown, s))]), np.concatenate([seen, np.zeros(grown, np.int64)])
                here = used < top
                common[used[here]] += e[here]
                times[used[here]] += n[here]
                visits[used[~here] - top] += e[~here]
                seen[used[~here] - top] += n[~here]
                if len(ids) >= HELD_VISITS:
                    yield from out(None, list(ids), seen, visits)
                    ids, visits, seen = {}, visits[:0], seen[:0]
        yield from out(None, list(ids), seen, visits)
        met = np.flatnonzero(times)
        yield from out(met, None, times[met], common[met])
        k = s + 1
        yield pa.record_batch([pa.array(np.arange(top, top + k)), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array([*moves.tolist(), start.tolist()], pa.list_(pa.float64()))], names=names)

    return run


def packed(visits: np.ndarray) -> Iterator[tuple[int, np.ndarray, tuple[np.ndarray, np.ndarray]]]:
    """Digits of base 2^16 of whole numbers, the lowest first, each with the rows that have it and the states' digits, four to a long."""
    left, at, digit = visits.astype(np.int64), np.arange(len(visits)), 0
    while len(at) or digit == 0:
        out = np.zeros((len(at), 8), np.uint16)
        out[:, : left.shape[1]] = left & 0xFFFF
        pair = out.view(np.int64)
        yield digit, at, (np.ascontiguousarray(pair[:, 0]), np.ascontiguousarray(pair[:, 1]))
        left, digit = left >> 16, digit + 1
        more = left.any(1)
        left, at = left[more], at[more]


def unpacked(low: np.ndarray, high: np.ndarray, states: int) -> np.ndarray:
    """Shares of the states from their 16 bits."""
    pair = np.ascontiguousarray(np.stack([low, high], 1), np.int64)
    return pair.view(np.uint16).reshape(-1, 8)[:, :states] / 65_535


def part(k: int) -> Column:
    """The 16 bits of state k in the columns low and high."""
    return F.shiftrightunsigned("low" if k < 4 else "high", 16 * (k % 4)).bitwiseAND(F.lit(65_535).cast("long"))


def lean(n, visits, by_class, weight: float = LEAN):
    """A token's n + 1 occurrences (one for add-one) shared out to states as its visits and ``weight`` more of its class are."""
    return (n + 1) * (visits + weight * by_class) / (n + weight)


def _scored(start: np.ndarray, moves: np.ndarray, common: np.ndarray, base: np.ndarray, by_class: np.ndarray, size: np.ndarray, total: int):
    """n_tokens, n_known, base_score and score of every text, of which ``found`` has counts, shares and classes of the tokens that are not common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, seqs in _gathered(batches, GATHER_TOKENS):
            for part in _batched(seqs):
                at, emit, bases, known = [], [common], [base], [np.ones(len(base), bool)]
                n = len(base)
                for k in part:
                    x = seqs[k].copy()
                    _, c, kind, low, high = rows[k]["found"]
                    if len(c):
                        x[x < 0] = n + ~x[x < 0]
                        visits = c[:, None] * unpacked(low, high, len(start))
                        emit.append(lean(c[:, None], visits, by_class[kind]) / size)
                        bases.append(np.log10((c + 1) / total))
                        known.append(c > 0)
                        n += len(c)
                    at.append(x)
                every, is_known = np.concatenate(bases), np.concatenate(known)
                log = _Side(at).forward(Model(start, moves, np.concatenate(emit)), False)[0] / np.log(10)
                yield pa.record_batch(
                    [
                        *[pa.array([rows[k][c] for k in part], t) for c, t in zip(("doc_id", "held_out"), (None, pa.bool_()), strict=True)],
                        pa.array([len(x) for x in at], pa.int64()), pa.array([int(is_known[x].sum()) for x in at], pa.int64()),
                        pa.array([float(every[x].sum()) for x in at]), pa.array(log),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    return run


BINS = 64  # for each doubling of a count


def commonest(counts: DataFrame, top: int) -> list[tuple[bytes, int]]:
    """At most ``top`` tokens, the commonest first: those above the bin of counts that would exceed it.

    A histogram of fixed size finds the bound, so that no more rows than these reach the driver.
    """
    short = counts.filter(F.octet_length("token") <= LONGEST).withColumn("bin", F.floor(F.log2("c") * BINS))
    least, left = None, top
    for r in sorted(short.groupBy("bin").count().collect(), key=lambda r: -r["bin"]):
        if r["count"] > left:
            break
        least, left = r["bin"], left - r["count"]
    if least is None:
        return []
    got = short.filter(F.col("bin") >= least).select("token", "c").toArrow()
    return sorted(zip(map(bytes, got["token"].to_pylist()), got["c"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))


def score_texts(
    docs: DataFrame, fold: int = 7, held: int = 2, states: int = STATES, rounds: int = ROUNDS, top: int = TOP, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) for every row; at most 8 states.

    Rows whose id's crc32 modulo ``fold`` is ``held`` are not learned from.
    """
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), (id_fold(f"`{doc_id}`", fold) == held).alias("held_out"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.filter("NOT held_out").select("text").mapInArrow(_counts, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c"))
    counts = written(counted, "counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = total["n"], total["v"]
    classes = Classes(commonest(counts, top))
    own = docs.sparkSession.createDataFrame([(bytearray(t), k) for t, k in classes.own.items()] or [(bytearray(b"-"), 0)], "token binary, own int").limit(len(classes.own))
    by_class = counts.join(F.broadcast(own), "token", "left").groupBy(F.coalesce("own", shared_class(F.col("token")).cast("int")).alias("k")).agg(F.sum("c").alias("nk"), F.count(F.lit(1)).alias("vk"))
    totals = {r["k"]: (r["nk"], r["vk"]) for r in by_class.collect()}  # at most SHARED + OWN rows
    prior = np.array([totals.get(k, (0, 0))[0] + 1.0 for k in range(classes.size)])
    prior /= prior.sum()

    rows = docs.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "held_out", "text")
    texts = written(rows.mapInArrow(_placed(Lookup(classes)), f"row long, doc_id {kind}, held_out boolean, seq binary, at binary, other array<binary>"), "classes")
    learned = texts.filter("NOT held_out")
    columns = [f"s{k}" for k in range(states)]

    def fitted(task) -> Model:
        got = learned.select("seq").mapInArrow(task, "key long, " + ", ".join(f"{c} double" for c in columns)).groupBy("key").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
        size = classes.size
        table = np.zeros((size + states + 1, states))
        table[got["key"].to_numpy()] = np.stack([got[c].to_numpy() for c in columns], 1)
        return Model.from_counts(table[-1], table[size : size + states], table[:size], prior)

    model = fitted(_first_guess(states, classes.size))
    for _ in range(rounds - 1):
        model = fitted(_expected(model, classes.size))

    # The last round, by token: the commonest on the driver (at most TOP rows), the others in a table.
    tokens = len(classes.count)
    told = written(learned.select("seq", "at", "other").mapInArrow(_visits(model, classes.size, tokens), "code long, token binary, n long, digit int, low long, high long, sums array<double>"), "visits")
    got = told.filter("sums IS NOT NULL").groupBy("code").agg(*[F.sum(F.col("sums")[k]).alias(c) for k, c in enumerate(columns)]).toArrow()
    table = np.zeros((states + 1, states))
    table[got["code"].to_numpy() - tokens] = np.stack([got[c].to_numpy() for c in columns], 1)
    start, moves = table[-1] + 1, table[:-1] + 1
    by_class = model.emit * (table[-1] + table[:-1].sum(0) + 1)  # visits of a state are starts in it and moves to it
    by_class /= by_class.sum(1, keepdims=True)

    by_token = told.filter("n IS NOT NULL").drop("sums").repartition("code", "token").groupBy("code", "token")
    whole = lambda k: F.call_function("shiftleft", part(k), F.col("digit") * 16)
    by_token = by_token.agg(F.sum("n").alias("c"), *[F.sum(whole(k)).alias(c) for k, c in enumerate(columns)])
    all_parts = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    pack = {}
    for half, of in (("low", columns[:4]), ("high", columns[4:])):
        pack[half] = F.lit(0).cast("long")
        for k, c in enumerate(of):
            pack[half] = pack[half].bitwiseOR(F.shiftleft(F.round(65_535 * F.col(c) / all_parts).cast("long"), 16 * k))
    by_token = written(by_token.select("code", "token", "c", *[v.alias(h) for h, v in pack.items()]), "tokens")
    got = by_token.filter("code IS NOT NULL").select("code", "c", "low", "high").toArrow()
    times, visits = np.zeros((tokens, 1)), np.zeros((tokens, states))
    times[got["code"].to_numpy(), 0] = got["c"].to_numpy()
    visits[got["code"].to_numpy()] = unpacked(got["low"].to_numpy(), got["high"].to_numpy(), states)
    common = lean(times, times * visits, by_class[np.array([classes.of(t) for t in classes.count], np.int64)])

    rare = by_token.filter("token IS NOT NULL").select("token", "c", "low", "high")
    kind_of = shared_class(F.col("token")).cast("int").alias("k")
    # The others' sum over tokens, from sums by class (at most SHARED rows).
    parts = [F.sum((F.col("c") + 1) * F.col("c") / (F.col("c") + LEAN) * (part(k) / 65_535)).alias(c) for k, c in enumerate(columns)]
    others = rare.groupBy(kind_of).agg(F.sum((F.col("c") + 1) / (F.col("c") + LEAN)).alias("w"), *parts).toArrow()
    rest = np.stack([others[c].to_numpy() for c in columns], 1).reshape(-1, states) + LEAN * others["w"].to_numpy()[:, None] * by_class[others["k"].to_numpy()]
    size = common.sum(0) + rest.sum(0) + by_class[:SHARED].sum(0)
    drop_written(told, counts)

    # Texts meet the counts and shares of their tokens beyond the commonest; a token never seen has the one place in its class.
    asked = texts.select("row", F.posexplode("other").alias("i", "token")).join(rare, "token", "left")
    zero = F.lit(0).cast("long")
    found = asked.select("row", F.struct("i", F.coalesce("c", zero).alias("c"), kind_of, *[F.coalesce(h, zero).alias(h) for h in ("low", "high")]).alias("f")).groupBy("row").agg(F.collect_list("f").alias("found"))
    base = np.log10((np.array(list(classes.count.values()), float) + 1) / (n + v + 1))
    task = _scored(start / start.sum(), moves / moves.sum(1, keepdims=True), common / size, base, by_class, size, n + v + 1)
    out = texts.select("row", "doc_id", "held_out", "at").join(found, "row", "left").drop("row")
    out = out.mapInArrow(task, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
