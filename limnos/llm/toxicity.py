"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

1. Lexicons: a stated list of insults, and all words and stems (leading letters) that the labelled training rows mark as
   toxic, tallied over every one of those rows into a written table.
2. Voters: every whole text is counted once; its words and stems that a bit filter of fixed size lets pass are joined
   with the table; each voter says toxic (1), harmless (-1) or nothing (0) from the counts.
3. Label model: the votes of ALL rows, grouped by pattern (at most 3^voters rows), give each voter's accuracy and the correlation
   of each pair of voters within a class by expectation maximisation, with known labels held fixed: every round estimates
   both from the posteriors, and the next posteriors divide a voter's say by one plus its correlations with the others.
4. Classifier: logistic regression on the counts, trained towards the posterior labels of at most ``FIT`` rows of each
   kind of pattern (a stated bound), scores every row as a projection.

Defined cases: a null or empty text has no counts and gets the score of a harmless text; repeated rows are each
scored, and equal texts get equal scores; very long texts are counted whole; a label that is null is ignored, of differing labels of one id the toxic one counts; without any label of
either class only the stated list votes and the prior is ``PRIOR``; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bits import BITS, bit_filter, maybe, slot
from .common import id_fold, written

FIT = 20_000
HELD_COUNTS = 400_000  # features tallied, or words looked up, in a task before they are passed on or dropped
STEMS = (4, 5, 6)
PRIOR = 0.1
# Insults.
INSULTS = frozenset("idiot idiots moron morons stupid loser losers scum trash clown pathetic worthless disgusting imbecile jerk dumb fool freak vermin degenerate retard bastard bitch asshole shit fuck fucking crap garbage filth filthy cretin dimwit halfwit lowlife creep".split())
WORD = re.compile(r"[^\W\d_]+")

COUNTS = ["stated", "stated_kinds", "learned_a", "learned_b", "learned_kinds", "stem4", "stem5", "stem6", "stem_kinds", "shouts", "words"]


def _features(words: set[str]) -> set[str]:
    return {"w" + w for w in words} | {f"{k}{w[:k]}" for k in STEMS for w in words if len(w) > k}


def _squeezed(bits: np.ndarray):
    """Texts of the ids that the filter lets pass, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(1)
        for batch in batches:
            batch = batch.filter(pa.array(maybe(bits, batch["slot"].to_numpy(zero_copy_only=False))))
            yield pa.record_batch([batch["doc_id"], pa.array([squeeze.compress((t or "").encode()) for t in batch["text"].to_pylist()], pa.binary())], names=["doc_id", "z"])

    return run


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: tuple[Counter, Counter] = (Counter(), Counter())
    open_ = zstandard.ZstdDecompressor()

    def out() -> Iterator[pa.RecordBatch]:
        keys = list(n[0].keys() | n[1].keys())
        for i in range(0, len(keys), 20_000):
            part = keys[i : i + 20_000]
            yield pa.record_batch([pa.array(part, pa.string()), pa.array([n[1][k] for k in part], pa.int64()), pa.array([n[0][k] for k in part], pa.int64())], names=["feature", "bad", "good"])
        for c in n:
            c.clear()

    for batch in batches:
        for z, toxic in zip(batch["z"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
            n[toxic].update(_features(set(WORD.findall(open_.decompress(z).decode().lower()))))
            if len(n[0]) + len(n[1]) >= HELD_COUNTS:
                yield from out()
    yield from out()


def learn_lexicon(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """feature: all words ("w...") and stems ("4..." and so on) that labelled rows mark as toxic, as a written table.

    docs: doc_id, text; labels: doc_id, toxic, one row an id, a written table.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    thin = docs.select("doc_id", "text", slot("doc_id").alias("slot")).mapInArrow(_squeezed(bit_filter(labels, "doc_id")), f"doc_id {kind}, z binary")
    rows = thin.join(labels, "doc_id").select("z", "toxic")
    tally = rows.mapInArrow(_tallied, "feature string, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    n = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    lift = (F.col("bad") / max(bad, 1)) / ((F.col("good") + 0.5) / max(good, 1))
    return written(tally.filter(F.lit(bool(bad and good))).filter(F.col("bad") >= 3).filter(lift >= 12).select("feature"), "lexicon")


PLACED = ["row", "doc_id", "stated", "stated_kinds", "shouts", "words", "kind", "feature"]


def _counted(bits: np.ndarray):
    """Of every text what needs no lexicon, and a row for each feature that may be learned, with the number of its word in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[str, tuple[str, ...]] = {}

        def likely(word: str) -> tuple[str, ...]:
            if word not in met:
                if len(met) >= HELD_COUNTS:
                    met.clear()
                of = list(_features({word}))
                let = maybe(bits, np.array([zlib.crc32(f.encode()) & (BITS - 1) for f in of], np.int64))
                met[word] = tuple(f for f, ok in zip(of, let, strict=True) if ok)
            return met[word]

        for batch in batches:
            texts: list[list[int]] = [[] for _ in range(4)]
            hits: list[list] = [[] for _ in range(3)]
            for r, text in zip(batch["row"].to_pylist(), batch["text"].to_pylist(), strict=True):
                text = text or ""
                seen = WORD.findall(text.lower())
                kinds = set(seen)
                stated = kinds & INSULTS
                for column, value in zip(texts, (sum(w in stated for w in seen) if stated else 0, len(stated), text.count("!!"), len(seen)), strict=True):
                    column.append(value)
                for k, word in enumerate(kinds):
                    for f in likely(word):
                        for column, value in zip(hits, (r, k, f), strict=True):
                            column.append(value)
            n, m = len(batch), len(hits[0])
            yield pa.record_batch([batch["row"], batch["doc_id"], *[pa.array(c, pa.int64()) for c in texts], pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())], names=PLACED)
            yield pa.record_batch([pa.array(hits[0], pa.int64()), pa.nulls(m, batch["doc_id"].type), *[pa.nulls(m, pa.int64())] * 4, pa.array(hits[1], pa.int64()), pa.array(hits[2], pa.string())], names=PLACED)

    return run


def count_texts(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    bits = bit_filter(lexicon, "feature", at=F.crc32(F.col("feature").cast("binary")) % BITS)
    numbered = docs.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text")
    placed = written(numbered.mapInArrow(_counted(bits), f"row long, doc_id {kind}, stated long, stated_kinds long, shouts long, words long, kind long, feature string"), "placed")
    hits = placed.filter("feature IS NOT NULL").select("row", "kind", "feature").join(lexicon, "feature")
    first, n = F.substring("feature", 1, 1), F.length("feature") - 1
    by_kind = hits.groupBy("row", "kind").agg(F.max(F.when(first == "w", n)).alias("word"), *[F.max((first == str(k)).cast("int")).alias(f"s{k}") for k in STEMS])
    by_row = by_kind.groupBy("row").agg(
        F.count_if(F.col("word") % 2 == 1).alias("learned_a"), F.count_if(F.col("word") % 2 == 0).alias("learned_b"), F.count("word").alias("learned_kinds"),
        *[F.sum(f"s{k}").alias(f"stem{k}") for k in STEMS], F.count_if(F.greatest(*[f"s{k}" for k in STEMS]) == 1).alias("stem_kinds"),
    )
    both = placed.filter("feature IS NULL").drop("kind", "feature").join(by_row, "row", "left")
    return both.select("doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS])


def voters() -> list[tuple[str, Column]]:
    """Name and vote of each voter over a row of counts."""
    c = F.col
    yes = lambda when: F.when(when, 1).otherwise(0)
    hits = c("stated_kinds") + c("learned_kinds") + c("stem_kinds")
    return [
        ("an insult", yes(c("stated") >= 1)),
        ("insults of two kinds", yes(c("stated_kinds") >= 2)),
        ("learned word, odd length", yes(c("learned_a") >= 1)),
        ("learned word, even length", yes(c("learned_b") >= 1)),
        ("two learned words", yes(c("learned_kinds") >= 2)),
        ("two words with a short stem", yes(c("stem4") >= 2)),
        ("two words with a middle stem", yes(c("stem5") >= 2)),
        ("two words with a long stem", yes(c("stem6") >= 2)),
        ("dense", yes((hits >= 2) & (hits * 100 >= c("words")))),
        ("shouting", yes(c("shouts") >= 3)),
        ("nothing found", F.when(hits == 0, -1).otherwise(0)),
        ("one word in a long text", F.when((hits <= 1) & (c("words") >= 50), -1).otherwise(0)),
    ]


class LabelModel:
    """P(vote | class) of each voter, how voters of a class go together, and the posterior of a pattern of votes."""

    def __init__(self, votes: np.ndarray, n: np.ndarray, bad: np.ndarray, good: np.ndarray, rounds: int = 60):
        hot = votes[:, :, None] == np.array([-1, 0, 1])  # pattern, voter, vote
        open_ = np.maximum(n - bad - good, 0)
        known = bad.sum() + good.sum()
        start = 1 / (1 + np.exp(-(votes.sum(1) - 1.0)))
        post = start if not known else (bad + 2 * start) / (bad + good + 2)
        prior = PRIOR if not (bad.sum() and good.sum()) else bad.sum() / known
        for _ in range(rounds):
            w1, w0 = bad + open_ * post, good + open_ * (1 - post)
            self.table = np.stack([((w[:, None, None] * hot).sum(0) + 0.5) / (w.sum() + 1.5) for w in (w0, w1)])  # class, voter, vote
            self.correlation = np.maximum(self._correlation(votes, w0), self._correlation(votes, w1))
            self.share = 1 / (1 + self.correlation.sum(1))
            last, post = post, self._posterior(hot, prior, self.share)
            if np.abs(post - last).max() < 1e-9:
                break
        self.accuracy = self.table[1, :, 2] / (self.table[0, :, 2] + self.table[1, :, 2])
        self.prior = prior
        self.posterior = post

    @staticmethod
    def _correlation(votes: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Absolute correlation of each pair of voters over patterns of these weights."""
        d = votes - (w[:, None] * votes).sum(0) / max(w.sum(), 1e-9)
        cov = (d * w[:, None]).T @ d / max(w.sum(), 1e-9)
        s = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        out = np.abs(cov / np.outer(s, s)) * (np.diag(cov) > 1e-6)
        np.fill_diagonal(out, 0)
        return out

    def _posterior(self, hot: np.ndarray, prior: float, share: np.ndarray) -> np.ndarray:
        log = ((np.log(self.table[1]) - np.log(self.table[0]))[None] * hot).sum(2) @ share + np.log(prior / (1 - prior))
        return 1 / (1 + np.exp(-np.clip(log, -30, 30)))


def inputs() -> list[Column]:
    """What the classifier sees of a row of counts."""
    c = F.col
    hits = c("stated_kinds") + c("learned_kinds") + c("stem_kinds")
    logs = [F.log1p(c(k).cast("double")) for k in COUNTS[:-2]]
    return [*logs, (hits >= 1).cast("double"), (hits >= 2).cast("double"), (hits >= 3).cast("double"), F.least(hits / (c("words") + 1) * 20, F.lit(2.0)), F.log1p(c("words").cast("double")) / 10, F.lit(1.0)]


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression towards soft labels, by Newton's method."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (w * (p - y)) / w.sum() + ridge * b / 10
        h = (x * (w * (p * (1 - p) + 1e-6))[:, None]).T @ x / w.sum() + ridge / 10 * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b = b - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-7:
            break
    return b


def score_toxicity(docs: DataFrame, labels: DataFrame, fold: int = 4, held: int = 2, doc_id: str = "doc_id", text: str = "text", fit: int = FIT, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, posterior of the label model, for every row.

    Labels of ids whose crc32 modulo ``fold`` is ``held`` are never used.
    """
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(id_fold("doc_id", fold) != held).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = written(known, "labelled")
    counts = written(count_texts(docs, learn_lexicon(docs, known)), "counts")
    votes = voters()
    voted = counts.select("*", F.concat_ws(",", *[v for _, v in votes]).alias("votes"))
    patterns = (
        voted.join(known, "doc_id", "left").groupBy("votes").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good")).orderBy("votes").collect()
    )
    if not patterns:
        return counts.select("doc_id", (id_fold("doc_id", fold) == held).alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(0.0).alias("posterior"))
    v = np.array([[int(x) for x in p["votes"].split(",")] for p in patterns])
    n, bad, good = (np.array([p[k] for p in patterns], float) for k in ("n", "bad", "good"))
    model = LabelModel(v, n, bad, good)
    said = dict(zip([p["votes"] for p in patterns], model.posterior.tolist(), strict=True))
    # Rows for the classifier: as many of each pattern, about nine tenths of `fit` in all, each standing for the rows of its pattern.
    each = 0.9 * fit / len(patterns)
    share = {p["votes"]: min(1.0, each / p["n"]) for p in patterns}
    # At most 3^12 rows, however large the table.
    told = docs.sparkSession.createDataFrame([(p, float(said[p]), float(share[p])) for p in said], "votes string, posterior double, share double")
    voted = voted.join(F.broadcast(told), "votes")
    spread = F.pmod(F.xxhash64("doc_id", "words"), F.lit(1 << 20)) / float(1 << 20)
    rows = voted.filter(spread <= F.col("share")).orderBy(F.xxhash64("doc_id", "words"), "doc_id").limit(fit).select("votes", F.array(*inputs()).alias("x")).toArrow()
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, len(inputs()))
    used = rows["votes"].to_pylist()
    if len(used):
        b = logistic(x, np.array([said[u] for u in used]), np.array([1 / share[u] for u in used]))
    else:
        b = np.array([0.0] * (len(inputs()) - 1) + [float(np.log(model.prior / (1 - model.prior)))])
    line = sum((c * float(k) for c, k in zip(inputs(), b, strict=True)), F.lit(0.0))
    score = 1 / (1 + F.exp(-line))
    out = voted.select("doc_id", (id_fold("doc_id", fold) == held).alias("held_out"), score.alias("score"), "posterior")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "posterior")
