import random
import zlib

import numpy as np

from limnos.llm import toxicity


def corpus(text_of, n=400):
    r, rows, labels = random.Random(1), [], []
    for k in range(n):
        w, bad = text_of(k, 60).split(), k % 5 == 0
        if bad:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["idiot", "moron", "zorkelt", "zorkend", "zorkila"]))
        rows.append((k, " ".join(w)))
        labels.append((k, 1, int(bad)))
    return rows, labels


def test_held_out_accuracy(spark, make, text_of):
    rows, labels = corpus(text_of)
    got = toxicity.score_toxicity(make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_held_out_labels_are_not_used(spark, make, text_of):
    rows, labels = corpus(text_of, 120)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    run = lambda x: sorted((r.doc_id, round(r.score, 9)) for r in toxicity.score_toxicity(make(rows), spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect())
    assert run(labels) == run(turned)


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, None), (2, 0, 0), (2, 0, 1), (None, 1, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        got = toxicity.score_toxicity(odd, some).collect()
        assert len(got) == 15 and all(0 <= r.score <= 1 for r in got)
        assert toxicity.score_toxicity(none, some).count() == 0


def test_label_model_finds_good_voters():
    r = np.random.default_rng(2)
    y = r.random(4_000) < 0.3
    votes = np.stack([np.where(r.random(len(y)) < a, np.where(y, 1, -1), np.where(y, -1, 1)) for a in (0.95, 0.9, 0.85, 0.55)], 1)
    votes = np.c_[votes, votes[:, 0]]  # a copy of the first
    kinds, at, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    at, known = at.ravel(), np.arange(len(y)) < 400  # labels set the share of each class
    bad, good = (np.bincount(at[known & (y == t)], minlength=len(n)).astype(float) for t in (True, False))
    m = toxicity.LabelModel(kinds, n.astype(float), bad, good)
    assert m.accuracy[0] > m.accuracy[3] and m.correlation[0, 4] > 0.9 > m.correlation[1, 3]
    told = dict(zip(map(tuple, kinds), m.posterior, strict=True))
    assert np.mean([(told[tuple(v)] > 0.5) == t for v, t in zip(votes, y, strict=True)]) > 0.9


def test_lexicon_is_not_cut(spark, make, text_of):
    """6,000 toxic words, each in three of 200 toxic texts: texts with only the last of them are found."""
    r = random.Random(5)
    words = sorted({"".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(9)) for _ in range(6_000)})
    last = [w for w in words if w[0] == "z"]
    train = [i for i in range(3_000) if zlib.crc32(str(i).encode()) % 4 != 2]
    held = [i for i in range(3_000) if zlib.crc32(str(i).encode()) % 4 == 2]
    texts = [[] for _ in range(200)]
    for k in range(3):
        order = r.sample(words, len(words))
        for n, w in enumerate(order):
            texts[(n * 3 + k) % 200].append(w)
    rows = [(train[k], " ".join(w)) for k, w in enumerate(texts)] + [(i, text_of(i, 60)) for i in train[200:800]]
    labels = [(i, 1, int(k < 200)) for k, (i, _) in enumerate(rows)]
    rows += [(i, text_of(i, 40) + " " + " ".join(r.sample(last, 6))) for i in held[:20]] + [(i, text_of(i, 60)) for i in held[20:60]]
    got = {g.doc_id: g for g in toxicity.score_toxicity(make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect() if g.held_out}
    assert [got[i].predicted for i in held[:60]] == [1] * 20 + [0] * 40


def test_counts_by_join_are_those_of_one_text(spark, make, odd):
    lexicon = spark.createDataFrame([("wzork",), ("4zork",), ("5zorke",), ("6zorkel",), ("wblurbs",), ("4nope",)], "feature string")
    got = toxicity.count_texts(make([(1, "Zork zorkel, zorkelt blurbs idiot idiot !!"), (1, "nothing")]), lexicon).orderBy("words").collect()
    c = lambda r: [r[k] for k in toxicity.COUNTS]
    assert [c(r) for r in got] == [[0] * 10 + [1], [2, 1, 0, 2, 2, 2, 2, 1, 2, 1, 6]]
    assert toxicity.count_texts(odd, lexicon).count() == 15
