import itertools
import math
import zlib
from collections import Counter

import numpy as np

from limnos.llm import hmm


def model(states, classes, seed=0):
    r = np.random.default_rng(seed)
    rows = lambda n, m: (lambda x: x / x.sum(1, keepdims=True))(r.random((n, m)))
    return hmm.Model(rows(1, states)[0], rows(states, states), rows(states, classes).T)


def test_forward_and_expected_counts_match_enumeration():
    m, r = model(2, 5), np.random.default_rng(1)
    seqs = [r.integers(0, 5, k).astype(np.int16) for k in (7, 1, 3, 10, 3)]
    log, starts, moves, emit = [], np.zeros(2), np.zeros((2, 2)), np.zeros((5, 2))
    for x in seqs:
        total, paths = 0.0, []
        for z in itertools.product((0, 1), repeat=len(x)):
            p = m.start[z[0]] * m.emit[x[0], z[0]] * math.prod(m.moves[a, b] for a, b in itertools.pairwise(z)) * math.prod(m.emit[x[t], z[t]] for t in range(1, len(x)))
            total += p
            paths.append((z, p))
        log.append(math.log(total))
        for z, p in paths:
            starts[z[0]] += p / total
            for a, b in itertools.pairwise(z):
                moves[a, b] += p / total
            for o, s in zip(x, z, strict=True):
                emit[o, s] += p / total
    side = hmm._Side(seqs)
    assert np.allclose(side.forward(m, False)[0], log)
    for got, want in zip(side.expected(m, 5), (starts, moves, emit), strict=True):
        assert np.allclose(got, want)


def test_probabilities_of_all_texts_sum_to_one_at_most():
    """Over all sequences of one length the model sums to one."""
    m = model(3, 4, 2)
    seqs = [np.array(x, np.int16) for x in itertools.product(range(4), repeat=4)]
    assert np.isclose(np.exp(hmm._Side(seqs).forward(m, False)[0]).sum(), 1)


def test_baum_welch_never_lowers_the_likelihood():
    r = np.random.default_rng(3)
    seqs = [r.choice(6, size=20, p=p).astype(np.int16) for p in np.repeat([[0.4, 0.4, 0.1, 0.05, 0.03, 0.02], [0.02, 0.03, 0.05, 0.1, 0.4, 0.4]], 10, 0)]
    m, last = model(2, 6, 4), -np.inf
    for _ in range(6):
        side = hmm._Side(seqs)
        now = side.forward(m, False)[0].sum()
        assert now >= last - 1e-9
        last = now
        s, t, e = side.expected(m, 6)
        m = hmm.Model(s / s.sum(), t / t.sum(1, keepdims=True), e / e.sum(0))


def test_contract_columns(odd, none, make, text_of):
    docs = odd.unionByName(make([(100 + k, text_of(k, 80)) for k in range(40)]))
    got = hmm.score_texts(docs, rounds=2, top=50).collect()
    rows = docs.collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    c = Counter(t for r in rows if not held(r.doc_id) for t in tokens(r.text))
    n, v = sum(c.values()), len(c)
    want = sorted((str(r.doc_id), held(r.doc_id), len(tokens(r.text)), sum(c[t] > 0 for t in tokens(r.text)), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens(r.text)), 5)) for r in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert hmm.score_texts(none, rounds=1).count() == 0


def test_beats_the_unigram_on_held_out_texts(make, text_of):
    r = np.random.default_rng(5)
    kinds = ["der die das und ein nicht".split(), "the of and a to in".split()]
    docs = make([(k, " ".join(r.choice(kinds[k % 2], 60))) for k in range(300)])
    held = hmm.score_texts(docs, rounds=3).filter("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert held["sum(score)"] > held["sum(base_score)"] + 100


def test_tokens_met_by_join_score_as_those_known_to_all(make, text_of, monkeypatch):
    monkeypatch.setattr(hmm, "OWN", 20)
    docs = make([(k, text_of(k, 60) + f" seen{k % 9} once{k}") for k in range(60)])
    by_top = [{r.doc_id: r for r in hmm.score_texts(docs, rounds=2, top=top).collect()} for top in (30, 100_000)]
    assert len(by_top[0]) == 60 and any(r.n_known < r.n_tokens for r in by_top[0].values())
    for k, r in by_top[0].items():
        assert r.n_known == by_top[1][k].n_known and math.isclose(r.score, by_top[1][k].score, rel_tol=1e-6)


def test_emissions_follow_the_word_not_its_class(make, monkeypatch):
    """Words outside the classes of their own, of one ending each, are told apart by the company they keep."""
    monkeypatch.setattr(hmm, "OWN", 8)
    r = np.random.default_rng(7)
    rare = [[f"{a}{k}tion" for k in range(40)] for a in "pq"]
    text = lambda kind, x: " ".join(w for _ in range(25) for w in (("der", "the")[kind], ("der", "the")[kind], r.choice(rare[x])))
    held = [k for k in range(10_000) if zlib.crc32(str(k).encode()) % 7 == 2]
    learned = [k for k in range(10_000) if zlib.crc32(str(k).encode()) % 7 != 2]
    rows = [(k, text(k % 2, k % 2)) for k in learned[:400]] + [(held[j], text(j % 2, j % 2)) for j in range(20)] + [(held[20 + j], text(j % 2, 1 - j % 2)) for j in range(20)]
    got = {x.doc_id: x.score for x in hmm.score_texts(make(rows), rounds=3).collect()}
    assert sum(got[k] for k in held[:20]) > sum(got[k] for k in held[20:40]) + 20


def test_lean_keeps_occurrences():
    visits, share = np.array([[2.0, 1.0], [0.0, 0.0]]), np.array([[0.25, 0.75], [0.5, 0.5]])
    assert np.allclose(hmm.lean(np.array([[3], [0]]), visits, share).sum(1), [4, 1])


def test_class_expression(spark):
    words = ["a", "é", "thing", "word.", "ß", "日本", "x" * 80, ""]
    classes = hmm.Classes([])
    df = spark.createDataFrame([(bytearray(w.encode()),) for w in words], "t binary")
    assert [r.k for r in df.select(hmm.shared_class(hmm.F.col("t")).alias("k")).collect()] == [classes.of(w.encode()) for w in words]


def test_scores_do_not_depend_on_partitions(make, text_of):
    docs = make([(k, text_of(k % 70, 60) + f" seen{k % 9} once{k}") for k in range(140)])
    runs = [{r.doc_id: r.score for r in hmm.score_texts(docs.repartition(n), rounds=2, top=40).collect()} for n in (1, 4, 16)]
    assert len(runs[0]) == 140
    for other in runs[1:]:
        assert all(math.isclose(runs[0][k], v, rel_tol=1e-9, abs_tol=1e-6) for k, v in other.items())


def test_digits_of_visits():
    visits = np.array([[3.0, 70_000.0], [0.0, 65_535.0], [0.0, 5e9]])
    total = np.zeros((3, 2))
    for digit, at, (low, high) in hmm.packed(visits):
        total[at] += np.rint(hmm.unpacked(low, high, 2) * 65_535) * 65_536**digit
    assert (total == visits).all()
