import random

import numpy as np
import pytest

from limnos.llm import components, jaccard
from limnos.llm.shingles import WordHash, shingle_set


def brute(texts, size, percent):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_components_match_brute_force(make, text_of, size, percent):
    r = random.Random(size)
    texts = []
    for g in range(12):
        base = text_of(100 + g, r.choice((3, 6, 12, 25, 60, 200))).split()
        for _ in range(r.choice((1, 2, 6, 15))):
            w = list(base)
            for _ in range(r.choice((0, 0, 1, 2, 4, 8))):
                w[r.randrange(len(w))] = f"edit{r.randrange(1000)}"
            texts.append((len(texts), " ".join(w[: r.choice((len(w), len(w), len(w) - 1))])))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_join(make(texts), size, percent).collect()}
    assert got == brute(texts, size, percent)


def test_odd_rows(odd, none):
    got = sorted((str(x.doc_id), x.n_shingles, x.component_id) for x in jaccard.jaccard_join(odd, 4, 85).collect())
    by = {g[0]: g for g in got}
    assert len(got) == 15 and by["2"][2] == 1 and by["3"][2] == 1 and by["8"][2] == 7 and by["11"][2] == 10
    assert by["4"][1:] == (0, 4) and by["5"][1:] == (0, 5) and by["6"][1:] == (0, 6)
    assert [g[2] for g in got if g[0] == "None"] == [None, None]
    assert jaccard.jaccard_join(none).count() == 0
    kept = jaccard.keep_one(odd, 4, 85)
    assert kept.dtypes == odd.dtypes
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "4", "5", "6", "None", "None", "7", "9", "10", "12"])


def test_sketch_distance_never_exceeds_the_difference():
    r = np.random.default_rng(1)
    for _ in range(200):
        x = np.unique(r.integers(0, 1 << 63, r.integers(1, 400), np.uint64))
        y = np.unique(np.r_[x[r.random(len(x)) < 0.9], r.integers(0, 1 << 63, r.integers(0, 30), np.uint64)]).astype(np.uint64)
        if len(y):
            assert jaccard.distance(jaccard.parity_sketch(x), jaccard.parity_sketch(y)) <= len(np.setxor1d(x, y))


def test_linked_sets_always_share_a_word():
    r, seen = random.Random(2), WordHash()
    for percent in (80, 85):
        bands = jaccard.Bands(percent, 1 << 20)
        for _ in range(400):
            words = [str(r.randrange(10**9)) for _ in range(r.randrange(4, 300))]
            other = [w for w in words if r.random() > 0.03]
            x, y = shingle_set(" ".join(words), 1, seen), shingle_set(" ".join(other), 1, seen)
            if len(y) and 100 * len(y) >= percent * len(x):
                assert set(jaccard.words_of_set(x, bands).tolist()) & set(jaccard.words_of_set(y, bands).tolist())


def test_components_of_chains_and_stars(spark):
    edges = [(k + 1, k) for k in range(1, 40)] + [(100, k) for k in range(101, 140)] + [(200, 200)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {k: 100 for k in range(100, 140)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_keep_one_tells_rows_apart_whatever_their_ids(make, text_of):
    a, b, c = (text_of(k, 80) for k in (1, 2, 3))
    docs = make([(1, a), (1, a), (1, b), (None, c), (None, c), (None, b), (7, None), (None, None)])
    kept = jaccard.keep_one(docs, 4, 85).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in kept) == sorted([("1", a), ("1", b), ("None", c), ("7", ""), ("None", "")])


def test_query_matches_sql(spark):
    import duckdb

    from limnos.llm import registry

    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet'")
    want = sorted(con.execute(registry.SQL["op10_ngram_jaccard"]()).fetchall())
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in registry.QUERIES["op10_ngram_jaccard"](spark, at).collect())
    assert got == want and any(d != c for d, _, c in got)
