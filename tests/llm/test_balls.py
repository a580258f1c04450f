import hashlib
import math
import random

import pytest

from limnos.llm import balls

KIND = "vec_id long, embedding array<float>, label int, cluster string, v int"


def brute(rows, k, rounds, size):
    """(vec_id, cluster, distance), inertia and centroids of plain k-means in whole numbers."""
    kept = []
    for r in rows:
        e = r.embedding
        if e is not None and len(e) == size and all(x is not None and math.isfinite(x) for x in e):
            kept.append((r.vec_id, [math.floor(256 * x) for x in e]))
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in start[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c)) for _, v in kept]

    for _ in range(rounds):
        got = assign()
        for j in range(len(c)):
            mine = [v for (_, v), (_, i) in zip(kept, got, strict=True) if i == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted(((i, j, d) for (i, _), (d, j) in zip(kept, assign(), strict=True)), key=str), c


def compare(df, k, rounds, size):
    got, centroids = balls.ball_kmeans(df, k=k, rounds=rounds, size=size)
    want, c = brute(df.collect(), k, rounds, size)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got.collect()), key=str) == want
    assert centroids.tolist() == c
    told = balls.clusters(got, centroids).collect()
    assert len(told) == len(want)
    for r in told:
        assert r.inertia == sum(d for _, _, d in want) and r.cluster_inertia == sum(d for _, j, d in want if j == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster])).encode()).hexdigest()


@pytest.mark.parametrize(("size", "spread", "k"), [(3, 0.02, 12), (2, 0.004, 9), (8, 1.0, 7)])
def test_matches_plain_kmeans(spark, size, spread, k):
    rnd = random.Random(size)
    middles = [[rnd.uniform(-1, 1) for _ in range(size)] for _ in range(5)]
    rows = []
    for i in range(500):
        m = middles[0] if i % 3 == 0 else rnd.choice(middles)
        rows.append((i % 450, [x + rnd.gauss(0, spread) for x in m], 1, "a", 2))
    compare(spark.createDataFrame(rows, KIND).repartition(5), k, 4, size)


def test_odd_rows(spark):
    one = [1.0, 0.5, -0.25]
    rows = [(1, one), (1, one), (2, one), (2, [2.0, 0.5, 0.0]), (None, [0.0, 0.0, 0.0]), (None, None), (3, None), (4, []), (5, [1.0, 2.0]), (6, [1.0, None, 2.0]), (7, [1.0, float("nan"), 2.0])]
    rows += [(8, [float("inf"), 0.0, 0.0]), (9, [-0.001, 0.001, 100.0]), (10, one + [1.0])]
    df = spark.createDataFrame([(*r, 1, "x", 3) for r in rows], KIND)
    for k in (1, 3, 40):
        compare(df, k, 3, 3)
    got, centroids = balls.ball_kmeans(df.limit(0), size=3)
    assert balls.clusters(got, centroids).count() == 0 and len(centroids) == 0


def test_too_large_fails(spark):
    df = spark.createDataFrame([(1, [1e9, 0.0], 1, "x", 3)], KIND)
    with pytest.raises(Exception, match="beyond"):
        balls.ball_kmeans(df, size=2)


def test_core_is_not_compared():
    import numpy as np

    rnd = np.random.default_rng(1)
    c = np.array([[0, 0], [1000, 0], [0, 1000], [5000, 5000]], np.int64)
    was = rnd.integers(0, 4, 4000).astype(np.int32)
    x = c[was] + rnd.integers(-600, 600, (4000, 2))
    radii = [int(balls.square(x[was == j], c[j]).max() ** 0.5) + 1 for j in range(4)]
    near = balls.neighbours(c, radii)
    assert [sorted(n.tolist()) for n, _ in near] == [[1, 2], [0, 2], [0, 1], []]
    cluster, d = balls.changed_hands(x, was, c, near)
    want = balls.nearest(x, c)
    assert (cluster == want[0]).all() and (d == want[1]).all()
