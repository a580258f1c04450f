"""Exact k-means in which clusters are balls: only what can change hands is compared, and only with centroids near enough.

A cluster is a ball: a centroid and a radius that holds its members. Another centroid can only win a member if half its
distance to the ball's own centroid is within the radius; those are the ball's neighbours. Members nearer to their centroid
than half the way to the nearest neighbour are the stable core and stay uncompared; the others lie in annuli,
bounded by the half distances to the first, second, ... neighbour, and a member of annulus m is compared exactly with
the first m neighbours only. Results are those of plain k-means, ties included.

Vectors are integers and all sums and distances are exact, so results depend neither on partitions nor on the
order of rows. Each round is one pass in tasks over the written vectors, whose assignments travel with them to the
next round's table, and one aggregation to k rows of sums and radii; only those and the centroids reach the driver. A radius around a
moved centroid is bounded by the old radius plus the way that it moved.

Defined cases: a vector that is null, has another number of components or a null or non-finite one is left out; a null id counts
as empty text where ids are hashed, equal ids are ordered by their vectors; repeated rows are vectors of their own;
fewer vectors than ``k`` give as many centroids; equal centroids are numbered apart and the smaller number wins; an empty table gives
no rows; columns other than the id and the vector are not read. Components beyond 2^26 after scaling fail with a message,
since squared distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

LARGEST = 1 << 26  # 64 squared differences of such components fit a long
BLOCK = 1 << 12  # vectors compared at once where nothing is known of them


def scaled(vector: Column, size: int, scale: float) -> Column:
    """The vector as whole numbers, or null if it is not kept."""
    plain = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(plain, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(plain, lambda x: F.floor(F.lit(float(scale)) * x))
    held = F.forall(whole, lambda x: F.abs(x) <= LARGEST)
    whole = F.when(held, whole.cast("array<int>")).otherwise(F.raise_error(F.lit(f"vectors hold components beyond {LARGEST} after scaling")))
    return F.when((F.size(vector) == size) & F.coalesce(sound, F.lit(False)), whole)


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the least hashes of seed and id."""
    order = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    got = vectors.select(order.alias("h"), "v").orderBy("h", "v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in got], np.int64)


def square(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """cluster and squared distance of each vector, from all centroids."""
    cluster, best = np.zeros(len(x), np.int32), square(x, centroids[0])
    for j in range(1, len(centroids)):
        d = square(x, centroids[j])
        better = d < best
        cluster[better], best[better] = j, d[better]
    return cluster, best


def neighbours(centroids: np.ndarray, radii: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each ball its neighbours by rising distance, and their squared distances."""
    out = []
    for i, r in enumerate(radii):
        d = square(centroids, centroids[i])
        near = np.flatnonzero(d <= 4 * r * r)
        near = near[near != i]
        near = near[np.argsort(d[near], kind="stable")]
        out.append((near, d[near]))
    return out


def changed_hands(x: np.ndarray, was: np.ndarray, centroids: np.ndarray, near: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """cluster and squared distance of vectors that were in the clusters ``was``."""
    cluster, best = was.copy(), square(x, centroids[was])
    order = np.argsort(was, kind="stable")
    ends = np.searchsorted(was[order], np.arange(len(centroids) + 1))
    for i, (ids, apart) in enumerate(near):
        members = order[ends[i] : ends[i + 1]]
        if not len(members) or not len(ids):
            continue
        # The annulus of a member: how many neighbours are within twice its distance.
        annulus = np.searchsorted(apart, 4 * best[members], side="right")
        for m, j in enumerate(ids):
            inside = members[annulus > m]
            if not len(inside):
                break
            d = square(x[inside], centroids[j])
            wins = (d < best[inside]) | ((d == best[inside]) & (j < cluster[inside]))
            cluster[inside[wins]], best[inside[wins]] = j, d[wins]
    return cluster, best


def _assigned(centroids: np.ndarray, near: list[tuple[np.ndarray, np.ndarray]] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                x = batch["v"].flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, -1)
                cluster, d = nearest(x, centroids) if near is None else changed_hands(x, batch["cluster"].to_numpy(), centroids, near)
                yield pa.record_batch([batch["vec_id"], batch["v"], pa.array(cluster, pa.int32()), pa.array(d, pa.int64())], names=["vec_id", "v", "cluster", "distance"])

    return run


def moved(assigned: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The means of the clusters, rounded down, and for each a radius that holds the cluster around it."""
    sums = [F.sum(F.get("v", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(centroids.shape[1])]
    out, radii = centroids.copy(), [0] * len(centroids)
    for r in assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("r"), *sums).collect():  # k rows
        j = r["cluster"]
        out[j] = [r[f"s{i}"] // r["n"] for i in range(centroids.shape[1])]
        radii[j] = isqrt(r["r"]) + isqrt(int(square(out[[j]], centroids[j])[0])) + 2
    return out, radii


def ball_kmeans(
    vectors: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2:", size: int = 64, scale: float = 256, vec_id: str = "vec_id", vector: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """vec_id, v (whole numbers), cluster, distance (squared) of every kept vector, and the centroids they belong to."""
    kept = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), scaled(F.col(f"`{vector}`"), size, scale).alias("v")).filter("v IS NOT NULL")
    now = written(kept, "vectors")
    kind = now.schema["vec_id"].dataType.simpleString()
    centroids = first_centroids(now, k, seed)
    if not len(centroids):
        return now.withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long")}), centroids
    near = None
    for step in range(rounds + 1):
        before = now
        now = written(before.mapInArrow(_assigned(centroids, near), f"vec_id {kind}, v array<int>, cluster int, distance long"), "assigned")
        drop_written(before)
        if step < rounds:
            centroids, radii = moved(now, centroids)
            near = neighbours(centroids, radii)
    return now, centroids


def clusters(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of what ball_kmeans returns."""
    spark = assigned.sparkSession
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    total = sum(sums.values())
    rows = [(j, s, total, hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j, s in sums.items()]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    return assigned.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 40, rounds: int = 5, seed: str = "2:", size: int = 64, scale: int = 256) -> str:
    """The same by comparing every vector with every centroid."""
    parts = [
        f"""
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = {size}
), x AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept
), firsts AS (SELECT v, row_number() OVER (ORDER BY sha256('{seed}' || vec_id), v) - 1 AS j FROM kept
), c0 AS MATERIALIZED (SELECT j, unnest(v) AS c, generate_subscripts(v, 1) AS i FROM firsts WHERE j < {k})"""
    ]
    for n in range(rounds + 1):
        parts.append(f"""
, d{n} AS (SELECT r, j, sum((x - c) * (x - c)) AS d FROM x JOIN c{n} USING (i) GROUP BY r, j
), a{n} AS MATERIALIZED (SELECT r, CAST(min(d) AS BIGINT) AS d, arg_min(j, {{'d': d, 'j': j}}) AS j FROM d{n} GROUP BY r)""")
        if n < rounds:
            parts.append(f"""
, m{n} AS (SELECT j, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{n} JOIN x USING (r) GROUP BY j, i
), c{n + 1} AS MATERIALIZED (SELECT j, i, coalesce((s - ((s % n) + n) % n) // n, c) AS c FROM c{n} LEFT JOIN m{n} USING (j, i))""")
    parts.append(f"""
, told AS (SELECT j, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY j)
SELECT vec_id, CAST(j AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN told USING (j)
""")
    return "".join(parts)
