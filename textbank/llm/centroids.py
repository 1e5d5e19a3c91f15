"""Centroid clustering of vectors in exact integer arithmetic.

Each round is one pass over the vectors: tasks assign theirs and keep one sum a
centroid, Spark adds the sums up, and the driver, which holds the centroids only
(their number is a parameter), divides. The nearest centroid is found by
Orchard's search: every centroid has the list of the others by distance; a
vector walks the list of the closest centroid found so far, jumps to another
list as soon as that centroid is closer, never measures a centroid twice, and
stops where the list is strictly farther than twice the current distance, since
nothing behind can be as close (at just twice, a tie still can).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textbank.llm.common import cut

SCALE = 1024


def largest(dim: int) -> int:
    """Components up to this size keep squared distances within 64 bits."""
    return math.isqrt(((1 << 63) - 4) // max(dim, 1)) // 2


def to_integers(x: np.ndarray, dim: int) -> np.ndarray:
    """floor(SCALE * x) for rows of doubles; an error if a squared distance might not fit a long."""
    with np.errstate(over="ignore"):
        y = np.floor(x * SCALE)
    if y.size and np.abs(y).max() > largest(dim):
        raise ValueError(f"a component of {np.abs(x).max():g} gives squared distances beyond a long; scale the vectors down to {largest(dim) / SCALE:g}")
    return y.astype(np.int64)


class Neighbours:
    """Centroids with their lists of the others, nearest first."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        k = len(centroids)
        apart = np.array([((centroids - c) ** 2).sum(axis=1) for c in centroids], np.int64).reshape(k, k)
        np.fill_diagonal(apart, -1)
        order = np.argsort(apart, axis=1, kind="stable")[:, 1:]
        self.lists = order
        # A quarter of the squared distance, rounded up, exceeds d just where the squared distance exceeds 4 d.
        self.quarter = (np.take_along_axis(apart, order, axis=1) + 3) // 4

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each row of x (of equally near ones the smallest) and its squared distance."""
        n, k = len(x), len(self.centroids)
        current = np.zeros(n, np.int64)
        best = ((x - self.centroids[0]) ** 2).sum(axis=1)
        visited = np.zeros((n, k), bool)
        visited[:, 0] = True
        at = np.zeros(n, np.int64)
        going = np.arange(n)
        while True:
            going = going[at[going] < k - 1]
            going = going[self.quarter[current[going], at[going]] <= best[going]]
            if not len(going):
                return current, best
            other = self.lists[current[going], at[going]]
            at[going] += 1
            fresh = ~visited[going, other]
            rows, other = going[fresh], other[fresh]
            visited[rows, other] = True
            d = ((x[rows] - self.centroids[other]) ** 2).sum(axis=1)
            closer = (d < best[rows]) | ((d == best[rows]) & (other < current[rows]))
            rows = rows[closer]
            current[rows], best[rows], at[rows] = other[closer], d[closer], 0


def kept_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """vec_id and embedding (array of double) of the vectors with dim components, none null or non-finite."""
    x = F.col("embedding").cast("array<double>")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).where((F.size("embedding") == dim) & F.forall("embedding", finite))


def _rows(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return to_integers(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), dim)


def _moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: exact floors of the means of their vectors; those without vectors stay."""
    k, dim = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, n, total = Neighbours(centroids), np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            x = _rows(batch, dim)
            own = near.nearest(x)[0]
            n += np.bincount(own, minlength=k)
            np.add.at(total, own, x)
        held = np.flatnonzero(n)
        yield pa.record_batch([pa.array(held.astype(np.int32)), pa.array(n[held]), pa.array(total[held].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    found = vectors.mapInArrow(sums, "cluster int, n long, total array<long>").select("cluster", "n", F.posexplode("total").alias("place", "total"))
    out = centroids.copy()
    for c, place, total, n in found.groupBy("cluster", "place").agg(F.sum("total"), F.sum("n")).collect():
        out[c, place] = total // n
    return out


def first_vectors(vectors: DataFrame, k: int, order: Column, dim: int) -> np.ndarray:
    """The k vectors that come first by order (equal ones by their components), as integers."""
    rows = vectors.orderBy(order, "embedding").limit(k).select("embedding").collect()
    return to_integers(np.array([r[0] for r in rows], np.float64).reshape(len(rows), dim), dim)


def cluster(vectors: DataFrame, k: int, rounds: int, order: Column, dim: int) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid for each kept row of vectors (vec_id, embedding).

    Vectors with other than dim components, or with a null or non-finite one, are
    left out. The k first vectors by `order`, a column of vec_id, start as the
    centroids; fewer vectors give fewer centroids. distance is squared, centroid
    an array of long. Repeated rows count and are returned as often as they
    occur; a null vec_id is a row like others; no kept vector gives no row.
    Components beyond largest(dim) / SCALE are an error: their distances are no
    longs. What the driver and a task hold grows with k only: k * (k + dim) numbers.
    """
    spark = vectors.sparkSession
    vectors = kept_vectors(vectors, dim)
    centroids = first_vectors(vectors, k, order, dim)
    schema = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return spark.createDataFrame([], f"{schema}, cluster_inertia long, inertia long, centroid array<long>")
    for _ in range(rounds):
        before, centroids = centroids, _moved(vectors, centroids)
        if (before == centroids).all():
            break  # no later round would change anything

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Neighbours(centroids)
        for batch in batches:
            own, d = near.nearest(_rows(batch, dim))
            yield pa.record_batch([batch.column(0), pa.array(own.astype(np.int32)), pa.array(d)], names=["vec_id", "cluster", "distance"])

    assigned = cut(vectors.mapInArrow(assign, schema))
    inertia = dict(assigned.groupBy("cluster").agg(F.sum("distance")).collect())
    total = sum(inertia.values())
    own = [(c, inertia[c], total, centroids[c].tolist()) for c in sorted(inertia)]
    per_cluster = spark.createDataFrame(own, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return assigned.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def sql(k: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64) -> str:
    """The contract's rows of op12 in DuckDB SQL, one pair of common tables a round."""
    measured = """
  SELECT v.row, v.vec_id, c.cluster, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance
  FROM v, {c} c QUALIFY row_number() OVER (PARTITION BY v.row ORDER BY distance, c.cluster) = 1"""
    steps = []
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({measured.format(c=f'c{r}')})")
        steps.append(f"""m{r} AS MATERIALIZED (
  SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x
  FROM (SELECT cluster, i, sum(v.x[i]) AS s, count(*) AS n FROM a{r} JOIN v USING (row), unnest(generate_series(1, {dim})) AS t(i) GROUP BY cluster, i) GROUP BY cluster
)""")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.cluster, coalesce(m{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN m{r} USING (cluster))")
    body = ",\n".join(steps)
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, embedding, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS x
  FROM (SELECT * FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dim})
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), embedding) - 1 AS cluster, x FROM v
  QUALIFY cluster < {k}
),
{body},
a AS MATERIALIZED ({measured.format(c=f'c{rounds}')})
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(x, ',')) AS centroid_sha256
FROM a JOIN c{rounds} USING (cluster)
"""
