"""Centroid clustering: exact integer k-means with the threshold algorithm as its search.

Method.  Every kept vector becomes ``DIM`` integers floor(256 * x).  An assignment looks for the
nearest centroid with the threshold algorithm: each dimension keeps its centroids sorted by
value; from the vector's own value the lists are walked outward, one centroid per dimension
and step, nearest first.  A centroid met for the first time gets its exact squared distance.
The squares of the last steps, summed over the dimensions, bound every centroid not met yet
from below, so the walk stops when that sum is strictly larger than the best exact distance
(or every centroid has been met); ties are then all met and the smallest number wins.  Each round a task hands on the count and
component sums of its non-empty centroids; Spark adds them up, and only ``K`` times ``DIM``
sums reach the driver.  After ``ROUNDS`` rounds the vectors are assigned once more.

Scale.  The integer vectors are written once to the shared folder and read by the rounds; there
is no shuffle of vectors, only of at most ``K`` times ``DIM`` partial sums per task.  The centroids (``K``
times ``DIM`` integers) go to the tasks in the function itself.  A lost executor costs its
tasks of the current round.

Defined results.  A vector counts only with exactly ``DIM`` components, none NULL or non-finite;
all other rows give no row.  Components are clipped to +-2**27 (values beyond +-524,288), so that
every squared distance fits a long; an inertia beyond the range of a long stays at its largest
value.  Repeated rows each count.  Among equal hashes (repeated ids) the lesser vector is the
earlier centroid; a NULL id hashes last.  With fewer than ``K`` kept vectors there are as many
centroids as vectors, with none there is no row.  Only ``vec_id`` and ``embedding`` are read, so
further columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.session import cut_lineage

DIM, K, ROUNDS, SEED, UNIT = 64, 40, 5, 2, 256
#: Largest size of a component: 64 squares of twice this sum up to less than 2**63.
EDGE = 1 << 27
#: Vectors that walk the lists together.
STEP = 512


def kept_vectors(embeddings: DataFrame, dim: int = DIM) -> DataFrame:
    """Rows (vec_id, v): the integer components of every complete, finite vector."""
    x = F.col("embedding")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    part = lambda e: F.greatest(F.lit(-EDGE), F.least(
        F.lit(EDGE), F.floor(F.least(F.lit(2.0**40), F.greatest(F.lit(-2.0**40), e.cast("double") * UNIT)))))
    return (embeddings.where((F.size(x) == dim) & ~F.coalesce(bad, F.lit(True)))
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, part).cast("array<long>").alias("v")))


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of each point (threshold algorithm)."""
    n, dim = points.shape
    k = len(centroids)
    order = np.argsort(centroids, axis=0, kind="stable")  # per dimension: centroids by value
    values = np.take_along_axis(centroids, order, axis=0)
    far = np.iinfo(np.int64).max
    rows, dims = np.arange(n)[:, None], np.arange(dim)[None, :]
    right = np.stack([np.searchsorted(values[:, d], points[:, d]) for d in range(dim)], axis=1)
    left = right - 1
    best, number = np.full(n, far), np.full(n, k)
    seen = np.zeros((n, k), dtype=bool)
    walking = np.arange(n)
    for _ in range(k):
        p = points[walking]
        lo, hi = left[walking], right[walking]
        gap_lo = np.where(lo >= 0, p - values[np.maximum(lo, 0), dims], far)
        gap_hi = np.where(hi < k, values[np.minimum(hi, k - 1), dims] - p, far)
        down = gap_lo <= gap_hi
        met = order[np.where(down, lo, hi), dims]
        gap = np.minimum(gap_lo, gap_hi)
        left[walking] = np.where(down, lo - 1, lo)
        right[walking] = np.where(down, hi, hi + 1)
        new = np.zeros((len(walking), k), dtype=bool)
        new[rows[: len(walking)], met] = True
        new &= ~seen[walking]
        seen[walking] |= new
        at, who = np.nonzero(new)
        apart = p[at] - centroids[who]
        exact = np.full((len(walking), k), far)
        exact[at, who] = np.einsum("ij,ij->i", apart, apart)
        first = exact.argmin(axis=1)  # the smallest number among equals
        d = exact[np.arange(len(walking)), first]
        better = (d < best[walking]) | ((d == best[walking]) & (first < number[walking]))
        best[walking] = np.where(better, d, best[walking])
        number[walking] = np.where(better, first, number[walking])
        frontier = np.einsum("ij,ij->i", gap, gap)
        walking = walking[~((frontier > best[walking]) | seen[walking].all(axis=1))]
        if not len(walking):
            break
    return number, best


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    points = _matrix(batch.column("v"), centroids.shape[1])
    for i in range(0, len(points), STEP):
        part = points[i: i + STEP]
        yield (i, part, *nearest(part, centroids))


def _round(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: exact floor of the mean, empty ones as they were."""
    k, dim = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, dtype=np.int64), np.zeros((k, dim), dtype=np.int64)
        for batch in batches:
            for _, part, number, _ in _assigned(batch, centroids):
                count += np.bincount(number, minlength=k)
                np.add.at(total, number, part)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(at, dim), pa.int32()), pa.array(np.tile(np.arange(dim), len(at)), pa.int32()),
             pa.array(np.repeat(count[at], dim)), pa.array(total[at].ravel())], names=["cluster", "d", "n", "total"])

    parts = vectors.select("v").mapInArrow(sums, "cluster int, d int, n long, total long")
    out = centroids.copy()
    for row in parts.groupBy("cluster", "d").agg(  # at most k * dim rows
            F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("t")).collect():
        out[row["cluster"], row["d"]] = int(row["t"]) // row["n"]
    return out


def cluster(embeddings: DataFrame, dim: int = DIM, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """Rows (vec_id, cluster, distance) of every kept vector, and the final centroids."""
    vectors = cut_lineage(kept_vectors(embeddings, dim), "centroid-vectors")
    start = (vectors.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
             .orderBy(F.col("h").asc_nulls_last(), "v").limit(k).select("v").collect())  # k rows
    centroids = np.array([r["v"] for r in start], dtype=np.int64).reshape(-1, dim)
    for _ in range(rounds if len(centroids) else 0):
        moved = _round(vectors, centroids)
        if (moved == centroids).all():  # a fixed point: further rounds change nothing
            break
        centroids = moved
    final = centroids

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, part, number, best in _assigned(batch, final):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").slice(i, len(part)), pa.array(number, pa.int32()), pa.array(best)],
                    names=["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(assign, "vec_id long, cluster int, distance long"), centroids


def cluster_table(embeddings: DataFrame, **how: int) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, the inertia of its cluster and of
    all, and the digest of its final centroid."""
    rows, centroids = cluster(embeddings, **how)
    rows = cut_lineage(rows, "centroid-assigned")
    spark, top = embeddings.sparkSession, (1 << 63) - 1
    per = {r["cluster"]: int(r["d"]) for r in  # at most k rows
           rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    told = [(c, min(d, top), min(sum(per.values()), top),
             hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
            for c, d in per.items()]
    side = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(side), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """The rounds one after the other, by the plain distance to every centroid."""
    def assigned(name: str, before: str) -> str:
        return f""", {name} AS MATERIALIZED (
  SELECT row_id, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM (
    SELECT p.row_id, c.cluster, sum((p.x - c.x) * (p.x - c.x)) AS distance
    FROM part p JOIN {before} c USING (d) GROUP BY 1, 2) GROUP BY row_id)"""

    sql = f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, vec_id,
         list_transform(embedding, lambda e: CAST(floor({UNIT} * CAST(e AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {DIM}
    AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {DIM})
, part AS MATERIALIZED (SELECT row_id, unnest(range({DIM})) AS d, unnest(v) AS x FROM kept)
, first AS (SELECT row_id, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, v) - 1 AS cluster FROM kept)
, c0 AS MATERIALIZED (SELECT cluster, d, x FROM part JOIN first USING (row_id) WHERE cluster < {K})"""
    for r in range(ROUNDS):
        sql += assigned(f"a{r}", f"c{r}") + f"""
, c{r + 1} AS MATERIALIZED (
  SELECT c.cluster, c.d, CASE WHEN s.n IS NULL THEN c.x ELSE (s.t - ((s.t % s.n) + s.n) % s.n) // s.n END AS x
  FROM c{r} c LEFT JOIN (SELECT cluster, d, sum(x) AS t, count(*) AS n FROM part JOIN a{r} USING (row_id) GROUP BY 1, 2) s
  USING (cluster, d))"""
    return sql + assigned("a", f"c{ROUNDS}") + f"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
       CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a JOIN kept USING (row_id)
JOIN (SELECT cluster, sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256
      FROM c{ROUNDS} GROUP BY cluster) USING (cluster)"""


ORACLE_SQL = _oracle()
