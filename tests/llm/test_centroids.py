"""Centroid clustering against a plain k-means in Python integers."""

import hashlib
import math
import random

import numpy as np

from medialake.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, h string"


def _brute(rows, dim, k, rounds, seed=2):
    kept = [(r[0], [math.floor(256 * float(np.float32(x))) for x in r[1]]) for r in rows
            if r[1] is not None and len(r[1]) == dim and all(x is not None and math.isfinite(x) for x in r[1])]
    digest = lambda i: (i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    cs = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs))

    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(cs)):
            mine = [v for (_, v), a in zip(kept, at) if a == j]
            if mine:
                cs[j] = [sum(x) // len(mine) for x in zip(*mine)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted(((i, c, d, sum(x[2] for x in out if x[1] == c), sum(x[2] for x in out), sha[c]) for i, c, d in out), key=str)


def _rows(n, dim, spread, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-1.5, 0.0, 0.25, rng.uniform(-spread, spread)]) for _ in range(dim)]) for i in range(n)]
    rows += [(900, None), (901, []), (902, [0.5] * (dim - 1)), (903, [0.5] * (dim + 1)), (904, [None] * dim),
             (905, [float("nan")] + [0.0] * (dim - 1)), (906, [float("-inf")] * dim), (None, [0.1] * dim),
             rows[0], rows[0], (rows[1][0], rows[2][1]), (907, [-0.001] * dim)]
    return rows


def test_clusters_equal_plain_kmeans(spark):
    for n, dim, k, rounds in ((60, 5, 7, 5), (25, 64, 40, 5), (3, 4, 40, 2), (200, 3, 11, 4)):
        rows = _rows(n, dim, 2, n)
        table = spark.createDataFrame([(*r, 1, 77, "x") for r in rows], SCHEMA).repartition(3)
        got = centroids.cluster_table(table, dim=dim, k=k, rounds=rounds)
        assert sorted((tuple(r) for r in got.collect()), key=str) == _brute(rows, dim, k, rounds)


def test_empty_and_huge(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert centroids.cluster_table(none).count() == 0
    big = spark.createDataFrame([(1, [3e38] * 4, 1, 1, ""), (2, [-3e38] * 4, 1, 1, ""), (3, [0.0] * 4, 1, 1, "")], SCHEMA)
    got = centroids.cluster_table(big, dim=4, k=1, rounds=1).collect()
    assert len(got) == 3 and max(r["distance"] for r in got) == 4 * centroids.EDGE ** 2


def test_walk_is_exact():
    rng = np.random.default_rng(3)
    for dim, k, span in ((64, 40, 300), (4, 17, 3), (1, 5, 4), (2, 1, 9)):
        p, c = rng.integers(-span, span, (700, dim)), rng.integers(-span, span, (k, dim))
        c[-1] = c[0]
        number, best = centroids.nearest(p, c)
        d = ((p[:, None, :] - c[None]) ** 2).sum(-1)
        assert (number == d.argmin(1)).all() and (best == d.min(1)).all()
