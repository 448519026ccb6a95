import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from cartloom.llm import op11_clusters as t


def plain(rows, k, rounds, dimension):
    """All distances in Python's integers."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)]
    place = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), np.array(r[1], dtype=np.int64).tobytes())
    centroids = [v for _, v in sorted(kept, key=place)[:k]]
    distance = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min((distance(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, g in groups.items():
            centroids[n] = [sum(x) // len(g) for x in zip(*g, strict=True)]
    return sorted([(i, nearest(v)[1], min(nearest(v)[0], 2**63 - 1)) for i, v in kept], key=str), centroids


def run(spark, rows, k, rounds, dimension):
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, Cluster string").repartition(4)
    out, centroids = t.clusters(frame, k=k, rounds=rounds, dimension=dimension)
    return sorted(map(tuple, out.collect()), key=str), centroids


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(t, "LEADING", 3)
    pick = random.Random(3)
    rows = [(i, [pick.gauss(0, 1) + 5 * (i % 4) * (d == 2) for d in range(9)]) for i in range(400)]
    rows += [(400 + i, rows[5][1]) for i in range(40)]  # a vector that many share
    rows += [(1000 + i, [pick.randint(-1, 1) / 256 for _ in range(9)]) for i in range(60)]  # many ties
    rows += [(7, rows[9][1]), (7, rows[9][1]), (None, rows[3][1]), (2000, None), (2001, [1.0, None] + [0.0] * 7), (2002, [math.nan] * 9), (2003, [math.inf] * 9), (2004, [1.0]), (2005, [])]
    for k, rounds in ((12, 4), (40, 1), (1, 2)):
        assert run(spark, rows, k, rounds, 9) == plain(rows, k, rounds, 9)


def test_few_rows_and_large_values(spark):
    rows = [(0, [1e8, -1e3, 0.0]), (7, [1.0, 1.0, -1e7]), (3, [-2.5, 0.001, 1e9]), (4, [1e9, 1e9, 1e9]), (5, [-1e9, -1e9, -1e9])]
    assert run(spark, rows, 2, 3, 3) == plain(rows, 2, 3, 3)
    assert run(spark, rows, 40, 5, 3) == plain(rows, 40, 5, 3)
    out, _ = t.clusters(spark.createDataFrame([(1, [1e300] * 3), (2, [-1e300] * 3)], "vec_id long, embedding array<double>"), k=1, dimension=3)
    assert sorted(r.distance for r in out.collect())[-1] == 2**63 - 1
    assert run(spark, [], 40, 5, 3) == ([], [])


def test_bounds_spare_most_distances():
    pick = np.random.default_rng(0)
    centres = pick.normal(0, 300, (40, 64)) * np.linspace(1, 0.02, 64)
    whole = np.rint(centres[pick.integers(0, 40, 4000)] + pick.normal(0, 20, (4000, 64))).astype(np.int64)
    axes = t.Axes(len(whole), whole.sum(axis=0).astype(float), (whole.T @ whole).astype(float))
    cluster, distance, taken = t.nearest(whole, *axes.turn(whole), whole[:40], axes)
    every = ((whole[:, None, :] - whole[None, :40, :]) ** 2).sum(axis=2)
    assert distance.tolist() == every.min(axis=1).tolist()
    assert cluster.tolist() == every.argmin(axis=1).tolist()
    assert taken < len(whole) * 40 / 4


def test_query_on_a_table_without_usable_rows(spark, tmp_path):
    spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = t.op11_clusters(spark, str(tmp_path))
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert out.agg(F.count(F.lit(1))).first()[0] == 0
