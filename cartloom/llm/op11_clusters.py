"""Exact k-means in whole numbers, with centroids filtered in a rotated space.

The vectors' principal axes come from moments summed in Spark. Each vector is stored once with its leading rotated coordinates and the norm of
the rest; the squared distance of the leading coordinates plus the squared difference of the norms bounds the distance to a centroid from
below. A round takes the exact distance to the centroid with the least bound, and then to those others whose bound doesn't exceed it, in
integers; rounding can only let more centroids through, never change a result. A round is one pass over the stored table: tasks add up their
vectors by cluster, Spark adds up the tasks, and the driver sees ``k`` sums.

Defined cases: vectors that are null, of another dimension, or hold a null or non-finite component take no part; a vector without id takes
part, and is a first centroid only where fewer than ``k`` others are left; rows with the same id are vectors of their own, the smaller
one first among first centroids; with fewer than ``k`` vectors there are that many centroids; an empty table gives no rows. Scaled components
beyond 2**40 count as 2**40; distances and their sums are exact up to the largest long, which stands for all above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartloom.llm.common import read, written

DIMENSION = 64
K = 40
ROUNDS = 5
SEED = 2
SCALE = 256.0
#: Leading coordinates kept of a rotated vector.
LEADING = 16
#: Vectors handled at once.
BLOCK = 4096
_LIMIT = 2.0**40
#: Up to this size, squared distances of up to 2**13 components are exact in 64 bits.
_NARROW = 1 << 24
_MOST = 2**63 - 1
#: Vectors a task adds up before it hands on its sums: fewer than 2**63 / _LIMIT.
_SUM_ROWS = 1 << 22


def _whole(batch: pa.RecordBatch, column: int, dimension: int) -> np.ndarray:
    flat = np.asarray(batch.column(column).flatten().cast(pa.float64()))
    return np.clip(np.floor(SCALE * flat), -_LIMIT, _LIMIT).astype(np.int64).reshape(batch.num_rows, dimension)


def _packed(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    """Rows of a binary column of equal lengths, as an array."""
    start, data = column.offset, np.frombuffer(column.buffers()[2], dtype=dtype)
    return data[: (start + len(column)) * width].reshape(-1, width)[start:]


def _binary(rows: np.ndarray) -> pa.Array:
    size = rows.dtype.itemsize * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


class Axes:
    """Principal axes: turns vectors into leading coordinates and the norm of the others."""

    def __init__(self, n: int, sums: np.ndarray, products: np.ndarray, leading: int = LEADING):
        self.centre = sums / max(n, 1)
        _, vectors = np.linalg.eigh(products / max(n, 1) - np.outer(self.centre, self.centre))
        self.axes, self.leading = vectors[:, ::-1], min(leading, len(sums))

    def turn(self, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        turned = (whole.astype(np.float64) - self.centre) @ self.axes
        return turned[:, : self.leading], np.linalg.norm(turned[:, self.leading :], axis=1)


def nearest(whole: np.ndarray, leading: np.ndarray, rest: np.ndarray, centroids: np.ndarray, axes: Axes) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid and exact squared distance of each vector; of equal ones the smallest number. Also, how many exact
    distances were taken."""
    c_leading, c_rest = axes.turn(centroids)
    own = (leading * leading).sum(axis=1) + rest * rest
    other = (c_leading * c_leading).sum(axis=1) + c_rest * c_rest
    bound = own[:, None] + other[None, :] - 2 * (leading @ c_leading.T + np.outer(rest, c_rest))
    # far above what rounding can do to bounds of these sizes
    bound -= 1e-9 * (own[:, None] + other[None, :]) + 1e-6
    wide = max(int(np.abs(whole).max(initial=0)), int(np.abs(centroids).max(initial=0))) > _NARROW
    if wide:  # numbers of any size
        whole, centroids = whole.astype(object), centroids.astype(object)
    every = np.arange(len(whole))
    cluster = bound.argmin(axis=1)
    off = whole - centroids[cluster]
    least = (off * off).sum(axis=1)
    alive = bound <= least.astype(np.float64)[:, None]
    alive[every, cluster] = False
    for c in range(len(centroids)):
        rows = np.flatnonzero(alive[:, c])
        off = whole[rows] - centroids[c]
        distance = (off * off).sum(axis=1)
        better = (distance < least[rows]) | ((distance == least[rows]) & (c < cluster[rows]))
        rows = rows[better]
        least[rows], cluster[rows] = distance[better], c
    return cluster, np.minimum(least, _MOST).astype(np.int64), len(whole) + int(alive.sum())


def _moments(vectors: DataFrame, dimension: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of vectors, their sum, and the sum of their outer products; a task sends one row for each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimension + 1, dimension + 1))
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK):
                part = batch.slice(first, BLOCK)
                rows = np.concatenate([_whole(part, 1, dimension).astype(np.float64), np.ones((part.num_rows, 1))], axis=1)
                total += rows.T @ rows
        yield pa.record_batch([pa.array(range(dimension + 1), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "row"])

    sums = vectors.mapInArrow(run, "i int, row array<double>").groupBy("i").agg(*[F.sum(F.col("row")[d]).alias(f"s{d}") for d in range(dimension + 1)])
    table = np.zeros((dimension + 1, dimension + 1))
    for r in sums.collect():
        table[r[0]] = r[1:]
    return round(table[-1, -1]), table[-1, :-1], table[:-1, :-1]


def _stored(vectors: DataFrame, axes: Axes, dimension: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK):
                part = batch.slice(first, BLOCK)
                whole = _whole(part, 1, dimension)
                leading, rest = axes.turn(whole)
                yield pa.record_batch([part.column(0), _binary(whole), _binary(leading), pa.array(rest)], ["id", "whole", "leading", "rest"])

    return written(vectors.mapInArrow(run, "id long, whole binary, leading binary, rest double"), "vectors")


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray, axes: Axes) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for first in range(0, batch.num_rows, BLOCK):
        part = batch.slice(first, BLOCK)
        whole, leading = _packed(part.column(1), np.int64, centroids.shape[1]), _packed(part.column(2), np.float64, axes.leading)
        cluster, distance, _ = nearest(whole, leading, np.asarray(part.column(3)), centroids, axes)
        yield part, whole, cluster, distance


def _moved(stored: DataFrame, centroids: np.ndarray, axes: Axes) -> np.ndarray:
    """The centroids after a round."""
    k, dimension = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sums() -> pa.RecordBatch:
            return pa.record_batch([pa.array(range(k), pa.int32()), pa.array(count), pa.array(total.tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

        total, count = np.zeros((k, dimension), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            for _, whole, cluster, _ in _assigned(batch, centroids, axes):
                order = np.argsort(cluster, kind="stable")
                found, first = np.unique(cluster[order], return_index=True)
                total[found] += np.add.reduceat(whole[order], first, axis=0)
                count += np.bincount(cluster, minlength=k)
                if count.sum() >= _SUM_ROWS:
                    yield sums()
                    total[:], count[:] = 0, 0
        yield sums()

    parts = stored.mapInArrow(run, "cluster int, n long, total array<long>").filter("n > 0")
    added = parts.groupBy("cluster").agg(F.sum("n"), *[F.sum(F.col("total")[d].cast("decimal(38,0)")) for d in range(dimension)])
    out = centroids.copy()
    for cluster, n, *total in added.collect():
        out[cluster] = [int(t) // n for t in total]
    return out


def clusters(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = K, rounds: int = ROUNDS, dimension: int = DIMENSION, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """``id``, ``cluster`` and ``distance`` (squared) of every vector, and the final centroids."""
    finite = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    usable = rows.filter(F.col("vector").isNotNull() & (F.size("vector") == dimension) & finite)
    axes = Axes(*_moments(usable, dimension))
    stored = _stored(usable, axes, dimension)
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = stored.select(place.alias("place"), "whole").orderBy(F.col("place").asc_nulls_last(), "whole").limit(k).collect()
    centroids = np.array([np.frombuffer(r.whole, dtype=np.int64) for r in first], dtype=np.int64).reshape(len(first), dimension)
    for _ in range(rounds if len(first) else 0):
        centroids = _moved(stored, centroids, axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, cluster, distance in _assigned(batch, centroids, axes):
                yield pa.record_batch([part.column(0), pa.array(cluster, pa.int32()), pa.array(distance)], ["id", "cluster", "distance"])

    return written(stored.mapInArrow(run, "id long, cluster int, distance long"), "assigned"), centroids.tolist()


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = clusters(read(spark, sf_dir, "embeddings"))
    of_cluster = {r[0]: int(r[1]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    schema = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("cluster_inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())])
    # a row for each centroid
    about = spark.createDataFrame([(c, min(of_cluster.get(c, 0), _MOST), d) for c, d in enumerate(digest)], schema)
    inertia = F.lit(min(sum(of_cluster.values()), _MOST)).cast("long")
    return assigned.join(F.broadcast(about), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", inertia.alias("inertia"), "centroid_sha256")


QUERIES = {"op11_clusters": op11_clusters}


def _assignment(centroids: str, name: str) -> str:
    distance = "list_dot_product(v.e, v.e) + list_dot_product(c.e, c.e) - 2 * list_dot_product(v.e, c.e)"
    return f"""{name} AS MATERIALIZED (
  SELECT v.r, c.cluster, ({distance})::BIGINT AS distance FROM v CROSS JOIN {centroids} c
  QUALIFY row_number() OVER (PARTITION BY v.r ORDER BY distance, c.cluster) = 1)"""


def _round(n: int) -> str:
    return f"""{_assignment(f"c{n}", f"a{n}")},
m{n} AS (
  SELECT cluster, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS e FROM (
    SELECT a.cluster, i, sum(v.e[i]::HUGEINT) AS s, count(*)::HUGEINT AS n FROM a{n} a JOIN v USING (r), range(1, {DIMENSION + 1}) t(i) GROUP BY ALL)
  GROUP BY cluster),
c{n + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.e, c.e) AS e FROM c{n} c LEFT JOIN m{n} m USING (cluster))"""


ORACLE = {
    "op11_clusters": f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id, embedding) AS r, [floor({SCALE:.0f} * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE len(embedding) = {DIMENSION} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), e) - 1)::INT AS cluster, e FROM v
  QUALIFY cluster < {K}),
{", ".join(_round(n) for n in range(ROUNDS))},
{_assignment(f"c{ROUNDS}", "a")}
SELECT v.vec_id, a.cluster, a.distance, (sum(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(a.distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string([x::BIGINT FOR x IN c.e], ',')) AS centroid_sha256
FROM a JOIN v USING (r) JOIN c{ROUNDS} c USING (cluster)"""
}
