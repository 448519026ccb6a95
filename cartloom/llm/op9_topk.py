"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into 1, 4 and 16 segments; the means and deviations of two vectors' segments bound their distance from below and so their
inner product from above: sum of length * (mean * mean + deviation * deviation). Candidates are bounded coarse to fine against the
k-th best exact score so far, and exact integer scores are taken for the survivors only. Queries and candidates meet as packed
blocks, every pair of blocks once; a task holds one pair.

Defined cases: vectors that are null or hold null or a non-finite component take no part; only vectors of equal length are compared; a row
without id is a candidate (last among ties) but no query; rows with the query's id are not its candidates; repeated query rows are answered
once for each vector; repeated candidate rows each count, but are searched as one; an empty table gives no rows. Scores are exact while they fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartloom.llm.common import read, written

SEGMENTS = (1, 4, 16)
K = 5
SCALE = 256.0
QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 8192
_LAST = np.iinfo(np.int64).max


def statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Per vector and segment, mean and deviation, each times the root of the segment's length."""
    cuts = np.linspace(0, vectors.shape[1], min(segments, vectors.shape[1]) + 1).astype(int)
    size = np.diff(cuts)
    total = np.add.reduceat(vectors, cuts[:-1], axis=1)
    square = np.add.reduceat(vectors * vectors, cuts[:-1], axis=1)
    return np.concatenate([total / np.sqrt(size), np.sqrt(np.maximum(square - total * total / size, 0.0))], axis=1)


def best_of_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query, its k best candidates of the block as (row of the query, rows, scores)."""
    exact = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * vectors.shape[1] < 2.0**52
    fq, fv = queries.astype(np.float64), vectors.astype(np.float64)
    levels = [(statistics(fq, s), statistics(fv, s)) for s in SEGMENTS]
    slack = 1e-9 * (np.linalg.norm(fq, axis=1)[:, None] * np.linalg.norm(fv, axis=1).max(initial=0)) + 1e-6
    for a in range(0, len(queries), 64):
        rows = slice(a, a + 64)
        others = query_ids[rows, None] != ids[None, :]

        def scores(columns: np.ndarray, rows: slice = rows) -> np.ndarray:
            if exact:
                return np.rint(fq[rows] @ fv[columns].T).astype(np.int64)
            return queries[rows] @ vectors[columns].T

        bound = levels[0][0][rows] @ levels[0][1].T
        seeds = np.unique(np.argpartition(-np.where(others, bound, -np.inf), min(4 * k, len(ids) - 1), axis=1)[:, : 4 * k])
        first = np.where(others[:, seeds], scores(seeds).astype(np.float64), -np.inf)
        least = np.sort(first, axis=1)[:, -k] if first.shape[1] >= k else np.full(len(first), -np.inf)
        floor = least[:, None] - slack[rows]
        keep = np.arange(len(ids))
        alive = others & (bound >= floor)
        for q, v in levels[1:]:
            keep = keep[alive[:, keep].any(axis=0)]
            alive[:, keep] &= q[rows] @ v[keep].T >= floor
        keep = keep[alive[:, keep].any(axis=0)]
        found = scores(keep)
        for i in range(found.shape[0]):
            mine = np.flatnonzero(alive[i, keep])
            order = mine[np.lexsort((ids[keep[mine]], -found[i, mine]))[:k]]
            yield a + i, keep[order], found[i, order]


def _packed(rows: DataFrame, block: Column, name: str) -> DataFrame:
    """One row for each block and length: ids, numbers (``number``) and integer vectors one after another."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocks, dims = np.asarray(b.column(3)), np.asarray(b.column(4))
            ids, numbers = np.asarray(b.column(0).fill_null(_LAST)), np.asarray(b.column(1))
            for key in np.unique(np.stack([blocks, dims], axis=1), axis=0):
                rows = np.flatnonzero((blocks == key[0]) & (dims == key[1]))
                flat = b.column(2).take(pa.array(rows)).flatten().cast(pa.float64())
                whole = np.clip(np.floor(SCALE * np.asarray(flat)), -(2.0**62), 2.0**62).astype(np.int64)
                yield pa.record_batch(
                    [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids[rows], numbers[rows], whole))],
                    [f"{name}_block", f"{name}_dim", "ids", "numbers", "data"],
                )

    rows = rows.select("id", "number", F.col("vector").cast("array<double>"), block.cast("long").alias("b"), F.size("vector").alias("d"))
    return rows.mapInArrow(pack, f"{name}_block long, {name}_dim int, ids binary, numbers binary, data binary")


def _whole(parts: list, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, numbers, data = (np.concatenate([np.frombuffer(p[c], dtype=np.int64) for p in parts]) for c in ("ids", "numbers", "data"))
    return ids, numbers, data.reshape(len(ids), dim)


def top_k(vectors: DataFrame, queries: Column, id_column: str = "vec_id", vector_column: str = "embedding", k: int = K) -> DataFrame:
    """For each row where ``queries`` holds, its k best others: ``query_id``, ``rank`` from 1, ``id``, ``score``; ties to the smaller id."""
    usable = F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asked")).filter(usable)
    # equal rows are one row with their number, of which no answer needs more than k; in a written table each keeps its own query number
    distinct = written(rows.groupBy("id", "vector").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("number"), F.max("asked").alias("asked")), "vectors")
    n, asked = distinct.agg(F.count(F.lit(1)), F.count_if("asked")).first()
    n_query, n_block = max(1, -(-asked // QUERY_BLOCK)), max(1, -(-n // CANDIDATE_BLOCK))
    place = F.xxhash64("id", F.hash("vector"))
    asking = distinct.withColumn("number", F.monotonically_increasing_id()).filter("asked AND id IS NOT NULL")
    q = _packed(asking, F.pmod(place, F.lit(n_query)), "q")
    v = _packed(distinct, F.pmod(place, F.lit(n_block)), "v")
    # each packed piece of candidates goes to every block of queries
    part = F.struct("ids", "numbers", "data")
    q = q.groupBy("q_block", "q_dim").agg(F.collect_list(part).alias("q_parts"))
    v = v.withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_query - 1).cast("long")))).groupBy("to", "v_dim", "v_block").agg(F.collect_list(part).alias("v_parts"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                dim, q_parts, v_parts = (b.column(c)[i].as_py() for c in range(3))
                query_ids, query_rows, query_data = _whole(q_parts, dim)
                ids, times, data = _whole(v_parts, dim)
                if dim:
                    out = list(best_of_block(query_ids, query_data, ids, data, k))
                else:
                    out = [(j, o := np.argsort(np.where(ids != own, ids, _LAST), kind="stable")[: k + 1], np.zeros(len(o), dtype=np.int64)) for j, own in enumerate(query_ids)]
                rows = np.concatenate([r for _, r, _ in out]) if out else np.empty(0, dtype=np.int64)
                score = np.concatenate([s for _, _, s in out]) if out else rows
                which = np.repeat([j for j, _, _ in out], [len(r) for _, r, _ in out]).astype(np.int64)
                again = np.where(ids[rows] != query_ids[which], times[rows], 0)
                rows, which, score = (np.repeat(x, again) for x in (rows, which, score))
                found = ids[rows]
                yield pa.record_batch([pa.array(query_ids[which]), pa.array(query_rows[which]), pa.array(found, mask=found == _LAST), pa.array(score)], ["query_id", "query_row", "id", "score"])

    pairs = q.join(v, (F.col("q_block") == F.col("to")) & (F.col("q_dim") == F.col("v_dim"))).select("q_block", "v_block", "q_dim", "q_parts", "v_parts")
    # a task for each pair of blocks, as far as there are tasks; left alone, small blocks would all go to one
    tasks = min(n_query * n_block, 4 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    near = pairs.repartition(tasks, "q_block", "v_block").select("q_dim", "q_parts", "v_parts").mapInArrow(search, "query_id long, query_row long, id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.withColumnRenamed("id", "vec_id")


QUERIES = {"op9_exact_topk": op9_exact_topk}

ORACLE = {
    "op9_exact_topk": """
WITH v AS MATERIALIZED (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5"""
}
