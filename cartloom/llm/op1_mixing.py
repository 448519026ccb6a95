"""Mixing overlapping sources to target weights by min-cost flow.

Documents are summed up by membership pattern (the set of sources that hold them); a flow of words runs from each pattern, whose first,
second and third repetition cost more and more, to the quotas of its sources; whole documents are then selected in a seeded order until
each pattern has given the words that the flow asks for. Only the pattern table meets the driver; documents are never shuffled.

Defined cases: a null text has no words; a null source is a source of its own, last in order; an empty membership list or a null one takes no
part and is never taken; rows with the same id are taken together; an empty table gives an empty mix; input columns named like an
output column are replaced.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cartloom.llm.common import count_words, own_columns, read, replace_columns, seeded
from cartloom.session import scratch_dir

WEIGHTS = (1.0, 2.0, 3.0)
MAX_EPOCHS = 3
SEED = 17
#: The pattern table is solved on the driver; more patterns than this are refused, not cut.
MAX_PATTERNS = 20_000
#: Seeded positions of a pattern are counted in this many equal ranges.
RANGES = 1024
_BITS = 60


def source_quotas(sizes: dict[str | None, int], weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> dict[str | None, float]:
    """Words asked of each source: by weight, in code point order with null last, at most ``max_epochs`` times its size."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, total, out, free = sum(sizes.values()), 0.0, {}, list(order)
    while free:
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free}
        over = [s for s in free if share[s] > max_epochs * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = float(max_epochs * sizes[s])
            left -= max_epochs * sizes[s]
        free = [s for s in free if s not in out]
    return out


def route(supply: Sequence[int], members: Sequence[Sequence[int]], quota: Sequence[float], max_epochs: int = MAX_EPOCHS) -> list[dict[int, Fraction]]:
    """Least-cost flow of words from patterns to quotas: the n-th repetition of a pattern costs n - 1 per word.

    Successive shortest paths on the residual graph, in exact fractions; returns the flow of each pattern to each of its sources.
    """
    n, m = len(supply), len(quota)
    sink = n + m + 1
    to: list[int] = []
    room: list[Fraction | float] = []  # exact, or without bound
    cost: list[int] = []
    out: list[list[int]] = [[] for _ in range(sink + 1)]

    def arc(a: int, b: int, capacity: Fraction | float, price: int) -> None:
        for x, y, c, p in ((a, b, capacity, price), (b, a, Fraction(0), -price)):
            out[x].append(len(to))
            to.append(y)
            room.append(c)
            cost.append(p)

    for p in range(n):
        for epoch in range(max_epochs):
            arc(0, 1 + p, Fraction(supply[p]), epoch)
    first = len(to)
    owner = []
    for p in range(n):
        for s in members[p]:
            arc(1 + p, 1 + n + s, math.inf, 0)
            owner.append((p, s))
    for s in range(m):
        arc(1 + n + s, sink, Fraction(quota[s]), 0)
    while True:
        far, came = [math.inf] * (sink + 1), [-1] * (sink + 1)
        far[0], todo, queued = 0, deque([0]), [False] * (sink + 1)
        while todo:
            x = todo.popleft()
            queued[x] = False
            for e in out[x]:
                if room[e] > 0 and far[x] + cost[e] < far[to[e]]:
                    far[to[e]], came[to[e]] = far[x] + cost[e], e
                    if not queued[to[e]]:
                        queued[to[e]] = True
                        todo.append(to[e])
        if far[sink] == math.inf:
            break
        path, x = [], sink
        while x:
            path.append(came[x])
            x = to[came[x] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
    flows: list[dict[int, Fraction]] = [{} for _ in range(n)]
    for i, (p, s) in enumerate(owner):
        if (moved := room[first + 2 * i + 1]) > 0:
            flows[p][s] = moved
    return flows


def mix_sources(
    docs: DataFrame,
    members: Column,
    size: Column,
    id_column: str = "doc_id",
    weights: Sequence[float] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """The documents with ``size``, ``source_size`` and ``target`` (of their first source), ``copies``, ``copy_sources`` (the source that
    each copy goes to) and ``taken`` (size times copies).

    ``members`` is an array of source names. Works in three passes over the documents: sums by pattern and seeded range; the one
    range in which a pattern's share ends; the choice itself.
    """
    spark = docs.sparkSession
    size_, members_, place, pattern, range_ = own_columns(docs, "size_", "members_", "place_", "pattern_", "range_")
    sized = docs.withColumn(members_, F.array_sort(F.array_distinct(members))).withColumn(pattern, F.to_json(members_)).withColumn(place, seeded(id_column, seed)).withColumn(range_, F.shiftright(place, _BITS - 10))
    grain_path = scratch_dir(spark, "mix-grain")
    # an unread text column is never decoded: only the columns that the expressions use reach the scan
    sized.select(pattern, members_, range_, size.alias(size_)).groupBy(pattern, range_).agg(F.first(members_).alias(members_), F.sum(size_).alias("words")).write.parquet(grain_path)
    grain = spark.read.parquet(grain_path)
    rows = grain.filter(F.size(members_) > 0).groupBy(pattern).agg(F.first(members_).alias("members"), F.sum("words").alias("words")).orderBy(pattern).limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    totals: dict[str | None, int] = {}
    for r in rows:
        for s in r["members"]:
            totals[s] = totals.get(s, 0) + r["words"]
    quotas = source_quotas(totals, weights, max_epochs)
    names = list(quotas)
    at = {s: i for i, s in enumerate(names)}
    flows = route([r["words"] for r in rows], [[at[s] for s in r["members"]] for r in rows], [quotas[s] for s in names], max_epochs)
    plan = []
    for r, flow in zip(rows, flows, strict=True):
        given = float(sum(flow.values()))
        full = int(given // r["words"]) if r["words"] else 0
        steps, upto = [], Fraction(0)
        for s, words in sorted(flow.items()):
            upto += words
            steps.append((float(upto / r["words"]), names[s]))
        first = r["members"][0]
        plan.append((r[pattern], full, given - full * r["words"], totals[first], quotas[first], steps))
    schema = T.StructType(
        [
            T.StructField("p_", T.StringType()),
            T.StructField("full_", T.LongType()),
            T.StructField("rest_", T.DoubleType()),
            T.StructField("source_size_", T.LongType()),
            T.StructField("target_", T.DoubleType()),
            T.StructField("steps_", T.ArrayType(T.StructType([T.StructField("upto", T.DoubleType()), T.StructField("source", T.StringType())]))),
        ]
    )
    planned = spark.createDataFrame(plan, schema)
    # the range of each pattern in which its rest is used up, and the place there up to which documents get one more copy
    in_order = Window.partitionBy(pattern).orderBy(range_)
    ends = (
        grain.withColumn("after_", F.sum("words").over(in_order))
        .withColumn("before_", F.col("after_") - F.col("words"))
        .join(F.broadcast(planned), F.col(pattern) == F.col("p_"))
        .filter((F.col("before_") <= F.col("rest_")) & (F.col("rest_") < F.col("after_")))
        .select("p_", F.col(range_).alias("end_"), "before_", "rest_")
    )
    last = (
        sized.join(F.broadcast(ends), (F.col(pattern) == F.col("p_")) & (F.col(range_) == F.col("end_")))
        .select("p_", "end_", "before_", "rest_", place, size.alias(size_))
        .groupBy("p_", "end_", "before_", "rest_", place)
        .agg(F.sum(size_).alias("unit"))
    )
    by_place = Window.partitionBy("p_").orderBy(place)
    last = last.withColumn("upto_", F.col("before_") + F.sum("unit").over(by_place)).filter(2 * F.col("upto_") - F.col("unit") <= 2 * F.col("rest_"))
    cuts = ends.join(last.groupBy(F.col("p_").alias("q_")).agg(F.max(place).alias("cut_")), F.col("p_") == F.col("q_"), "left").select("p_", "end_", "cut_")
    choice = planned.join(cuts, "p_", "left")
    picked = sized.withColumn(size_, size).join(F.broadcast(choice), F.col(pattern) == F.col("p_"), "left")
    extra = (F.col(range_) < F.col("end_")) | ((F.col(range_) == F.col("end_")) & (F.col(place) <= F.col("cut_")))
    copies = F.coalesce(F.col("full_") + F.coalesce(extra, F.lit(False)).cast("long"), F.lit(0)).cast("int")
    part = F.col(place) / float(1 << _BITS)
    goes_to = F.transform(
        F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.coalesce(F.get(F.filter("steps_", lambda s: s["upto"] > i + part), F.lit(0)), F.element_at("steps_", -1))["source"],
    )
    out = {
        "size": F.col(size_),
        "source_size": F.col("source_size_"),
        "target": F.col("target_"),
        "copies": copies,
        "copy_sources": goes_to,
        "taken": F.col(size_) * copies.cast("long"),
    }
    return replace_columns(picked, out).drop(*{size_, members_, place, pattern, range_, "p_", "full_", "rest_", "source_size_", "target_", "steps_", "end_", "cut_"} - set(docs.columns))


def mix_documents(docs: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Each document belongs to its ``source`` and weighs its words."""
    return mix_sources(docs, F.array("source"), count_words("text"), max_epochs=max_epochs)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: a row for each copy that the mix takes."""
    mixed = mix_documents(docs).filter(F.col("copies") > 0)
    (copy_,) = own_columns(mixed, "copy_")
    return mixed.withColumn(copy_, F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


QUERIES = {"op1_mix_sources": op1_mix_sources}

ORACLE = {
    "op1_mix_sources": r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || left(md5('17:' || coalesce('=' || doc_id, 'null')), 15))::BIGINT AS place
  FROM documents),
s AS MATERIALIZED (
  SELECT source, sum(size)::BIGINT AS total, (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS w FROM d GROUP BY source),
fill AS (
  SELECT 0 AS round, source, total, w, false AS capped, ((SELECT sum(total) FROM s)::DOUBLE * w) / (SELECT sum(w) FROM s) AS share FROM s
  UNION ALL
  SELECT round + 1, source, total, w, now_capped,
    CASE WHEN now_capped THEN 3.0 * total
      ELSE ((sum(total) OVER () - sum(CASE WHEN now_capped THEN 3 * total ELSE 0 END) OVER ())::DOUBLE * w) / sum(CASE WHEN now_capped THEN 0 ELSE w END) OVER () END
  FROM (SELECT *, capped OR share > 3 * total AS now_capped FROM fill) WHERE round < 40),
goal AS (SELECT source, total, share AS target, CASE WHEN total > 0 THEN floor(share / total) ELSE 0 END AS full_copies FROM fill WHERE round = 40),
o AS (
  SELECT d.*, total, target, full_copies, target - full_copies * total AS rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(size) OVER (PARTITION BY d.source, place) AS unit
  FROM d JOIN goal ON d.source IS NOT DISTINCT FROM goal.source)
SELECT doc_id, size, total AS source_size, target, (size * (full_copies + (2 * upto - unit <= 2 * rest)::INT))::BIGINT AS taken,
  (full_copies + (2 * upto - unit <= 2 * rest)::INT)::INT AS copies
FROM o"""
}
