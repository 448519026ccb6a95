import math
import random

from pyspark.sql import functions as F

from cartloom.llm import op9_topk as t


def best(rows, ask, k):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in usable:
        if q is None or not ask(q):
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), math.inf if i is None else i) for i, w in usable if i != q and len(w) == len(v)))[:k]
        out += [(q, n + 1, None if i == math.inf else i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out, key=str)


def run(spark, rows, k=5):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    return sorted(map(tuple, t.top_k(frame, F.col("vec_id") % 7 == 0, k=k).collect()), key=str)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(t, "QUERY_BLOCK", 16)
    monkeypatch.setattr(t, "CANDIDATE_BLOCK", 64)
    pick = random.Random(3)
    rows = [(i, [pick.gauss(0, 1) for _ in range(19)]) for i in range(400)]
    rows += [(400 + i, rows[5][1]) for i in range(30)]  # a vector that many share
    rows += [(1000, None), (1001, [1.0, None] + [0.0] * 17), (1002, [math.nan] * 19), (1008, [math.inf] * 19), (None, rows[7][1]), (1015, [1.0, 2.0]), (1016, [3.0, -1.0]), (1017, [0.5] * 19)]
    assert run(spark, [(i, v, 0) for i, v in rows]) == best(rows, lambda q: q % 7 == 0, 5)


def test_rows_that_are_equal_in_all(spark, monkeypatch):
    """A third of the table is one row; queries that share an id are answered each."""
    monkeypatch.setattr(t, "CANDIDATE_BLOCK", 16)
    pick = random.Random(8)
    rows = [(i, [float(pick.randint(-3, 3)) for _ in range(5)]) for i in range(60)] + [(33, [1.0, 2.0, 0.0, -1.0, 3.0])] * 30 + [(7, [0.5] * 5), (7, [-0.5] * 5)] + [(None, [2.0] * 5)] * 3
    once = [r for i, r in enumerate(rows) if r not in rows[:i]]
    want = [x for i, v in once if i is not None and i % 7 == 0 for x in best([(i, v), *[r for r in rows if r[0] != i]], lambda q, i=i: q == i, 5)]
    assert run(spark, [(i, v, 0) for i, v in rows]) == sorted(want, key=str)


def test_few_rows_and_large_values(spark):
    rows = [(0, [1e12, -1e3]), (7, [1.0, 1.0]), (3, [-2.5, 0.001])]
    assert run(spark, [(i, v, 0) for i, v in rows]) == best(rows, lambda q: q % 7 == 0, 5)
    assert run(spark, []) == []
