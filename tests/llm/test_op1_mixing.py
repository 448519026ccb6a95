import itertools

from brute import WORD, mixed
from pyspark.sql import functions as F

from cartloom.llm import op1_mixing


def test_query_equals_brute_force(docs, rows):
    got = {r.doc_id: r for r in op1_mixing.mix_documents(docs).collect()}
    sizes = [(i, s, len(WORD.findall(t or ""))) for i, t, _, s, _ in rows]
    for (i, source, size), (total, target, copies, taken) in zip(sizes, mixed(sizes), strict=True):
        r = got[i]
        assert (r.size, r.source_size, r.target, r.copies, r.taken) == (size, total, target, copies, taken)
        assert r.taken <= 3 * r.size and r.copy_sources == [source] * copies


def test_targets_cap_and_reshare():
    quotas = op1_mixing.source_quotas({"a": 1, "b": 100, None: 100})
    assert quotas["a"] == 3 and sum(quotas.values()) == 201 and abs(quotas[None] / quotas["b"] - 1.5) < 1e-9


def test_flow_is_least_cost():
    supply, members, quota = [3, 2, 4], [[0], [0, 1], [1]], [7, 8]
    flows = op1_mixing.route(supply, members, quota)
    sent = [sum(f.values()) for f in flows]
    assert [sum(f.get(s, 0) for f in flows) for s in (0, 1)] == quota
    price = lambda n, f: sum(max(0, f - k * n) for k in (1, 2))
    best = min(
        price(3, a) + price(2, b + c) + price(4, d)
        for a, b, c, d in itertools.product(range(10), range(7), range(7), range(13))
        if a + b == 7 and c + d == 8 and a <= 9 and b + c <= 6 and d <= 12
    )
    assert sum(price(n, f) for n, f in zip(supply, sent, strict=True)) == best


def test_overlapping_sources(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).when(F.col("id") % 3 == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit("b"))).alias("held"))
    out = op1_mixing.mix_sources(docs, F.col("held"), F.lit(10).cast("long"))
    given = out.select(F.explode("copy_sources").alias("s"), "size").groupBy("s").agg(F.sum("size").alias("words")).collect()
    words = {r.s: r.words for r in given}
    quotas = op1_mixing.source_quotas({"a": 20_000, "b": 20_000})
    assert all(abs(words[s] - quotas[s]) < 0.03 * quotas[s] for s in quotas)
    assert out.filter("copies > 3 OR size(copy_sources) <> copies").count() == 0


def test_odd_input(odd_docs, no_docs, spark):
    out = op1_mixing.mix_documents(odd_docs)
    assert out.count() == 5 and out.columns.count("size") == 1
    assert op1_mixing.mix_documents(no_docs).collect() == []
    stage = op1_mixing.stage(spark, odd_docs, "")
    assert stage.columns == odd_docs.columns and stage.filter("text IS NOT NULL").count() == 3
