import itertools
import os

import numpy as np
import pytest
from brute import base_rules

from cartloom.llm import op5_quality as q

SMALL = "/root/testdata/sf0.01"


def test_base_rules_equal_brute_force(docs, rows):
    got = {r.doc_id: r for r in q.quality(docs, q.Field.untrained()).collect()}
    for i, text, *_ in rows:
        want = base_rules(text)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r.kept == (not r.base_failed)  # an untrained field calls every line content


def _score(field, features, labels):
    return sum(field.emit[f, y].sum() for f, y in zip(features, labels, strict=True)) + sum(field.step[a, b] for a, b in itertools.pairwise(labels))


def test_decoding_and_gradients_equal_enumeration():
    pick = np.random.default_rng(1)
    field = q.Field(pick.normal(size=(q.N_FEATURES, 2)), pick.normal(size=(2, 2)))
    bound = np.array([0, 3, 3, 4, 9])
    features = pick.integers(0, q.N_FEATURES, (9, len(q.BINS)))
    labels = q.viterbi(field, features, bound)
    likely, steps, total = q._expectations(field, features, bound)
    want_steps, want_total = np.zeros((2, 2)), 0.0
    for a, b in itertools.pairwise(bound.tolist()):
        ways = list(itertools.product((0, 1), repeat=b - a))
        scores = np.array([_score(field, features[a:b], w) for w in ways])
        if b > a:
            assert tuple(labels[a:b]) == ways[scores.argmax()]
            normal = np.logaddexp.reduce(scores)
            want_total += normal
            for w, s in zip(ways, scores, strict=True):
                for x, y in itertools.pairwise(w):
                    want_steps[x, y] += np.exp(s - normal)
            for t in range(b - a):
                assert np.isclose(likely[a + t, 1], sum(np.exp(s - normal) for w, s in zip(ways, scores, strict=True) if w[t]))
    assert np.allclose(steps, want_steps) and np.isclose(total, want_total)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the given tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    field = q.fit(docs, labels.filter("doc_id % 2 = 0"))
    judged = q.quality(docs, field).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("NOT base_failed")
    wrong = judged.filter("kept <> (quality = 1)").count()
    assert judged.count() > 50 and wrong <= 0.05 * judged.count()


def test_repeated_ids_leave_both_kinds(spark):
    texts = [(0, "# # # = =\n$ $ $ % %")] + [(i, "some plain words that make a sentence, and more of them.\nand another line of words") for i in range(1, 30)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    often = docs.filter("doc_id = 0").crossJoin(spark.range(2 * q.SAMPLE_DOCUMENTS + 10)).select("doc_id", "text")
    labels = spark.createDataFrame([(i, min(i, 1)) for i, _ in texts], "doc_id long, quality int")
    again = labels.filter("doc_id = 0").crossJoin(spark.range(q.SAMPLE_DOCUMENTS)).select("doc_id", "quality")
    want, got = q.fit(docs, labels), q.fit(docs.union(often), labels.union(again))
    assert want.emit.any() and np.array_equal(want.emit, got.emit) and np.array_equal(want.step, got.step)


def test_odd_input(spark, odd_docs, no_docs, tmp_path):
    spark.createDataFrame([(9, 1, 0), (9, None, None), (None, 0, 0), (5, 7, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = q.stage(spark, odd_docs, str(tmp_path))
    assert stage.columns == odd_docs.columns and stage.count() == 3
    assert q.quality(no_docs, q.Field.untrained()).collect() == [] and q.stage(spark, no_docs, str(tmp_path)).collect() == []
    assert q.quality(odd_docs, q.Field.untrained()).columns.count("kept") == 1
