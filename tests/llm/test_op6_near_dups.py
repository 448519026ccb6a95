import time

import numpy as np
import pytest
from brute import near_classes, shingles

from cartloom.llm import op6_near_dups, sketches


@pytest.mark.parametrize(("width", "percent", "block"), [(3, 85, 128), (5, 80, 4)])
def test_equals_brute_force(docs, rows, width, percent, block, monkeypatch):
    monkeypatch.setattr(op6_near_dups, "SKETCH_BLOCK", block)
    monkeypatch.setattr(op6_near_dups, "SET_BLOCK", block)
    got = {r.id: (r.n_shingles, r.component_id, r.kept) for r in op6_near_dups.near_duplicates(docs, width=width, percent=percent).collect()}
    texts = [r[1] for r in rows]
    for row, name in zip(rows, near_classes(texts, width, percent), strict=True):
        assert got[row[0]] == (len(shingles(row[1], width)), name, name == row[0])


def test_estimate_is_near_the_similarity():
    pick = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.85, 0.97):
        whole = np.unique(pick.integers(0, 2**64, 4000, dtype=np.uint64))
        common = int(len(whole) * share)
        side = (len(whole) - common) // 2
        one, two = np.sort(whole[: common + side]), np.sort(np.concatenate([whole[:common], whole[common + side :]]))
        table = sketches.registers([one, two])
        assert abs(sketches.estimate(table[0], table[1], len(one), len(two)) - common / len(whole)) < 0.15


def test_groups_equal_all_pairs():
    """Comparing members of different groups only finds the same components."""
    pick = np.random.default_rng(1)
    for n, share in ((40, 0.03), (60, 0.2), (7, 0.0), (30, 1.0)):
        like = pick.random((n, n)) < share
        like |= like.T
        compared = 0

        def similar(i, others, like=like):
            nonlocal compared
            compared += len(others)
            return like[i, others]

        for first in (0, n // 3):
            compared = 0
            before = np.arange(n) if not first else np.where(np.arange(n) < 3, 0, np.arange(n))
            got = op6_near_dups._grouped(n, similar, before, first)
            want = before.copy()
            for i, j in zip(*np.nonzero(like), strict=True):
                if i < j and (not first or i < first <= j):
                    want[want == want[j]] = want[i]
            assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(n) for j in range(n))
            if share == 1.0 and not first:
                assert compared < n


def test_thousands_of_near_copies(spark, rows):
    """Each copy differs from one text in a word, so all are linked with it; the other texts keep their classes."""
    base = [f"word{i}" for i in range(150)]
    copies = [" ".join([*base[: i % 150], f"new{i}", *base[i % 150 + 1 :]]) for i in range(5000)]
    texts = [r[1] for r in rows]
    every = [*texts, *copies, *copies[:700]]
    started = time.time()
    frame = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string").repartition(8)
    got = {r.id: r.component_id for r in op6_near_dups.near_duplicates(frame, width=3, percent=85).collect()}
    assert time.time() - started < 200
    assert [got[i] for i in range(len(texts))] == near_classes(texts, 3, 85)
    assert {got[i] for i in range(len(texts), len(every))} == {len(texts)}


def test_odd_input(spark, odd_docs, no_docs):
    got = sorted(((r.id, r.n_shingles, r.component_id, r.kept) for r in op6_near_dups.near_duplicates(odd_docs).collect()), key=str)
    assert got == sorted([(None, 10, 9, False), (None, 10, 9, False), (9, 10, 9, True), (5, 0, 5, True), (5, 0, 5, True)], key=str)
    assert op6_near_dups.near_duplicates(no_docs).collect() == []
    stage = op6_near_dups.stage(spark, odd_docs, "")
    assert stage.columns == odd_docs.columns
    assert sorted((r.doc_id, r.text is None) for r in stage.collect()) == [(5, True), (5, True), (9, False)]
    assert op6_near_dups.stage(spark, no_docs, "").collect() == []
