import random

import numpy as np
import pytest
from brute import repeated, sha, windows

from cartloom.llm import induced, op2_suffix_arrays


def expected(texts, window):
    units = [list((t or "").encode()) for t in texts]
    times = windows(units, window)
    for u in units:
        gone = repeated(u, window, times)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        yield len(u), sum(gone), spans, sha(bytes(x for x, g in zip(u, gone, strict=True) if not g))


@pytest.mark.parametrize(("window", "group"), [(40, 64), (40, 1), (7, 2), (400, 12)])
def test_equals_brute_force(docs, rows, window, group, monkeypatch):
    monkeypatch.setattr(op2_suffix_arrays, "GROUP_PIECES", group)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op2_suffix_arrays.remove_repeats(docs, window=window).collect()}
    texts = [r for r in rows if len((r[1] or "").encode()) < 20_000] if window == 7 else rows
    want = dict(zip([r[0] for r in rows], expected([r[1] for r in rows], window), strict=True))
    assert {r[0]: got[r[0]] for r in texts} == {r[0]: want[r[0]] for r in texts}


def test_suffix_arrays_and_common_prefixes():
    pick = np.random.default_rng(0)
    for _ in range(60):
        length = pick.integers(1, 50, pick.integers(1, 7))
        symbols = np.zeros((len(length), length.max()), dtype=np.int64)
        for i, n in enumerate(length):
            symbols[i, : n - 1] = np.resize(pick.integers(1, pick.integers(2, 6), pick.integers(1, 60)), n - 1)
        arrays = induced.suffix_arrays(symbols, length)
        common = induced.permuted_common_prefixes(symbols, length, arrays)
        for i, n in enumerate(length):
            text = symbols[i, :n].tolist()
            order = sorted(range(n), key=lambda p, text=text: text[p:])
            assert arrays[i, :n].tolist() == order
            for a, b in zip(order, order[1:], strict=False):
                same = 0
                while max(a, b) + same < n and text[a + same] == text[b + same]:
                    same += 1
                assert common[i, b] == same


def test_odd_input(odd_docs, no_docs):
    out = op2_suffix_arrays.remove_repeats(odd_docs, window=20, with_text=True)
    got = sorted((r.doc_id is None, r.n_removed, r.n_bytes) for r in out.collect())
    size = len(odd_docs.first().text)
    assert got == [(False, 0, 0), (False, 0, 0), (False, size, size), (True, size, size), (True, size, size)]
    assert set(odd_docs.columns) <= set(out.columns)
    assert op2_suffix_arrays.remove_repeats(no_docs).collect() == []


def test_planted_passages_go_from_400_bytes_on(spark, tmp_path):
    pick = random.Random(5)
    words = lambda n: " ".join("".join(pick.choices("abcdefghijklmnop", k=pick.randint(2, 7))) for _ in range(n))
    rows, want = [], {}
    # size, neighbours in the two documents, bytes that go
    cases = [(340, "<[", ">]", 0), (399, "<[", ">]", 0), (400, "<[", ">]", 400), (401, "<[", ">]", 401), (700, "<[", ">]", 700), (398, "||", "||", 400)]
    for size, left, right, gone in cases:
        passage = words(200)[:size]
        assert len(passage) == size and len(passage.split()) > 50
        for k, (a, b) in enumerate(zip(left, right, strict=True)):
            # with equal neighbours, the bytes beyond them differ
            text = f"{words(40)}{'()'[k]}{a}{passage}{b}{'{}'[k]}{words(40)}"
            want[len(rows)] = (len(text), gone, int(gone > 0))
            rows.append((len(rows), text))
    for _ in range(8):
        text = words(150)
        want[len(rows)] = (len(text), 0, 0)
        rows.append((len(rows), text))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = op2_suffix_arrays.op2_repeated_bytes(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in got} == want
