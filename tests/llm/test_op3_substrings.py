import pytest
from brute import WORD, repeated, sha, windows

from cartloom.llm import op3_substrings


@pytest.mark.parametrize("window", [35, 6, 1])
def test_equals_brute_force(docs, rows, window):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op3_substrings.remove_repeats(docs, window=window).collect()}
    texts = [WORD.findall(r[1] or "") for r in rows]
    times = windows(texts, window)
    for row, words in zip(rows, texts, strict=True):
        gone = repeated(words, window, times)
        assert got[row[0]] == (len(words), sum(gone), sha(" ".join(w for w, g in zip(words, gone, strict=True) if not g)))


def test_odd_input(odd_docs, no_docs):
    out = op3_substrings.remove_repeats(odd_docs, window=3, with_text=True)
    assert sorted((r.doc_id is None, r.n_removed, r.kept_text) for r in out.collect()) == [(False, 0, ""), (False, 0, ""), (False, 14, ""), (True, 14, ""), (True, 14, "")]
    assert out.columns.count("n_words") == 1
    assert op3_substrings.remove_repeats(no_docs).collect() == []
