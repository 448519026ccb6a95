import random
import re
import zlib

import numpy as np
import pytest
from brute import sha

from cartloom.llm import op12_periodic_runs as t

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least=6, exponent=4):
    """Every maximal stretch that equals itself shifted by q, unless a smaller period does it as well."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, m, q) for (s, m), q in found.items())


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    shape = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return doc_id, len(runs), *shape, sha(listed), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def numbers(words):
    index = {}
    return np.array([index.setdefault(w, len(index)) for w in words], dtype=np.int64)


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (1, 3), (9, 3), (30, 4), (6, 7)])
def test_runs_equal_the_plain_search(least, exponent):
    pick = random.Random(least)
    docs = []
    for _ in range(300):
        alphabet = "ab" if pick.random() < 0.5 else "abcdefgh"
        doc = [pick.choice(alphabet) for _ in range(pick.randint(0, 40))]
        for _ in range(pick.randint(0, 3)):
            unit = [pick.choice(alphabet) for _ in range(pick.randint(1, 9))]
            doc += (unit * 12)[: pick.randint(0, 12 * len(unit))] + [pick.choice(alphabet)] * pick.randint(0, 2)
        docs.append(doc)
    docs += [["x"] * n for n in (0, 1, 5, 6, 200)]
    whole = numbers([w for d in docs for w in d])
    bound = np.append(0, np.cumsum([len(d) for d in docs]))
    start, length, period = t.periodic_runs(whole, bound, least, exponent)
    got = [(int(s), int(m), int(q)) for s, m, q in zip(start, length, period, strict=True)]
    want = [(s + int(bound[i]), m, q) for i, d in enumerate(docs) for s, m, q in plain_runs(d, least, exponent)]
    assert got == want


def test_query_equals_brute_force(spark, rows, tmp_path):
    pick = random.Random(5)
    texts = [r[:2] for r in rows]
    for i in range(400):
        unit = " ".join(pick.choice(["ha", "hä", "HA", "日本", "b\x1cc"]) for _ in range(pick.randint(1, 7)))
        texts.append((1000 + i, " lead\n" * pick.randint(0, 3) + "\t".join([unit] * pick.randint(1, 9)) + " tail" * pick.randint(0, 7)))
    texts += [(None, "a a a a a a a"), (None, None), (5000, "w " * 3000), (5000, "w " * 3000)]
    frame = spark.createDataFrame([(*r, 1) for r in texts], "doc_id long, text string, RUNS int")
    frame.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    out = t.op12_periodic_runs(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got, want = (sorted(map(tuple, x), key=str) for x in (out.collect(), [expected(*r) for r in texts]))
    assert got == want
    assert sum(r[1] > 0 for r in want) > 100


def test_nulls_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([("a a a a a a b", 1, "x"), (None, None, None), ("", 2, "y")], "text string, Runs int, n_words string")
    out = t.find_runs(docs)
    assert out.columns == ["text", "n_words", "runs", "collapsed"]
    got = {r.text: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()}
    assert got == {"a a a a a a b": (7, [(0, 6, 1)], "a b"), None: (0, [], None), "": (0, [], "")}
    assert t.find_runs(docs.limit(0)).collect() == []
