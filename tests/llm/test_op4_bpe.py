import base64
import hashlib
import random

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from cartloom.llm import op4_bpe

CONTENT = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, CONTENT.splitlines())}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def odd_texts():
    texts = ["", " ", "  ", "a  b", "a \n b", "\n\n x", "it's  we'll 'S", "x\x1c y\x1c\x1cz \x1cq", "a" * 5000, "\t\tx\n \n", "日本語 テキスト 😀😀", "12345 ½ ²", "\x85 x", "' 's 't", " \xa0x"]
    pick = random.Random(1)
    return texts + ["".join(pick.choice("ab 'stl\n\t\x1c\xa0 éß1²-!日😀  ") for _ in range(pick.randint(0, 40))) for _ in range(1500)]


def test_query_equals_the_library(spark, tmp_path):
    texts = [*odd_texts(), None, None]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "twice"), (None, "twice")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op4_bpe.op4_bpe_roundtrip(spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, t in rows:
        ids = LIBRARY.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_clashing_columns_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([("a b", "x", 1), (None, None, None)], "text string, Ids string, decoded int")
    out = op4_bpe.decode(op4_bpe.encode(docs))
    assert out.columns == ["text", "ids", "decoded"]
    assert sorted(bytes(r.decoded) for r in out.collect()) == [b"", b"a b"]
    assert op4_bpe.decode(op4_bpe.encode(docs.limit(0))).collect() == []
    assert op4_bpe.decode(spark.range(1).select(F.lit(None).cast("array<int>").alias("ids"))).first().decoded is None


def test_a_pair_that_comes_late_is_merged_first():
    # "bc" merges before "abc" can, and then a lower rank appears
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"bc": 257, b"cabc": 258, b"xx": 259, b"xxabc": 260}
    library = tiktoken.Encoding("small", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    vocabulary = op4_bpe.Vocabulary(ranks, public_tokenizers.PATTERN)
    pick = random.Random(2)
    encoder = op4_bpe.Encoder(vocabulary)
    texts = ["".join(pick.choice("abcx ") for _ in range(pick.randint(0, 30))) for _ in range(500)]
    encoder.learn(texts)
    for t in texts:
        ids = encoder.encode(t)
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == library.encode_ordinary(t)
