import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cartloom.llm import op13_token_files as t
from cartloom.llm import range_coder, word_ids

PATH = public_tokenizers.path("word_bpe_49k.json")


def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return tokenizer


def expected(rows):
    """Plain version: the library on whole texts, in order of id, nulls last."""
    out, start = [], 0
    tokenizer = library()
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_query_equals_the_library(spark, rows, tmp_path):
    texts = [(3 * r[0] - 40, r[1]) for r in rows]
    texts += [(100_000, "<|endoftext|> and <|startoftext|>\x1cx"), (None, "no id"), (100_001, "long words " * 60_000)]
    frame = spark.createDataFrame([(*r, "clash") for r in texts], "doc_id long, text string, file string")
    frame.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    out = t.op13_token_files(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, out.collect()), key=lambda r: r[1]) == expected(texts)


def test_repeated_ids_and_empty_tables(spark, tmp_path):
    rows = [(7, "the same words"), (7, "other words than these"), (7, "the same words"), (None, None), (None, "x"), (-2, "")]
    t.write_token_files(spark.createDataFrame(rows, "ID long, body string"), f"{tmp_path}/some", "ID", "body")
    found = t.token_index(t.read_token_files(spark, f"{tmp_path}/some")).orderBy("start").collect()
    assert [r.doc_id for r in found] == [-2, 7, 7, 7, None, None]
    assert [r.start for r in found] == np.append(0, np.cumsum([r.n_tokens for r in found])[:-1]).tolist()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in found if r.doc_id) == sorted((r[0], *r[2:]) for r in expected(rows) if r[0])
    t.write_token_files(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/none")
    assert t.token_index(t.read_token_files(spark, f"{tmp_path}/none")).collect() == []


@pytest.mark.parametrize("vocabulary", [2, 300, 49_408, 1 << 20])
def test_blocks_round_trip(vocabulary):
    pick = np.random.default_rng(vocabulary)
    sizes = [0, 1, 2, 4096, 17, 300, 4095, 1000]
    blocks = [pick.integers(0, vocabulary, n) for n in sizes]
    blocks += [np.full(4096, vocabulary - 1), np.tile([0, 1, vocabulary - 1], 1000), (pick.zipf(1.3, 4096) - 1) % vocabulary, np.arange(4096) % vocabulary]
    coded = range_coder.encode(blocks, vocabulary)
    for block, back in zip(blocks, range_coder.decode(coded, [len(b) for b in blocks], vocabulary), strict=True):
        assert block.tolist() == back.tolist()
    # every block decodes by itself
    assert range_coder.decode([coded[4]], [17], vocabulary)[0].tolist() == blocks[4].tolist()
    assert len(coded[8]) < 200


def test_counted_frequencies_shorten_the_code():
    pick = np.random.default_rng(1)
    ids = (pick.zipf(1.5, 40_000) * 7 - 1) % 49_408
    blocks = [ids[i : i + 3000] for i in range(0, len(ids), 3000)]
    table = range_coder.frequencies(ids, 49_408)
    assert set(np.flatnonzero(table)) == set(ids)
    coded = range_coder.encode(blocks, 49_408, table)
    back = range_coder.decode(coded, [len(b) for b in blocks], 49_408, table)
    assert np.concatenate(back).tolist() == ids.tolist()
    assert sum(map(len, coded)) < 0.8 * sum(map(len, range_coder.encode(blocks, 49_408)))
    # an adversarial order changes nothing, and one id alone costs next to nothing
    for b in (np.sort(ids)[:4096], np.full(4096, 9)):
        table = range_coder.frequencies(b, 300_000)
        assert range_coder.decode(range_coder.encode([b], 300_000, table), [len(b)], 300_000, table)[0].tolist() == b.tolist()


def test_later_tasks_of_a_process_know_the_words():
    with open(PATH, "rb") as f:
        content = f.read()
    encoder = word_ids.kept(content)
    first = encoder.encode([b"the same words, twice", b"", "ÉTÉ 日本 été".encode()])
    words, pieces = len(encoder.words), len(encoder.pieces)
    assert word_ids.kept(bytes(bytearray(content))) is encoder
    again = encoder.encode([b"twice words,  the", "日本".encode()])
    assert (len(encoder.words), len(encoder.pieces)) == (words, pieces)
    assert [x.tolist() for x in first] == [x.tolist() for x in word_ids.WordIds(content).encode([b"the same words, twice", b"", "ÉTÉ 日本 été".encode()])]
    assert again[0].tolist() == [i for x in ("twice words,  the", "日本") for i in library().encode(x, add_special_tokens=False).ids]


def test_damaged_files_are_refused():
    writer = t.FileWriter(4, 300)
    records = [*writer.add(np.array([5, 6]), np.array([False, True]), np.array([3, 1]), np.array([7, 8, 9, 10])), *writer.end()]
    whole = b"".join(r + b"\n" for r in records)
    f = t.FileReader(whole)
    assert f.ids(t.decoded([f])).tolist() == [7, 8, 9, 10]
    at = whole.index(b"B") + 13
    f = t.FileReader(whole[:at] + bytes([whole[at] ^ 0x55]) + whole[at + 1 :])
    with pytest.raises(ValueError, match="checksum"):
        f.ids(t.decoded([f]))
    for cut in (len(whole) - 1, len(whole) - 40, 20):
        with pytest.raises((ValueError, struct.error)):
            t.FileReader(whole[:cut])


def test_word_by_word_equals_the_library():
    pick = random.Random(0)
    letters = "aAbZ'sStTrRvVeEmMlLdD019 .,!-_\t\n\x0b\x0c\r\x1c\x85\xa0éÉßÿÀ×÷ªº²½µ日本ΣσςİıſĶ́́ —“”😀𝒳<|endoftext|>ǅ"
    texts = ["".join(pick.choice(letters) for _ in range(pick.randint(0, 60))) for _ in range(8000)]
    with open(PATH, "rb") as f:
        encoder = word_ids.WordIds(f.read())
    assert encoder.cut
    want = [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]
    for cut in (True, False):
        encoder.cut = cut
        ids, sizes = encoder.encode([x.encode() for x in texts])
        assert sizes.tolist() == [len(x) for x in want]
        assert ids.tolist() == [i for x in want for i in x]
