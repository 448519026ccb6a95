import base64
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken
from brute import WORD, base_rules, kept_lines, mixed, near_classes

import corpus_pipeline
from cartloom.llm import op5_quality as q
from cartloom.llm.buffers import Rolling, Slice

CONTENT = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, CONTENT.splitlines())}, special_tokens={})


def content_words(field, text):
    """Words in lines that the likeliest label sequence calls content, by plain dynamic programming."""
    data = (text or "").encode()
    lines = q.measure(Slice(0, np.frombuffer(data, dtype=np.uint8), np.array([0]), np.array([len(data)])), Rolling(1), Rolling(2))
    best = [(0.0, []), (0.0, [])]
    for t, features in enumerate(lines.features):
        score = field.emit[features].sum(axis=0)
        best = [max((best[a][0] + (field.step[a, b] if t else 0) + score[b], [*best[a][1], b]) for a in (0, 1)) for b in (0, 1)]
    return sum(n for n, label in zip(lines.n_words, max(best)[1], strict=True) if label)


def test_run_equals_brute_force(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 0 if i % 7 == 0 else 1, 0) for i, *_ in rows if i % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars, tuple(r.ids), r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    field = q.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    left = []
    for i, text, lang, source, n_chars in rows:
        n_words, *_, n_repeat = base_rules(text)
        if n_words >= 10 and 100 * n_repeat <= 20 * n_words and content_words(field, text) >= 0.5 * n_words:
            left.append((i, text, lang, source, n_chars))
    cleaned = kept_lines([r[1] for r in left])
    left = [(i, kept, lang, source, len(kept) if removed else n) for (i, _, lang, source, n), (kept, removed, _) in zip(left, cleaned, strict=True) if not removed or WORD.search(kept)]
    assert len(left) < len(cleaned)
    names = near_classes([r[1] for r in left], 5, 80)
    left = [r for k, (r, name) in enumerate(zip(left, names, strict=True)) if k == name]
    chosen = mixed([(r[0], r[3], len(WORD.findall(r[1]))) for r in left])
    want = Counter()
    for r, (_, _, copies, _) in zip(left, chosen, strict=True):
        ids = tuple(LIBRARY.encode_ordinary(r[1]))
        want[(*r, ids, len(ids))] += copies
    assert got == +want and len(left) > 20


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash_near_dedup", "mix_sources", "bpe_encode"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.collect() == []
