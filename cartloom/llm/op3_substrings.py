"""Removal of repeated token windows by Rabin-Karp hashes counted in Spark.

The hash of every window of ``WINDOW`` words is taken from running sums. Windows whose anchor repeats (``cartloom.llm.repeats``) are counted by their
128-bit hash in Spark, those that occur twice or more are marked, and marked windows merge into maximal removal intervals. Windows whose
anchor is unique occur once and aren't shuffled.

Defined cases: a null text has no words; a text of fewer words than a window loses nothing; a window repeats if it starts anywhere else, in the
same document too; of repeated rows each counts as a document; an empty table gives no rows; input columns named like an output column
are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom.llm.buffers import Rolling, Slice, mix, slices, words
from cartloom.llm.common import lookup_join, own_columns, read, replace_columns
from cartloom.llm.repeats import Unit, covered, distinct_texts, marks_of_texts, repeated_pieces, with_digest

WINDOW = 35
_BYTES, _WORDS, _BYTES_2, _WORDS_2 = (Rolling(seed) for seed in (11, 12, 13, 14))


def _spans(part: Slice):
    w = words(part)
    key = mix(_BYTES.spans(_BYTES.prefix(_BYTES.table[part.data]), w.start, w.end) + (w.end - w.start).astype(np.uint64))
    return w.row, w.start, w.end, _WORDS.prefix(key), _WORDS


def word_unit(window: int) -> Unit:
    """Grams of a third of a window: an anchor for every twelfth window, and few chance anchors."""
    return Unit(window, max(1, window // 3 + 1), _spans)


def window_counts(pieces: DataFrame, window: int) -> DataFrame:
    """``piece_id``, ``n`` and ``offsets`` of the windows that occur at least twice, for the pieces that have any (null: all)."""
    distinct = pieces.groupBy("piece").agg(F.sum("copies").alias("n")).withColumn("piece_id", F.unhex(F.md5("piece")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(0)):
                w = words(part)
                hashes = []
                for byte_level, word_level in ((_BYTES, _WORDS), (_BYTES_2, _WORDS_2)):
                    key = mix(byte_level.spans(byte_level.prefix(byte_level.table[part.data]), w.start, w.end) + (w.end - w.start).astype(np.uint64))
                    hashes.append(mix(word_level.windows(word_level.prefix(key), window)))
                inside = np.flatnonzero(w.row[: len(hashes[0])] == w.row[window - 1 :])
                owner = w.row[inside]
                who = pa.array(owner + part.first)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashes[0][inside].view(np.int64)),
                        pa.array(hashes[1][inside].view(np.int64)),
                        pa.array((inside - w.bound[owner]).astype(np.int32)),
                        batch.column(1).take(who),
                        batch.column(2).take(who),
                    ],
                    ["hash_1", "hash_2", "offset", "n", "piece_id"],
                )

    windows = distinct.select("piece", "n", "piece_id").mapInArrow(run, "hash_1 long, hash_2 long, offset int, n long, piece_id binary")
    counted = windows.groupBy("hash_1", "hash_2").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows_")).filter("total > 1")
    single = lookup_join(windows.filter("n = 1").select("hash_1", "hash_2", "offset", "piece_id"), counted, ["hash_1", "hash_2"], "rows_")
    some = single.groupBy("piece_id").agg(F.lit(1).cast("long").alias("n"), F.collect_list("offset").alias("offsets"))
    whole = distinct.filter("n > 1").select("piece_id", "n", F.lit(None).cast("array<int>").alias("offsets"))
    return some.unionByName(whole)


def remove_repeats(docs: DataFrame, text_column: str = "text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """The documents with ``n_words``, ``n_removed``, ``kept_sha256`` and, if asked for, ``kept_text`` (kept words joined by a space)."""
    (digest,) = own_columns(docs, "digest_")
    keyed = with_digest(docs, F.col(text_column), digest)
    texts = distinct_texts(keyed, F.col(text_column), digest)
    pieces = repeated_pieces(texts, word_unit(window))
    marks = marks_of_texts(pieces, window_counts(pieces, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies = np.asarray(batch.column(2))
            for part in slices(batch.column(1)):
                w = words(part)
                rows = slice(part.first, part.first + len(part.start))
                n_words = np.diff(w.bound)
                gone = covered(part, n_words, copies[rows], batch.column(3)[rows].to_pylist(), window)
                texts, data = [], part.data.tobytes()
                for a, b in zip(w.bound[:-1], w.bound[1:], strict=True):
                    keep = np.flatnonzero(~gone[a:b]) + a
                    texts.append(b" ".join([data[x:y] for x, y in zip(w.start[keep].tolist(), w.end[keep].tolist(), strict=True)]))
                removed = n_words - np.array([int((~gone[a:b]).sum()) for a, b in zip(w.bound[:-1], w.bound[1:], strict=True)], dtype=np.int64)
                out = [
                    batch.column(0).slice(part.first, len(texts)),
                    batch.column(2).slice(part.first, len(texts)),
                    pa.array(n_words.astype(np.int64)),
                    pa.array(removed.astype(np.int64)),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                ]
                names = ["digest", "copies", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    out.append(pa.array([t.decode("utf-8", "replace") for t in texts], pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(out, names)

    schema = "digest binary, copies long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    results = texts.join(marks, "digest", "left").select("digest", "text", "copies", "marks").mapInArrow(run, schema)
    values = [c for c in results.columns if c not in ("digest", "copies")]
    (out,) = own_columns(keyed, "out_")
    results = results.select(F.col("digest").alias(digest), F.struct(*values).alias(out), F.col("copies").alias("weight_"))
    back = lookup_join(keyed, results, [digest], "weight_", "left").drop("weight_")
    return replace_columns(back, {v: F.col(out)[v] for v in values}).drop(digest, out)


def op3_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).drop("text")


QUERIES = {"op3_repeated_windows": op3_repeated_windows}
ORACLE = {
    "op3_repeated_windows": r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT r, p, md5(array_to_string(w[p:p + 34], ' ')) AS h FROM d, LATERAL (SELECT unnest(range(1, len(w) - 33)) AS p)),
hits AS MATERIALIZED (
  SELECT r, p FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1)),
gone AS MATERIALIZED (SELECT DISTINCT r, unnest(range(p, p + 35)) AS p FROM hits),
left_over AS (
  SELECT d.r, string_agg(d.w[i.p], ' ' ORDER BY i.p) AS kept, count(*) AS n
  FROM d, LATERAL (SELECT unnest(range(1, len(d.w) + 1)) AS p) i LEFT JOIN gone ON gone.r = d.r AND gone.p = i.p
  WHERE gone.r IS NULL GROUP BY d.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (r)"""
}
