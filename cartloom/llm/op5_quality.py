"""Quality rules: base rules on words, then line labelling by a linear-chain conditional random field.

Each line has binned features; the field, trained here on a bounded sample of labelled documents by forward-backward gradients, gives
them weights for the labels content and boilerplate and for the step from line to line. Viterbi decoding labels the lines of every text,
and a document is kept where enough of its words are in content lines.

Defined cases: a null text has no words, so it fails the base rules; lines without a word take part in the chain but weigh nothing;
without labelled documents of both kinds the field is untrained and every line counts as content; labels that are null or neither 0 nor 1 are
unused; of label rows or documents with the same id and label one is
an example; an empty table gives no rows; input columns named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartloom.llm.buffers import Rolling, Slice, line_spans, mix, slices, words
from cartloom.llm.common import read, replace_columns, seeded

#: The classifier is fitted on so many labelled documents at most, chosen by a seeded digest of their ids.
SAMPLE_DOCUMENTS = 1500
#: Of a training document, so many consecutive lines at most enter the fit; where they begin is drawn over the whole document.
SAMPLE_LINES = 200
SEED = 5
LEAST_WORDS = 10
REPEAT_WINDOW = 5
MOST_REPEATED = 20  # per cent of words
CONTENT_SHARE = 0.5
SYMBOLS = b"#*$%&|<>"
STEPS = 300

_U = np.uint64


def _flags(*chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(b"".join(chars))] = True
    return out


_SYMBOL = _flags(SYMBOLS)
_UPPER = _flags(bytes(range(65, 91)))
_LOWER_OR_WIDE = _flags(bytes(range(97, 123)), bytes(range(128, 256)))
_DIGIT = _flags(b"0123456789")
_STOP = _flags(b".,;:?")
_MARK = _flags(b"!=_{}[]~^\\@+")
_LEADING = np.array([(b & 0xC0) != 0x80 for b in range(256)])

#: Feature name and the upper bounds of its bins; shares are per character or per word of the line.
BINS = {
    "words": (0.5, 1.5, 4.5, 9.5, 19.5, 39.5, 79.5),
    "word_length": (2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 12.0),
    "symbols": (0.001, 0.01, 0.03, 0.08, 0.2),
    "marks": (0.001, 0.01, 0.03, 0.08, 0.2),
    "upper": (0.01, 0.05, 0.15, 0.4, 0.7),
    "digits": (0.001, 0.02, 0.1, 0.3),
    "stops": (0.001, 0.01, 0.02, 0.05, 0.1),
    "distinct": (0.15, 0.3, 0.5, 0.7, 0.85),
    "repeated": (0.001, 0.1, 0.3, 0.6, 0.9),
    "copy": (0.5,),
}
N_FEATURES = sum(len(b) + 1 for b in BINS.values())
_STARTS = np.cumsum([0] + [len(b) + 1 for b in BINS.values()])[:-1]


@dataclass
class Lines:
    """Base counts of each row, and for each line its row, words and active features."""

    base: dict[str, np.ndarray]
    row: np.ndarray
    bound: np.ndarray
    n_words: np.ndarray
    features: np.ndarray


def _sums(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[end] - total[start]


def _first_of_kind(keys: np.ndarray) -> np.ndarray:
    """True where a key appears for the first time."""
    out = np.zeros(len(keys), dtype=bool)
    out[np.unique(keys, return_index=True)[1]] = True
    return out


def measure(part: Slice, rolling: Rolling, word_rolling: Rolling) -> Lines:
    data, n_rows = part.data, len(part.start)
    w = words(part)
    prefix = rolling.prefix(rolling.table[data])
    row_key = mix(np.arange(n_rows, dtype=np.uint64) + _U(1))
    word_key = mix(rolling.spans(prefix, w.start, w.end) + (w.end - w.start).astype(np.uint64))
    # words in windows that are found twice or more in the text
    repeated = np.zeros(len(w.start), dtype=bool)
    if len(w.start) >= REPEAT_WINDOW:
        windows = mix(word_rolling.windows(word_rolling.prefix(word_key), REPEAT_WINDOW))
        inside = np.flatnonzero(w.row[: len(windows)] == w.row[REPEAT_WINDOW - 1 :])
        key = windows[inside] ^ row_key[w.row[inside]]
        order = np.argsort(key)
        equal = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), dtype=bool)
        twice[order[1:][equal]] = twice[order[:-1][equal]] = True
        cover = np.zeros(len(w.start) + 1, dtype=np.int32)
        np.add.at(cover, inside[twice], 1)
        np.add.at(cover, inside[twice] + REPEAT_WINDOW, -1)
        repeated = np.cumsum(cover[:-1]) > 0
    start, end, row, bound = line_spans(part)
    first, last = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
    n_words = last - first
    line_key = mix(rolling.spans(prefix, start, end) + (end - start).astype(np.uint64)) ^ row_key[row]
    some = np.flatnonzero(n_words > 0)
    copy = np.zeros(len(start), dtype=bool)
    copy[some] = ~_first_of_kind(line_key[some])
    inside_word = np.zeros(len(data) + 1, dtype=np.int8)
    inside_word[w.start] += 1
    inside_word[w.end] -= 1
    letters = _LEADING[data] & (np.cumsum(inside_word[:-1], dtype=np.int8) > 0)
    base = {
        "n_words": np.diff(w.bound),
        "word_chars": _sums(letters, part.start, part.end),
        "n_symbols": _sums(_SYMBOL[data], part.start, part.end),
        "n_dup_lines": np.bincount(row[copy], minlength=n_rows),
        "n_repeat_words": _sums(repeated, w.bound[:-1], w.bound[1:]),
    }
    chars, some_words = np.maximum(_sums(letters, start, end), 1), np.maximum(n_words, 1)
    line_of_word = np.repeat(np.arange(len(start)), n_words)
    new_word = np.zeros(len(start), dtype=np.int64)
    in_lines = _ranges(first, n_words)
    if len(in_lines):
        new_word = np.bincount(line_of_word[_first_of_kind(word_key[in_lines] ^ mix(line_of_word.astype(np.uint64) + _U(9)))], minlength=len(start))
    shares = {
        "words": n_words,
        "word_length": chars / some_words,
        "symbols": _sums(_SYMBOL[data], start, end) / chars,
        "marks": _sums(_MARK[data], start, end) / chars,
        "upper": _sums(_UPPER[data], start, end) / chars,
        "digits": _sums(_DIGIT[data], start, end) / chars,
        "stops": _sums(_STOP[data], start, end) / chars,
        "distinct": new_word / some_words,
        "repeated": _sums(repeated, first, last) / some_words,
        "copy": copy,
    }
    features = np.stack([_STARTS[i] + np.searchsorted(BINS[name], shares[name]) for i, name in enumerate(BINS)], axis=1)
    return Lines(base, row, bound, n_words, features.astype(np.int16))


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    total = np.cumsum(count)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(first - (total - count), count)


@dataclass
class Field:
    """Weights of a linear chain with the labels boilerplate (0) and content (1)."""

    emit: np.ndarray  # features x 2
    step: np.ndarray  # label before x label

    @classmethod
    def untrained(cls) -> Field:
        emit = np.zeros((N_FEATURES, 2))
        emit[:, 1] = 1.0
        return cls(emit, np.zeros((2, 2)))

    def scores(self, features: np.ndarray) -> np.ndarray:
        return self.emit[features].sum(axis=1)


def _columns(bound: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The n-th lines of all texts that have one, text order by falling length: (line numbers, how many of the previous go on)."""
    count = np.diff(bound)
    order = np.argsort(-count, kind="stable")
    first, count = bound[:-1][order], count[order]
    for t in range(int(count.max(initial=0))):
        n = int(np.searchsorted(-count, -t, side="left"))
        yield first[:n] + t, n


def viterbi(field: Field, features: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """The likeliest label of every line; ``bound[i]:bound[i + 1]`` are the lines of text i."""
    score = field.scores(features)
    labels = np.zeros(len(score), dtype=np.int8)
    came: list[tuple[np.ndarray, np.ndarray]] = []
    best = np.empty((0, 2))
    finals: list[np.ndarray] = []
    for lines, n in _columns(bound):
        if came:
            finals.append(best[n:])
            through = best[:n, :, None] + field.step[None]
            before = (through[:, 1] > through[:, 0]).astype(np.int8)
            best = np.maximum(through[:, 0], through[:, 1]) + score[lines]
        else:
            before, best = np.zeros((n, 2), dtype=np.int8), score[lines].copy()
        came.append((lines, before))
    if not came:
        return labels
    finals.append(best)
    finals = finals[1:] if len(finals) > len(came) else finals
    label = np.empty(0, dtype=np.int8)
    for (lines, before), ended in zip(reversed(came), reversed(finals), strict=True):
        label = np.concatenate([label, (ended[:, 1] >= ended[:, 0]).astype(np.int8)])
        labels[lines] = label
        label = before[np.arange(len(label)), label]
    return labels


def _expectations(field: Field, features: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Label probabilities of each line, expected label steps, and the sum of the log normalisers."""
    score, columns = field.scores(features), list(_columns(bound))
    total = lambda x: np.logaddexp(x[..., 0], x[..., 1])
    ahead = np.empty_like(score)
    for t, (lines, n) in enumerate(columns):
        ahead[lines] = score[lines] if t == 0 else score[lines] + np.logaddexp(ahead[lines - 1][:, :1] + field.step[0], ahead[lines - 1][:, 1:] + field.step[1])
    behind = np.zeros_like(score)
    steps = np.zeros((2, 2))
    last = bound[1:][np.diff(bound) > 0] - 1
    ends = total(ahead[last])
    normal = np.empty(len(score))
    normal[_ranges(bound[:-1], np.diff(bound))] = np.repeat(ends, np.diff(bound)[np.diff(bound) > 0])
    for t in range(len(columns) - 1, 0, -1):
        lines = columns[t][0]
        onward = score[lines] + behind[lines]
        behind[lines - 1] = np.logaddexp(field.step[:, 0] + onward[:, :1], field.step[:, 1] + onward[:, 1:])
        both = ahead[lines - 1][:, :, None] + field.step[None] + onward[:, None, :] - normal[lines][:, None, None]
        steps += np.exp(both).sum(axis=0)
    return np.exp(ahead + behind - normal[:, None]), steps, float(ends.sum())


def train(features: np.ndarray, bound: np.ndarray, labels: np.ndarray, steps: int = STEPS, penalty: float = 1.0) -> Field:
    """Maximises the conditional likelihood of the line labels with a Gaussian prior, by Adam from zero weights."""
    field = Field(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)))
    goal = np.zeros((N_FEATURES, 2))
    for label in (0, 1):
        goal[:, label] = np.bincount(features[labels == label].ravel(), minlength=N_FEATURES)
    inner = np.ones(len(labels), dtype=bool)
    inner[bound[:-1][np.diff(bound) > 0]] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[at - 1], labels[at]), 1)
    moments = [np.zeros((N_FEATURES, 2)), np.zeros((2, 2)), np.zeros((N_FEATURES, 2)), np.zeros((2, 2))]
    scale = 1.0 / max(1, len(labels))
    for i in range(1, steps + 1):
        likely, moved, _ = _expectations(field, features, bound)
        expected = np.stack([np.bincount(features.ravel(), weights=np.repeat(likely[:, label], features.shape[1]), minlength=N_FEATURES) for label in (0, 1)], axis=1)
        slopes = [(goal - expected - penalty * field.emit) * scale, (seen - moved - penalty * field.step) * scale]
        for k, (weights, slope) in enumerate(zip((field.emit, field.step), slopes, strict=True)):
            moments[k] = 0.9 * moments[k] + 0.1 * slope
            moments[k + 2] = 0.99 * moments[k + 2] + 0.01 * slope * slope
            weights += 0.1 * (moments[k] / (1 - 0.9**i)) / (np.sqrt(moments[k + 2] / (1 - 0.99**i)) + 1e-8)
    return field


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Field:
    """Fits the field on SAMPLE_DOCUMENTS labelled documents at most. A line takes the label of its document: the lines that documents of both
    kinds share come out undecided, those that mark a kind don't."""
    sample = labels.filter(F.col("quality").isin(0, 1)).select(F.col(id_column).alias("l_id"), F.col("quality").cast("int").alias("l_quality")).filter("l_id IS NOT NULL").distinct()
    # bounded by SAMPLE_DOCUMENTS, so the broadcast is as well
    sample = sample.orderBy(seeded("l_id", SEED), "l_quality").limit(SAMPLE_DOCUMENTS)
    chosen = docs.join(F.broadcast(sample), docs[id_column] == F.col("l_id")).select("l_quality", docs[text_column].cast("binary").alias("t"), "l_id", seeded("l_id", SEED + 1).alias("place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, word_rolling = Rolling(1), Rolling(2)
        for batch in batches:
            for part in slices(batch.column(1)):
                lines = measure(part, rolling, word_rolling)
                ids = np.asarray(batch.column(3).slice(part.first, len(part.start)))
                found = []
                for a, b, place in zip(lines.bound[:-1].tolist(), lines.bound[1:].tolist(), ids.tolist(), strict=True):
                    first = a + place % max(1, b - a - SAMPLE_LINES + 1)
                    found.append(lines.features[first : min(b, first + SAMPLE_LINES)].tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, len(found)), pa.array(found, pa.binary()), batch.column(2).slice(part.first, len(found))], ["l_quality", "features", "l_id"])

    # one row per id and label, so repeated ids bring no more rows than the sample has and crowd out no kind
    examples = chosen.mapInArrow(run, T.StructType([T.StructField("l_quality", T.IntegerType()), T.StructField("features", T.BinaryType()), T.StructField("l_id", sample.schema["l_id"].dataType)]))
    rows = examples.groupBy("l_id", "l_quality").agg(F.min("features").alias("features")).orderBy("l_quality", "features").collect()
    if len({r["l_quality"] for r in rows}) < 2:
        return Field.untrained()
    parts = [np.frombuffer(r["features"], dtype=np.int16).reshape(-1, len(BINS)).astype(np.int64) for r in rows]
    size = np.array([len(p) for p in parts])
    return train(np.concatenate(parts), np.append(0, np.cumsum(size)), np.repeat([r["l_quality"] for r in rows], size))


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality(docs: DataFrame, field: Field, text_column: str = "text") -> DataFrame:
    """The documents with their base counts, ``base_failed``, ``content_words`` and ``kept``."""
    new = [*_COUNTS, "content_words"]
    kept = [c for c in docs.columns if c.lower() not in new]
    source = docs.select(*[docs[c] for c in kept], docs[text_column].cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, word_rolling = Rolling(1), Rolling(2)
        for batch in batches:
            for part in slices(batch.column(len(kept))):
                lines = measure(part, rolling, word_rolling)
                content = viterbi(field, lines.features, lines.bound) * lines.n_words
                counts = [*(lines.base[c] for c in _COUNTS), np.bincount(lines.row, weights=content, minlength=len(part.start))]
                rows = batch.slice(part.first, len(part.start))
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(kept)], *(pa.array(c.astype(np.int64)) for c in counts)], [*kept, *new])

    schema = T.StructType([*source.schema.fields[: len(kept)], *(T.StructField(c, T.LongType()) for c in new)])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = replace_columns(source.mapInArrow(run, schema), {"base_failed": failed})
    return replace_columns(out, {"kept": ~F.col("base_failed") & (F.col("content_words") >= CONTENT_SHARE * F.col("n_words"))})


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass."""
    plain = [f"column_{i}" for i in range(len(docs.columns))]
    judged = quality(docs.toDF(*plain), fit(docs, read(spark, sf_dir, "labels")), plain[docs.columns.index("text")])
    return judged.filter("kept").select(*plain).toDF(*docs.columns)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs, fit(docs, read(spark, sf_dir, "labels"))).drop("text")


QUERIES = {"op5_quality_rules": op5_quality_rules}
ORACLE: dict[str, str] = {}
