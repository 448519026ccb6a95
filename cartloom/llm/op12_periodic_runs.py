"""Maximal periodic runs of words, by seeds and extension along diagonals.

A run of period q and at least ``EXPONENT`` periods agrees with itself, shifted by q, in (EXPONENT - 1) * q words at least. So for the lags
from 2**j to 2**(j+1) - 1 the grams of (EXPONENT - 1) * 2**j words are indexed, the least overlap that any of these lags guarantees; lag 1
gets the grams that the least length guarantees. Neighbouring occurrences of a gram in the same document are a seed on the diagonal of their
distance; a gram is no shorter than the lag, so inside a run its next occurrence is just the smallest period away. Seeds of a lag are taken
in order, those within the furthest place that the lag has covered are passed over, and the rest are extended word by word to both
sides. Grams get exact numbers by doubling (a gram is two overlapping shorter ones), only where the shorter ones occur twice.

Everything is within a document, so no shuffle is needed. A word is dropped where a run repeats it: after the run's first period.

Defined cases: a null text has no words and stays null, without runs; texts are read whole; rows are documents of their own, repeated ones
included; an empty table gives no rows; input columns named like an output column are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartloom.llm.buffers import slices
from cartloom.llm.common import WORD, read

LEAST_LENGTH = 6
EXPONENT = 4


def _numbered(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """A number for each pair, the same for equal pairs."""
    return np.unique(one << np.int64(32) | two, return_inverse=True)[1].astype(np.int64)


class _Grams:
    """Grams of one length that occur at least twice in their document: positions, ascending, and numbers."""

    def __init__(self, size: int, at: np.ndarray, number: np.ndarray):
        times = np.bincount(number, minlength=1)[number] > 1 if len(number) else np.empty(0, dtype=bool)
        self.size, self.at = size, at[times]
        self.number = number[times]

    def longer(self, size: int) -> _Grams:
        """Grams of at most twice the size; none is left out that could occur twice."""
        shift = size - self.size
        where = np.searchsorted(self.at, self.at + shift)
        both = np.flatnonzero(where < len(self.at))
        both = both[self.at[where[both]] == self.at[both] + shift]
        return _Grams(size, self.at[both], _numbered(self.number[both], self.number[where[both]]))

    def seeds(self, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Lag and position of neighbouring occurrences whose distance lies between the bounds, by lag and position."""
        order = np.argsort(self.number, kind="stable")
        at, number = self.at[order], self.number[order]
        lag = np.diff(at)
        found = np.flatnonzero((number[1:] == number[:-1]) & (lag >= least) & (lag <= most))
        lag, at = lag[found], at[found]
        order = np.lexsort((at, lag))
        return lag[order], at[order]


def _extended(word: np.ndarray, lag: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The maximal stretches around the seeds in which words equal those a lag later: begin and end."""
    begin, end = at.copy(), at + size
    for edge, step, look in ((begin, -1, -1), (end, 1, 0)):
        going = np.arange(len(at))
        while len(going):
            here = edge[going] + look
            inside = (here >= 0) & (here + lag[going] < len(word))
            going, here = going[inside], here[inside]
            same = word[here] == word[here + lag[going]]
            going = going[same]
            edge[going] += step
    return begin, end


def periodic_runs(word: np.ndarray, bound: np.ndarray, least_length: int = LEAST_LENGTH, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs of at least ``least_length`` words and ``exponent`` (3 at least) periods, by start and period.

    ``word`` numbers the words of all documents, one after another; document i has those from ``bound[i]`` to ``bound[i + 1]``.
    """
    if exponent < 3:
        raise ValueError("grams as long as the lag need runs of three periods at least")
    # a word of its own behind every document keeps stretches inside
    n_docs = len(bound) - 1
    row = np.repeat(np.arange(n_docs), np.diff(bound))
    spaced = np.full(len(word) + n_docs, -1, dtype=np.int64)
    spaced[np.arange(len(word)) + row] = word
    fence = bound[1:] + np.arange(n_docs)
    spaced[fence] = -2 - np.arange(n_docs)
    at = np.flatnonzero(spaced >= 0)
    grams = _Grams(1, at, _numbered(row, word))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    overlap = exponent - 1
    longest = int(np.diff(bound).max(initial=0))
    scale = 1
    while scale * exponent <= max(longest, exponent) and len(grams.at):
        size = max(least_length - scale, overlap) if scale == 1 else overlap * scale
        while grams.size < size:
            grams = grams.longer(min(2 * grams.size, size))
        lag, seed = grams.seeds(scale, 2 * scale - 1)
        # per lag, how far the seeds before reach: a seed within has been extended already
        fresh = np.append(True, (lag[1:] != lag[:-1]) | (seed[1:] > seed[:-1] + size)) if len(lag) else np.empty(0, dtype=bool)
        lag, seed = lag[fresh], seed[fresh]
        begin, end = _extended(spaced, lag, seed, size)
        length = end - begin + lag
        long = length >= np.maximum(least_length, exponent * lag)
        found.append((begin[long], length[long], lag[long]))
        if scale == 1 and size > overlap * 2:
            # the grams of lag 1 may be longer than the next lags need
            grams = _Grams(1, at, _numbered(row, word))
        scale *= 2
    start, length, period = (np.concatenate(x) if found else np.empty(0, dtype=np.int64) for x in (zip(*found, strict=True) if found else ((), (), ())))
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    return start - np.searchsorted(fence, start), length, period


def find_runs(docs: DataFrame, text_column: str = "text", least_length: int = LEAST_LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """The documents with ``n_words``, ``runs`` (array of start, length, period by start and period) and ``collapsed``, the words that no run
    repeats, joined by one space. Words are numbered from 0."""
    new = ("n_words", "runs", "collapsed")
    kept = [c for c in docs.columns if c.lower() not in new]
    plain = [f"column_{i}" for i in range(len(kept))]
    source = docs.select(*[docs[c].alias(p) for c, p in zip(kept, plain, strict=True)], docs[text_column].cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            none = np.asarray(batch.column(len(kept)).is_null())
            for part in slices(batch.column(len(kept))):
                n = len(part.start)
                words = [part.text(i).split() for i in range(n)]  # bytes split at space and 0x09 to 0x0D
                sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
                bound = np.append(0, np.cumsum(sizes))
                number: dict[bytes, int] = defaultdict(count().__next__)
                word = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=int(bound[-1]))
                start, length, period = periodic_runs(word, bound, least_length, exponent)
                of = np.searchsorted(bound, start, side="right") - 1
                times = np.bincount(of, minlength=n) if len(of) else np.zeros(n, dtype=np.int64)
                change = np.bincount(start + period, minlength=len(word) + 1) - np.bincount(start + length, minlength=len(word) + 1) if len(of) else np.zeros(len(word) + 1, dtype=np.int64)
                stays = np.cumsum(change)[:-1] == 0
                texts = []
                for i, (mine, t) in enumerate(zip(words, times.tolist(), strict=True)):
                    texts.append(b" ".join([w for w, s in zip(mine, stays[bound[i] : bound[i + 1]].tolist(), strict=True) if s] if t else mine))
                gone = none[part.first : part.first + n]
                runs = pa.StructArray.from_arrays([pa.array(start - bound[of]), pa.array(length), pa.array(period)], ["start", "length", "period"])
                offsets = pa.array(np.append(0, np.cumsum(times)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.slice(part.first, n).columns[: len(kept)],
                        pa.array(sizes),
                        pa.ListArray.from_arrays(offsets, runs),
                        pa.array([t.decode("utf-8", "replace") for t in texts], pa.string(), mask=gone),
                    ],
                    [*plain, *new],
                )

    a_run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([*source.schema.fields[: len(kept)], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(a_run)), T.StructField("collapsed", T.StringType())])
    return source.mapInArrow(run, schema).toDF(*kept, *new)


def planted(text: Column, h: Column) -> Column:
    """The text, in one of ten documents by ``h`` with its words from some place on replaced by repetitions of the first of them."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.element_at(w, (a + F.pmod(i - a, p) + 1).cast("int")))), " ")

    # the list of words is named once, as an array of one, so that it isn't made again for every word
    changed = F.transform(F.array(words), repeated)[0]
    return F.when((F.pmod(h, F.lit(10)) == 0) & (F.regexp_count(text, F.lit(WORD)) > 0), changed).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = find_runs(docs.select("doc_id", planted(F.col("text"), h).alias("text")))
    # greatest length first, then smallest start, then period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("least"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.back")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.least")).alias("period"),
        F.expr("best.length * 1000 div -best.least").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.coalesce("collapsed", F.lit("")).cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
ORACLE: dict[str, str] = {}
