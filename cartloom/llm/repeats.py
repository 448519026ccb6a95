"""Routing of text that may repeat, shared by the two operators that remove repeated passages.

Every window of W units (bytes or words) is represented by its anchor, the G-unit gram in it with the least Rabin-Karp hash, the leftmost of
equals. Equal windows have equal anchors at equal offsets, so a window whose anchor hash occurs once in the corpus can't repeat and needs no
shuffle. Windows next to each other mostly share their anchor; such a run of windows is a piece. Pieces whose anchor repeats are the only text
that leaves its document, and equal pieces are added up where they are made, so thousands of copies cost one row a task.

Texts that are equal as a whole are reduced to one, which counts as often as it occurs; the results go back by digest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.llm.buffers import Rolling, Slice, sliding_min, slices
from cartloom.llm.common import bucketed, lookup_join, written

_U = np.uint64


@dataclass(frozen=True)
class Unit:
    """How a slice of texts is read: ``spans`` gives, for each unit in order, its row and byte span, and a running hash over the units."""

    window: int
    gram: int
    spans: Callable[[Slice], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Rolling]]


@dataclass
class Runs:
    """Runs of windows that share an anchor: first and last window, row, first unit of the row, hash and place of the anchor."""

    first: np.ndarray
    last: np.ndarray
    row: np.ndarray
    key: np.ndarray
    anchor: np.ndarray


def anchored_runs(row: np.ndarray, prefix: np.ndarray, rolling: Rolling, window: int, gram: int) -> Runs:
    n = len(prefix) - 1
    none = np.empty(0, dtype=np.int64)
    if n < window:
        return Runs(none, none, none, none.astype(np.uint64), none)
    grams = rolling.windows(prefix, gram)
    grams ^= grams >> _U(29)
    grams *= _U(0xBF58476D1CE4E5B9)
    grams ^= grams >> _U(32)
    # the place in the low bits makes the leftmost of equal grams the least
    bits = max(24, n.bit_length())
    low = _U((1 << bits) - 1)
    least = sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), window - gram + 1)
    inside = np.flatnonzero(row[: n - window + 1] == row[window - 1 :])
    anchor = (least[inside] & low).astype(np.int64)
    begins = np.ones(len(anchor), dtype=bool)
    begins[1:] = anchor[1:] != anchor[:-1]
    start = np.flatnonzero(begins)
    first = inside[start]
    last = inside[np.append(start[1:], len(inside)) - 1] if len(start) else none
    anchor = anchor[start]
    return Runs(first, last, row[first], grams[anchor], anchor)


def with_digest(docs: DataFrame, text: Column, name: str) -> DataFrame:
    """The documents with a 128-bit digest of the text; null counts as empty."""
    return docs.withColumn(name, F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary"))))


def distinct_texts(keyed: DataFrame, text: Column, digest: str) -> DataFrame:
    """``digest``, ``text`` and ``copies``, in buckets of the digest, so the steps that follow don't shuffle texts again. Copies within a
    task are added up before the shuffle."""
    rows = keyed.select(F.col(digest).alias("digest"), F.coalesce(text, F.lit("")).cast("binary").alias("text"))
    return bucketed(rows.groupBy("digest").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")), "digest", "texts")


def _anchors(texts: DataFrame, unit: Unit) -> DataFrame:
    """``key``, ``digest`` and ``n`` (occurrences times copies) of the anchors of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies = np.asarray(batch.column(2))
            for part in slices(batch.column(1)):
                row, _, _, prefix, rolling = unit.spans(part)
                runs = anchored_runs(row, prefix, rolling, unit.window, unit.gram)
                if not len(runs.key):
                    continue
                # one row for each text and anchor
                order = np.lexsort((runs.key, runs.row))
                key, owner = runs.key[order], runs.row[order]
                new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])))
                times = np.diff(np.append(new, len(key)))
                owner = owner[new] + part.first
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[new].view(np.int64)), batch.column(0).take(pa.array(owner)), pa.array(times * copies[owner])],
                    ["key", "digest", "n"],
                )

    return texts.mapInArrow(run, "key long, digest binary, n long")


def repeated_pieces(texts: DataFrame, unit: Unit) -> DataFrame:
    """Pieces whose anchor occurs at least twice: ``digest``, ``copies`` of the text, ``first`` (first window in the text), ``windows``
    (how many), ``anchor`` (place of the anchor relative to the first window), ``key`` and ``piece`` (the bytes)."""
    anchors = _anchors(texts, unit)
    counted = anchors.groupBy("key").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows_")).filter("total > 1")
    found = lookup_join(anchors.select("key", "digest"), counted, ["key"], "rows_")
    wanted = found.groupBy("digest").agg(F.collect_list("key").alias("keys"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(3)
            key_at = np.append(np.asarray(keys.offsets), 0)
            for part in slices(batch.column(1)):
                row, start, end, prefix, rolling = unit.spans(part)
                runs = anchored_runs(row, prefix, rolling, unit.window, unit.gram)
                rows = len(part.start)
                mine = np.asarray(keys.values)[key_at[part.first] : key_at[part.first + rows]].view(np.uint64)
                pick = np.flatnonzero(np.isin(runs.key, mine))
                if not len(pick):
                    continue
                first, last, owner = runs.first[pick], runs.last[pick], runs.row[pick]
                base = np.searchsorted(row, np.arange(rows))
                begin, stop = start[first], end[last + unit.window - 1]
                for a in range(0, len(pick), 20_000):
                    b = slice(a, a + 20_000)
                    size = stop[b] - begin[b]
                    at = np.arange(size.sum()) + np.repeat(begin[b] - (np.cumsum(size) - size), size)
                    offsets = pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32))
                    piece = pa.Array.from_buffers(pa.binary(), len(size), [None, offsets, pa.py_buffer(part.data[at])])
                    who = pa.array(owner[b] + part.first)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(who),
                            batch.column(2).take(who),
                            pa.array((first[b] - base[owner[b]]).astype(np.int32)),
                            pa.array((last[b] - first[b] + 1).astype(np.int32)),
                            pa.array((runs.anchor[pick][b] - first[b]).astype(np.int32)),
                            pa.array(runs.key[pick][b].view(np.int64)),
                            piece,
                        ],
                        ["digest", "copies", "first", "windows", "anchor", "key", "piece"],
                    )

    joined = texts.join(wanted.hint("merge"), "digest").select("digest", "text", "copies", "keys")
    return written(joined.mapInArrow(run, "digest binary, copies long, first int, windows int, anchor int, key long, piece binary"), "pieces")


def marks_of_texts(pieces: DataFrame, marked: DataFrame) -> DataFrame:
    """``digest`` and ``marks``: the repeated windows of each text. ``marked`` has, by ``piece_id``, ``offsets`` (windows of the piece that
    repeat; null: all of them) and ``n``, the piece's occurrences. A text that occurs as a whole more than once needs no marks."""
    mine = pieces.filter("copies = 1").select("digest", "first", "windows", F.unhex(F.md5("piece")).alias("piece_id"))
    found = lookup_join(mine, marked, ["piece_id"], "n")
    return found.groupBy("digest").agg(F.collect_list(F.struct("first", "windows", "offsets")).alias("marks"))


def covered(part: Slice, n_units: np.ndarray, copies: np.ndarray, marks: list, window: int) -> np.ndarray:
    """For the units of a slice, whether a repeated window covers them."""
    total = int(n_units.sum())
    base = np.cumsum(n_units) - n_units
    change = np.zeros(total + 1, dtype=np.int32)
    for i, found in enumerate(marks):
        if copies[i] > 1 and n_units[i] >= window:
            change[base[i]] += 1
            change[base[i] + n_units[i]] -= 1
        elif found:
            for m in found:
                at = m["first"] + base[i]
                if m["offsets"] is None:
                    change[at] += 1
                    change[at + m["windows"] - 1 + window] -= 1
                else:
                    each = at + np.asarray(m["offsets"], dtype=np.int64)
                    np.add.at(change, each, 1)
                    np.add.at(change, each + window, -1)
    return np.cumsum(change[:-1]) > 0
