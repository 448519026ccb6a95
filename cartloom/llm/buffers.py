"""Vectorised work on the UTF-8 bytes of a batch of texts.

A batch is cut into slices of a few megabytes, so the arrays derived from it stay small whatever the batch holds; a longer text makes a
slice of its own. Word hashes are differences of one running sum per slice, so no Python loop touches a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2_000_000
#: The bytes that separate words: space and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Rolling:
    """Rabin-Karp hashes modulo 2**64 with a random value per byte: any two spans of equal content have equal hashes."""

    def __init__(self, seed: int):
        self.table = mix(np.arange(256, dtype=np.uint64) + _U(seed * 1000))
        self.base = int(mix(np.array([seed + 77], dtype=np.uint64))[0]) & ~7 | 3
        self.inverse = pow(self.base, -1, 1 << 64)
        self._up = self._down = np.ones(1, dtype=np.uint64)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            n = max(n, SLICE_BYTES + 1)
            self._up, self._down = self._powers(self.base, n), self._powers(self.inverse, n)
        return self._up, self._down

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Running sums of value times power, with a leading zero."""
        up, _ = self.powers(len(values) + 1)
        out = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[: len(values)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, down = self.powers(len(prefix))
        return (prefix[end] - prefix[start]) * down[start]

    def windows(self, prefix: np.ndarray, width: int) -> np.ndarray:
        """Hash of every run of ``width`` values."""
        if len(prefix) <= width:
            return np.empty(0, dtype=np.uint64)
        _, down = self.powers(len(prefix))
        return (prefix[width:] - prefix[:-width]) * down[: len(prefix) - width]


@dataclass
class Slice:
    """Texts of rows ``first`` to ``first + len(start)``, as offsets into ``data``."""

    first: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The texts of a string or binary column in order; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.empty(0, dtype=np.uint8)
    begin, end = offsets[:-1], offsets[1:].copy()
    if column.null_count:
        gone = np.asarray(column.is_null())
        end[gone] = begin[gone]
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield Slice(i, data[offsets[i] : offsets[j]], begin[i:j] - offsets[i], end[i:j] - offsets[i])
        i = j


@dataclass
class Words:
    """Words of a slice in order: byte span and row; ``bound[i]:bound[i + 1]`` are those of row i."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    bound: np.ndarray


def runs(inside: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of true values, broken at the positions ``cut`` as well."""
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = cut[cut < len(inside)]
    first[cut] = inside[cut]
    start = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    back = cut[cut > 0] - 1
    last[back] = inside[back]
    return start, np.flatnonzero(last) + 1


def words(part: Slice) -> Words:
    inside = ~SPACE[part.data]
    holes = np.flatnonzero(part.end[:-1] < part.start[1:]) if len(part.start) > 1 else []
    for i in holes:  # bytes under a null row
        inside[part.end[i] : part.start[i + 1]] = False
    inside[part.end[-1] :] = False
    start, end = runs(inside, part.start)
    bound = np.searchsorted(start, np.append(part.start, part.end[-1]))
    bound[-1] = len(start)
    row = np.repeat(np.arange(len(part.start)), np.diff(bound))
    return Words(start, end, row, bound)


def line_spans(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte span and row of every line (what stands between line feeds), and where each row's lines begin; any text has one at least."""
    n_rows = len(part.start)
    feeds = np.flatnonzero(part.data == 10)
    owner = np.searchsorted(part.start, feeds, side="right") - 1
    valid = (owner >= 0) & (feeds < part.end[np.maximum(owner, 0)])
    feeds, owner = feeds[valid], owner[valid]
    start = np.concatenate([part.start, feeds + 1])
    row = np.concatenate([np.arange(n_rows), owner])
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    bound = np.searchsorted(row, np.arange(n_rows + 1))
    end = np.append(start[1:] - 1, part.end[-1])
    end[bound[1:] - 1] = part.end
    return start, end, row, bound


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every run of ``width`` values."""
    n = len(values)
    if n < width:
        return values[:0]
    if width == 1:
        return values
    full = -(-n // width) * width
    padded = np.full(full, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
