"""Suffix arrays by induced sorting, many small texts in lock step.

Suffixes are classified as smaller or larger than their right neighbour; the leftmost-smaller substrings are sorted by two induction passes,
named, and sorted recursively where names repeat; a last pair of passes induces the suffix array in linear time. The arrays hold one text a
row ("lane") and each pass advances all lanes by one cell at once, so numpy does the work of the inner loops.

A lane is a row of non-negative symbols whose last valid symbol, at ``length - 1``, is 0 and occurs nowhere else in the lane.
"""

from __future__ import annotations

import numpy as np


def _places(symbols: np.ndarray, length: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """First place of each symbol's bucket and the place after its last, per lane."""
    lanes, width = symbols.shape
    valid = np.arange(width)[None, :] < length[:, None]
    flat = (np.arange(lanes, dtype=np.int64)[:, None] * kinds + symbols)[valid]
    count = np.bincount(flat, minlength=lanes * kinds).reshape(lanes, kinds)
    after = np.cumsum(count, axis=1)
    return after - count, after


def _induce(bucket: np.ndarray, before_larger: np.ndarray, before_smaller: np.ndarray, seeds: np.ndarray, begin: np.ndarray, after: np.ndarray, width: int) -> np.ndarray:
    """Suffix array, padded with -1, from the leftmost-smaller positions in the order ``seeds`` (rows padded with -1).

    Texts are addressed by cell, lane * width + position; ``bucket`` has the bucket of each cell's symbol, and ``before_larger`` and
    ``before_smaller`` that of the cell before, where it is of that kind, else -1. The array is kept with lanes side by side, so a step
    reads one row; heads and tails of buckets are places in it.
    """
    lanes, none = len(begin), len(before_larger) - 1
    array = np.full((width, lanes), none, dtype=np.int64)
    flat, lane = array.reshape(-1), np.arange(lanes, dtype=np.int64)[:, None]
    head, end = (begin * lanes + lane).ravel(), (after * lanes + lane).ravel()
    tail = end.copy()
    cells = np.where(seeds >= 0, seeds + lane * width, -1).T
    for k in range(len(cells) - 1, -1, -1):
        cell = cells[k]
        cell = cell[cell >= 0]
        home = bucket[cell]
        place = tail[home] - lanes
        flat[place] = cell
        tail[home] = place
    for i in range(width):
        cell = array[i]
        home = before_larger[cell]
        some = (home >= 0).nonzero()[0]
        if some.size:
            home = home[some]
            place = head[home]
            flat[place] = cell[some] - 1
            head[home] = place + lanes
    tail = end
    for i in range(width - 1, -1, -1):
        cell = array[i]
        home = before_smaller[cell]
        some = (home >= 0).nonzero()[0]
        if some.size:
            home = home[some]
            place = tail[home] - lanes
            flat[place] = cell[some] - 1
            tail[home] = place
    out = array.T
    return np.where(out == none, -1, out - lane * width).astype(np.int32)


def _packed(values: np.ndarray, chosen: np.ndarray, count: np.ndarray, fill: int) -> np.ndarray:
    """The chosen cells of each row moved to its front."""
    out = np.full((len(count), int(count.max(initial=0))), fill, dtype=np.int32)
    lane, _ = np.nonzero(chosen)
    starts = np.cumsum(count) - count
    out[lane, np.arange(len(lane)) - starts[lane]] = values[chosen]
    return out


def suffix_arrays(symbols: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The suffix array of each lane, padded with -1."""
    lanes, width = symbols.shape
    valid = np.arange(width)[None, :] < length[:, None]
    symbols = np.where(valid, symbols, 0)
    # a suffix is smaller if its first symbol differing from the next one is less; equal neighbours are alike
    smaller = np.zeros((lanes, width), dtype=bool)
    smaller[np.arange(lanes), length - 1] = True
    rises, same = np.zeros((lanes, width), dtype=bool), np.zeros((lanes, width), dtype=bool)
    rises[:, :-1] = symbols[:, :-1] < symbols[:, 1:]
    same[:, :-1] = symbols[:, :-1] == symbols[:, 1:]
    # from the right, each run of equal symbols takes the kind of its last cell
    settled = np.where(~same, np.arange(width)[None, :], width - 1)
    settled = np.minimum.accumulate(settled[:, ::-1], axis=1)[:, ::-1]
    smaller |= np.take_along_axis(rises, settled, axis=1) & (np.arange(width)[None, :] < length[:, None] - 1)
    leftmost = np.zeros((lanes, width), dtype=bool)
    leftmost[:, 1:] = smaller[:, 1:] & ~smaller[:, :-1]
    leftmost &= valid
    count = leftmost.sum(axis=1)
    if width == 1 or not count.any():
        out = np.where(valid, 0, -1).astype(np.int32)
        return out
    kinds = int(symbols.max()) + 1
    begin, after = _places(symbols, length, kinds)
    bucket = (np.arange(lanes, dtype=np.int64)[:, None] * kinds + symbols).ravel()
    first = np.arange(lanes) * width
    before_larger, before_smaller = (np.full(lanes * width + 1, -1, dtype=np.int64) for _ in range(2))
    before_larger[1:-1] = np.where(~smaller.ravel()[:-1], bucket[:-1], -1)
    before_smaller[1:-1] = np.where(smaller.ravel()[:-1], bucket[:-1], -1)
    before_larger[first] = before_smaller[first] = -1
    before_larger[-1] = before_smaller[-1] = -1
    place = np.broadcast_to(np.arange(width, dtype=np.int32)[None, :], symbols.shape)
    seeds = _packed(place, leftmost, count, -1)
    array = _induce(bucket, before_larger, before_smaller, seeds, begin, after, width)
    in_order = (array >= 0) & np.take_along_axis(leftmost, np.maximum(array, 0), axis=1)
    ordered = _packed(array, in_order, count, -1)
    # names: one more than the predecessor's where the substrings differ
    number = np.full((lanes, width), -1, dtype=np.int32)
    lane, _ = np.nonzero(seeds >= 0)
    number[lane, seeds[seeds >= 0]] = np.nonzero(seeds >= 0)[1]
    ends = np.full(seeds.shape, -1, dtype=np.int64)
    ends[:, :-1] = seeds[:, 1:]
    ends = np.where(ends < 0, length[:, None] - 1, ends)
    sizes = ends - seeds
    differs = np.zeros(ordered.shape, dtype=bool)
    differs[:, 0] = ordered[:, 0] >= 0
    lane, k = np.nonzero(ordered[:, 1:] >= 0)
    one, two = ordered[lane, k].astype(np.int64), ordered[lane, k + 1].astype(np.int64)
    size_one, size_two = sizes[lane, number[lane, one]], sizes[lane, number[lane, two]]
    unequal = size_one != size_two
    open_ = np.flatnonzero(~unequal)
    shift = 0
    while len(open_):
        apart = symbols[lane[open_], one[open_] + shift] != symbols[lane[open_], two[open_] + shift]
        unequal[open_[apart]] = True
        open_ = open_[~apart]
        shift += 1
        open_ = open_[size_one[open_] >= shift]
    differs[lane, k + 1] = unequal
    names = np.cumsum(differs, axis=1) - 1
    repeats = names.max(axis=1, initial=0) + 1 < count
    if repeats.any():
        some = np.flatnonzero(repeats & (count > 0))
        n_some = count[some]
        reduced = np.zeros((len(some), int(n_some.max())), dtype=np.int64)
        lane, k = np.nonzero(ordered[some] >= 0)
        reduced[lane, number[some[lane], ordered[some][lane, k]]] = names[some][lane, k]
        deeper = suffix_arrays(reduced, n_some)
        lane, k = np.nonzero(deeper >= 0)
        ordered[some[lane], k] = seeds[some[lane], deeper[lane, k]]
    array = _induce(bucket, before_larger, before_smaller, ordered, begin, after, width)
    array[length == 1, 0] = 0
    return array


def permuted_common_prefixes(symbols: np.ndarray, length: np.ndarray, array: np.ndarray) -> np.ndarray:
    """For each position, the common prefix with the suffix sorted before its own; in text order.

    A value can only exceed its left neighbour's less one where the symbols to the left differ; there it is compared afresh, elsewhere it
    is carried on. Symbols that separate texts occur once in a lane, so no prefix crosses them.
    """
    lanes, width = symbols.shape
    before = np.full((lanes, width), -1, dtype=np.int64)
    lane, k = np.nonzero(array[:, 1:] >= 0)
    before[lane, array[lane, k + 1]] = array[lane, k]
    lane, at = np.nonzero(before >= 0)
    other = before[lane, at]
    fresh = (at == 0) | (other == 0) | (symbols[lane, np.maximum(at, 1) - 1] != symbols[lane, np.maximum(other, 1) - 1])
    lane_f, at_f, other_f = lane[fresh], at[fresh], other[fresh]
    common = np.zeros(len(at_f), dtype=np.int64)
    flat = symbols.ravel()
    open_ = np.arange(len(at_f))
    one, two = lane_f * width + at_f, lane_f * width + other_f
    last_one, last_two = lane_f * width + length[lane_f] - 1, lane_f * width + length[lane_f] - 1
    while len(open_):
        a, b = one[open_] + common[open_], two[open_] + common[open_]
        go = (a <= last_one[open_]) & (b <= last_two[open_])
        go[go] = flat[a[go]] == flat[b[go]]
        open_ = open_[go]
        common[open_] += 1
    reach = np.zeros((lanes, width), dtype=np.int64)
    reach[lane_f, at_f] = common + at_f
    reach = np.maximum.accumulate(reach, axis=1) - np.arange(width)[None, :]
    return np.where(before >= 0, np.maximum(reach, 0), 0)
