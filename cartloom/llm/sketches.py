"""HyperMinHash sketches of shingle sets: leading-zero counts plus mantissa bits per bucket."""

from __future__ import annotations

import numpy as np

from cartloom.llm.buffers import LOWER, Rolling, Slice, mix, words

BUCKETS = 128
_BUCKET_BITS = 7
MANTISSA = 10
#: Registers of a band, so 32 bands: a pair of similarity 0.85 shares none with probability (1 - 0.85**4)**32 = 6e-11.
BAND = 4
_EMPTY = 0xFFFF
_BYTES, _WORDS = Rolling(31), Rolling(32)
_U = np.uint64
#: For an empty bucket, the order in which the others are asked; the same for all sets, so like sets borrow alike.
_DONORS = np.argsort(mix(np.arange(BUCKETS * BUCKETS, dtype=np.uint64)).reshape(BUCKETS, BUCKETS), axis=1)
_BOUNDS = np.arange(BUCKETS, dtype=np.uint64) << _U(64 - _BUCKET_BITS)


def shingle_sets(part: Slice, width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word shingles, A-Z in lower case. A text of fewer words is one shingle as a whole; one
    without words has none."""
    data = LOWER[part.data]
    w = words(part)
    prefix = _BYTES.prefix(_BYTES.table[data])
    key = mix(_BYTES.spans(prefix, w.start, w.end) + (w.end - w.start).astype(np.uint64))
    running = _WORDS.prefix(key)
    hashes = mix(_WORDS.windows(running, width) + _U(width))
    out = []
    for a, b in zip(w.bound[:-1].tolist(), w.bound[1:].tolist(), strict=True):
        if b - a >= width:
            found = np.sort(hashes[a : b - width + 1])
            out.append(found[np.append(True, found[1:] != found[:-1])])
        elif b > a:
            out.append(mix(_WORDS.spans(running, np.array([a]), np.array([b])) + _U(b - a)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def set_digests(sets: list[np.ndarray]) -> list[bytes]:
    """128 bits that equal sets share: two sums over independent mixes of the members."""
    return [np.array([len(s) + int(mix(s).sum(dtype=np.uint64)) & 0xFFFFFFFFFFFFFFFF, int(mix(s ^ _U(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64))], dtype=np.uint64).tobytes() for s in sets]


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 16-bit registers per non-empty set. A bucket is the top bits of a hash; its register describes the least of the other bits:
    6 bits count the leading zeros and 10 follow the first one. Empty buckets borrow from others."""
    least = np.zeros((len(sets), BUCKETS), dtype=np.uint64)
    full = np.zeros((len(sets), BUCKETS), dtype=bool)
    for i, s in enumerate(sets):
        at = np.minimum(np.searchsorted(s, _BOUNDS), len(s) - 1)
        least[i] = s[at]
        full[i] = (least[i] >> _U(64 - _BUCKET_BITS)) == np.arange(BUCKETS, dtype=np.uint64)
    rest = (least << _U(_BUCKET_BITS)) | _U((1 << _BUCKET_BITS) - 1)
    top = np.frexp(rest.astype(np.float64))[1].astype(np.int64)  # place of the first one, or one more after rounding up
    top -= (rest >> np.maximum(top - 1, 0).astype(np.uint64)) == 0
    zeros = 64 - top
    mantissa = (rest << (zeros + 1).astype(np.uint64)) >> _U(64 - MANTISSA)
    out = np.where(full, (zeros.astype(np.uint64) << _U(MANTISSA)) | mantissa, _U(_EMPTY)).astype(np.uint16)
    row, bucket = np.nonzero(~full)
    filled = out.copy()
    for turn in range(BUCKETS):
        if not len(row):
            break
        given = out[row, _DONORS[bucket, turn]]
        some = given != _EMPTY
        filled[row[some], bucket[some]] = given[some]
        row, bucket = row[~some], bucket[~some]
    return filled


def band_keys(table: np.ndarray) -> np.ndarray:
    """One 64-bit key per row and band."""
    packed = np.ascontiguousarray(table).view(np.uint64).reshape(len(table), -1)
    return mix(packed ^ mix(np.arange(packed.shape[1], dtype=np.uint64) + _U(1))[None, :])


def level_shares(sizes: np.ndarray) -> np.ndarray:
    """For each set size, the probability of each number of leading zeros in a register."""
    edge = np.append(2.0 ** -np.arange(58), 0.0)  # a minimum with z leading zeros lies in [2**-(z+1), 2**-z)
    return np.diff((1 - edge[None, :]) ** np.maximum(1.0, np.asarray(sizes, dtype=float)[:, None] / BUCKETS), axis=1)


def chance(levels: np.ndarray, i: int) -> np.ndarray:
    """Probability that registers of unrelated sets of the i-th size and of each size are equal."""
    return levels @ levels[i] / (1 << MANTISSA)


def corrected(equal: np.ndarray, by_chance: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, less what is equal by chance."""
    return np.maximum(0.0, (equal - by_chance) / (1 - by_chance))


def estimate(one: np.ndarray, two: np.ndarray, n: int, m: int) -> float:
    """Jaccard similarity of two sets of n and m members, from their registers."""
    return float(corrected((one == two).mean(), chance(level_shares(np.array([n, m])), 0)[1]))
