"""Range coder for token ids, driven by adaptive weights of predictions of order 0 to 2.

Blocks are coded side by side, one lane each, so every step of the loop is a few array operations over all lanes; no block needs another to
be decoded. In each block the last two ids choose a slot, and so does the last one; a slot holds the id that followed there and a confidence.
Order 0 says how often each id comes up in the blocks coded together (``frequencies``, which the caller keeps beside them; without
them every id is as likely). The three predictions share the code space in proportion to how often each was right in this block at these
confidences, after every id anew; the arithmetic code is carryless with 64-bit bounds and 16-bit output. Weights are single-precision
quotients and products, which IEEE 754 rounds the same everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Ids of a block, and blocks coded side by side. The file records the first; only speed, memory and the frequencies depend on the second.
BLOCK = 2048
LANES = 4096
#: Ids counted, and blocks turned round, at once; only memory depends on them.
_COUNTED, _TURNED = 1 << 19, 64
#: The counts of a block are kept in 16 bits each.
BLOCK_LIMIT = 16_384
_SLOT_BITS = 10
_SLOTS = np.uint16((1 << _SLOT_BITS) - 1)
#: Slots hold a mark (an id's rank from 1, times 64) and a confidence: in the lowest three bits for order 1, in the next for order 2.
_MARK, _MARK_BITS, _FIRST = np.uint32(64), np.uint32(6), np.uint32(1)
_MOST_VOCABULARY = (1 << 26) - 2
_CONFIDENCE = np.uint32(7), np.uint32(56)
_SURER = np.uint32(1), np.uint32(8)
_FACTORS = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
_WEIGHT_BITS, _WEIGHTS, _WHOLE = np.uint64(15), np.uint64(1 << 15), np.float32(1 << 15)
_NONE, _ZERO = np.int32(0), np.int8(0)
_TOP, _BOTTOM = np.uint64(1 << 48), np.uint64(1 << 40)
_SHIFT, _HEAD, _LOW, _NEXT = np.uint64(16), np.uint64(48), np.uint64((1 << 40) - 1), np.uint64(1)
#: 16 bits each: how often any order, order 1 and order 2 are taken to have been right before anything is seen, by both confidences.
_PRIOR = np.array([(4 + 2 * one + 4 * two) | (2 * one) << 16 | (4 * two) << 32 for two in range(8) for one in range(8)], dtype="<u8")
#: What an id adds to these, by the order that it was coded by.
_RIGHT = np.array([2, 2 | 2 << 16, 2 | 2 << 32], dtype="<u8")


def frequencies(ids: np.ndarray, vocabulary: int) -> np.ndarray:
    """What each id takes of the code space of order 0, given the ids to be coded; an id that isn't among them takes nothing."""
    counts = np.zeros(vocabulary, dtype=np.int64)
    for first in range(0, len(ids), _COUNTED):
        counts += np.bincount(ids[first : first + _COUNTED], minlength=vocabulary)
    used = np.flatnonzero(counts)
    total = _places(len(used))
    out = np.zeros(vocabulary, dtype=np.uint32)
    out[used] = 1 + counts[used] * (total - len(used)) // max(1, len(ids))
    out[int(counts.argmax())] += total - int(out.sum())
    return out


def _places(used: int) -> int:
    """The code space of order 0 for so many ids: a place for each takes at most a thirty-second of it."""
    return 1 << max(16, used.bit_length() + 5)


class _Order0:
    """The code space of order 0: ids stand for their rank among those that take some of it."""

    def __init__(self, vocabulary: int, table: np.ndarray | None):
        if vocabulary > _MOST_VOCABULARY:
            raise ValueError(f"vocabularies of more than {_MOST_VOCABULARY} ids are not supported")
        if table is None:
            total = _places(vocabulary)
            table = np.full(vocabulary, total // vocabulary, dtype=np.uint32)
            table[0] += total % vocabulary
        self.used = np.flatnonzero(table)
        self.size = table[self.used].astype(np.uint64)
        self.total = _places(len(self.used))
        if len(table) != vocabulary or int(self.size.sum()) != self.total:
            raise ValueError("the frequencies don't fill the code space")
        self.bits = np.uint64(self.total.bit_length() - 1)
        self.begin = np.cumsum(self.size) - self.size
        #: What is wide enough for every rank.
        self.dtype = np.min_scalar_type(len(self.used))

    def ranks(self, vocabulary: int) -> np.ndarray:
        """The rank of each id."""
        out = np.zeros(vocabulary, dtype=self.dtype)
        out[self.used] = np.arange(len(self.used))
        return out

    def lookup(self) -> np.ndarray:
        """The rank at each place."""
        return np.repeat(np.arange(len(self.size), dtype=self.dtype), self.size.astype(np.int64))

    def narrow(self, low: np.ndarray, span: np.ndarray, lanes: np.ndarray, ranks: np.ndarray, each: np.ndarray) -> None:
        """Sets the bounds of the lanes to their ids' share, ``each`` being a place's."""
        low[lanes] += self.begin.take(ranks) * each
        span[lanes] = self.size.take(ranks) * each


class _Predictions:
    """The state of ``lanes`` blocks of at most ``steps`` ids; ``a`` in its methods is the number of lanes still going, always the first ones."""

    def __init__(self, lanes: int, steps: int):
        if steps > BLOCK_LIMIT:
            raise ValueError(f"blocks of more than {BLOCK_LIMIT} ids are not supported")
        self.base = np.arange(lanes, dtype=np.int64) << _SLOT_BITS
        self.rows = np.arange(lanes, dtype=np.int64) << 6
        self.slots = [np.zeros(lanes << _SLOT_BITS, dtype=np.uint32) for _ in range(2)]
        self.right = np.tile(_PRIOR, lanes)
        self.last = np.zeros(lanes, dtype=np.uint32)
        self.last_but_one = np.zeros(lanes, dtype=np.uint32)

    def weigh(self, a: int) -> None:
        """Sets the marks that both slots hold and the code space of each order, out of _WEIGHTS."""
        one = self.last[:a] * _FACTORS[0]
        two = (one + self.last_but_one[:a]) * _FACTORS[1]
        base = self.base[:a]
        # from the upper half of each product
        self.at = base + (one.view("<u2")[1::2] & _SLOTS), base + (two.view("<u2")[1::2] & _SLOTS)
        self.held = first, second = self.slots[0].take(self.at[0]), self.slots[1].take(self.at[1])
        sure_1, sure_2 = first & _CONFIDENCE[0], second & _CONFIDENCE[1]
        self.marks = first ^ sure_1, second ^ sure_2
        sure_1 |= sure_2
        self.row = self.rows[:a] + sure_1
        self.seen = self.right.take(self.row)
        seen = self.seen.view("<u2").reshape(-1, 4)
        scale = _WHOLE / seen[:, 0].astype(np.float32)
        # slots that hold the same id share one interval
        alike = self.marks[0] == self.marks[1]
        one = seen[:, 1] * scale
        two = (seen[:, 2] * scale).astype(np.int32)
        one = one.astype(np.int32)
        moved = one * alike
        one -= moved
        two += moved
        self.some = one > _NONE, two > _NONE
        self.space = one.astype(np.uint64), two.astype(np.uint64)

    def learn(self, a: int, marks: np.ndarray, order: np.ndarray) -> None:
        """Takes in the ids that came and the order that each was coded by."""
        for at, held, mark, slots, confidence, surer in zip(self.at, self.held, self.marks, self.slots, _CONFIDENCE, _SURER, strict=True):
            known = np.flatnonzero(mark == marks)
            fresh = marks + surer
            held = held.take(known)
            fresh[known] = np.minimum(held + surer, held | confidence)
            slots[at] = fresh
        self.seen += _RIGHT.take(order.astype(np.int64))
        self.right[self.row] = self.seen
        self.last_but_one[:a] = self.last[:a]
        self.last[:a] = marks


def _order(by_one: np.ndarray, by_two: np.ndarray) -> np.ndarray:
    """0 to 2 for each lane; order 2 goes before order 1."""
    order = by_two.view(np.int8) << 1
    order |= by_one.view(np.int8) & ~by_two
    return order


def _settle(low: np.ndarray, span: np.ndarray):
    """Yields the lanes whose topmost 16 bits are due and those bits, until every span is wide enough."""
    due = (span < _TOP).nonzero()[0]
    while len(due):
        l, s = low.take(due), span.take(due)
        differ = l + s
        differ ^= l
        open_ = (differ >= _TOP).nonzero()[0]
        if len(open_):
            # the topmost bits may still change: a narrow span is cut so that they can't, others wait
            small = s.take(open_) < _BOTTOM
            narrow = open_[small]
            s[narrow] = (~l[narrow] + _NEXT) & _LOW
            ready = np.ones(len(due), dtype=bool)
            ready[open_[~small]] = False
            ready = ready.nonzero()[0]
            due, l, s = due.take(ready), l.take(ready), s.take(ready)
        yield due, l >> _HEAD
        l <<= _SHIFT
        s <<= _SHIFT
        low[due] = l
        span[due] = s
        due = due.take((s < _TOP).nonzero()[0])


def _narrow(low: np.ndarray, span: np.ndarray, order: np.ndarray, rest: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
    """Sets the bounds of the lanes that a slot foresaw; ``span`` is a weight's."""
    lanes = order.nonzero()[0]
    later = order.take(lanes) >> 1
    each, first = span.take(lanes), one.take(lanes)
    low[lanes] += (rest.take(lanes) + first * later.view(np.uint8)) * each
    span[lanes] = np.where(later, two.take(lanes), first) * each


def _by_length(sizes: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Lanes from the longest block to the shortest, and how many are still going at each step."""
    sizes = np.asarray(sizes, dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    return order, np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), side="left")


def encode(blocks: Sequence[np.ndarray], vocabulary: int, table: np.ndarray | None = None) -> list[bytes]:
    """The code of each block of ids."""
    lane_of, going = _by_length([len(b) for b in blocks])
    zero, model = _Order0(vocabulary, table), _Predictions(len(blocks), len(going))
    rank_of = zero.ranks(vocabulary)
    by_step = np.zeros((len(going), len(blocks)), dtype=zero.dtype)
    for first in range(0, len(blocks), _TURNED):
        some = lane_of[first : first + _TURNED].tolist()
        by_lane = np.zeros((len(some), len(going)), dtype=by_step.dtype)
        for row, b in zip(by_lane, some, strict=True):
            row[: len(blocks[b])] = rank_of[blocks[b]]
        by_step[:, first : first + len(some)] = by_lane.T
    low, span = np.zeros(len(blocks), dtype=np.uint64), np.full(len(blocks), 2**64 - 1, dtype=np.uint64)
    # no step moves out more than three words
    width = 3 * len(going) + 4
    out, begin = np.empty(len(blocks) * width, dtype=np.uint16), np.arange(len(blocks)) * width
    used = begin.copy()
    for step, a in enumerate(going.tolist()):
        model.weigh(a)
        ranks = by_step[step, :a]
        marks = ranks.astype(np.uint32)
        marks += _FIRST
        marks *= _MARK
        one, two = model.space
        rest = _WEIGHTS - one
        rest -= two
        by_two = (model.marks[1] == marks) & model.some[1]
        by_one = (model.marks[0] == marks) & model.some[0]
        order = _order(by_one, by_two)
        l, s = low[:a], span[:a]
        s >>= _WEIGHT_BITS
        _narrow(l, s, order, rest, one, two)
        lanes = (order == _ZERO).nonzero()[0]
        each = s.take(lanes)
        each *= rest.take(lanes)
        each >>= zero.bits
        zero.narrow(l, s, lanes, ranks.take(lanes).astype(np.int64), each)
        for due, words in _settle(l, s):
            at = used.take(due)
            out[at] = words
            at += 1
            used[due] = at
        model.learn(a, marks, order)
    for _ in range(4):
        out[used] = low >> _HEAD
        used += 1
        low <<= _SHIFT
    coded = [b""] * len(blocks)
    for b, first, end in zip(lane_of.tolist(), begin.tolist(), used.tolist(), strict=True):
        coded[b] = out[first:end].astype(">u2").tobytes()
    return coded


def decode(coded: Sequence[bytes], sizes: Sequence[int], vocabulary: int, table: np.ndarray | None = None) -> list[np.ndarray]:
    """The ids of each block, given its code, its number of ids and the frequencies that it was coded by."""
    lane_of, going = _by_length(sizes)
    width = max((len(c) // 2 for c in coded), default=0) + 4
    words = np.zeros((len(coded), width), dtype=np.uint16)
    for lane, b in enumerate(lane_of.tolist()):
        words[lane, : len(coded[b]) // 2] = np.frombuffer(coded[b], dtype=">u2")
    flat = words.ravel()
    zero, model = _Order0(vocabulary, table), _Predictions(len(coded), len(going))
    lookup, last_place = zero.lookup(), np.uint64(zero.total - 1)
    low, span, code = np.zeros(len(coded), dtype=np.uint64), np.full(len(coded), 2**64 - 1, dtype=np.uint64), np.zeros(len(coded), dtype=np.uint64)
    for k in range(4):
        code = code << _SHIFT | words[:, k]
    used = np.arange(len(coded)) * width + 4
    most = used + width - 5
    by_step = np.zeros((len(going), len(coded)), dtype=zero.dtype)
    for step, a in enumerate(going.tolist()):
        model.weigh(a)
        one, two = model.space
        rest = _WEIGHTS - one
        rest -= two
        l, s, c = low[:a], span[:a], code[:a]
        s >>= _WEIGHT_BITS
        place = c - l
        # what no valid code holds goes to an order that has room, and fails the checksum
        by_two = (place >= (rest + one) * s) & model.some[1]
        by_one = (place >= rest * s) & model.some[0]
        order = _order(by_one, by_two)
        _narrow(l, s, order, rest, one, two)
        marks = np.where(by_two, model.marks[1], model.marks[0])
        lanes = (order == _ZERO).nonzero()[0]
        each = s.take(lanes)
        each *= rest.take(lanes)
        each >>= zero.bits
        at = place.take(lanes)
        at //= each
        ranks = lookup.take(np.minimum(at, last_place).astype(np.int64)).astype(np.int64)
        zero.narrow(l, s, lanes, ranks, each)
        ranks += 1
        ranks <<= 6
        marks[lanes] = ranks
        for due, _ in _settle(l, s):
            at = used.take(due)
            c[due] = (c.take(due) << _SHIFT) | flat.take(np.minimum(at, most.take(due)))
            at += 1
            used[due] = at
        model.learn(a, marks, order)
        marks >>= _MARK_BITS
        marks -= _FIRST
        by_step[step, :a] = marks
    found: list[np.ndarray] = [np.empty(0, dtype=np.uint32)] * len(coded)
    used_ids = zero.used.astype(np.uint32)
    for first in range(0, len(coded), _TURNED):
        some = lane_of[first : first + _TURNED].tolist()
        for row, b in zip(np.ascontiguousarray(by_step[:, first : first + len(some)].T), some, strict=True):
            found[b] = used_ids.take(row[: sizes[b]])
    return found
