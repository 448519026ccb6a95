"""Plain versions of the operators for small inputs."""

from __future__ import annotations

import collections
import hashlib
import re

import numpy as np

from cartloom.llm import op8_line_dedup
from cartloom.llm.buffers import Slice

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def repeated(units: list, window: int, times: collections.Counter) -> list[bool]:
    gone = [False] * len(units)
    for p in range(len(units) - window + 1):
        if times[tuple(units[p : p + window])] > 1:
            gone[p : p + window] = [True] * window
    return gone


def windows(texts: list[list], window: int) -> collections.Counter:
    return collections.Counter(tuple(t[p : p + window]) for t in texts for p in range(len(t) - window + 1))


def base_rules(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    times, covered = windows([words], 5), set()
    for i in range(len(words) - 4):
        if times[tuple(words[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def shingles(text: str | None, width: int) -> frozenset:
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset([tuple(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [tuple(words)] if words else [])


def near_classes(texts: list[str | None], width: int, percent: int) -> list[int]:
    """For each text the least index in its class."""
    sets = [shingles(t, width) for t in texts]
    name = list(range(len(sets)))

    def find(x: int) -> int:
        while name[x] != x:
            x = name[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                name[y] = x
    return [find(i) for i in range(len(sets))]


def chunk_spans(text: str) -> list[tuple[int, int]]:
    data = text.encode()
    part = Slice(0, np.frombuffer(data, dtype=np.uint8), np.array([0]), np.array([len(data)]))
    return [(int(line), int(count)) for _, line, count, *_ in zip(*op8_line_dedup.chunks(part), strict=True)]


def kept_lines(texts: list[str | None]) -> list[tuple[str | None, int, int]]:
    """Text, removed lines and removed chunks of each, the first of equal chunks staying; texts come in order."""
    lines = [[] if t is None else t.split("\n") for t in texts]
    spans = [[] if t is None else chunk_spans(t) for t in texts]
    seen, out = set(), []
    for text, mine, found in zip(texts, lines, spans, strict=True):
        gone, chunks = set(), 0
        for first, count in found:
            chunk = "\n".join(mine[first : first + count])
            if chunk in seen:
                gone.update(range(first, first + count))
                chunks += 1
            seen.add(chunk)
        out.append((None if text is None else "\n".join(x for i, x in enumerate(mine) if i not in gone), len(gone), chunks))
    return out


def mixed(rows: list[tuple[int, str | None, int]], epochs: int = 3) -> list[tuple[int, float, int, int]]:
    """Source size, target, copies and taken words of (id, source, size)."""
    size = collections.Counter()
    for _, source, n in rows:
        size[source] += n
    order = sorted((s for s in size if s is not None), key=str.encode) + [s for s in size if s is None]
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, left, free = {}, sum(size.values()), list(order)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > epochs * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = float(epochs * size[s])
            left -= epochs * size[s]
            free.remove(s)
    place = lambda i: int(hashlib.md5(f"17:{'null' if i is None else f'={i}'}".encode()).hexdigest()[:15], 16)
    out = []
    for i, source, n in rows:
        full = int(target[source] // size[source]) if size[source] else 0
        rest = target[source] - full * size[source]
        upto = sum(m for j, s, m in rows if s == source and place(j) <= place(i))
        unit = sum(m for j, s, m in rows if s == source and place(j) == place(i))
        copies = full + (2 * upto - unit <= 2 * rest)
        out.append((size[source], target[source], copies, copies * n))
    return out
