"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct pieces of a batch of texts form one corpus. An inverted index from the rank of a token pair to the positions where such a pair
stands is replayed in rank order: all positions of a rank merge at once, and only the pairs beside them are looked up anew. No shuffle is
needed, since a piece encodes alike wherever it stands; each task replays what its texts hold and has not met yet.

Defined cases: a null text is an empty one; texts are encoded whole, whatever their length; bytes that aren't UTF-8 are read as U+FFFD;
null ids decode to null, ids outside the vocabulary fail; input columns named like an output column are replaced.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartloom.llm.buffers import slices
from cartloom.llm.common import read

#: Pieces kept from one slice to the next; only speed depends on it.
KEEP_PIECES = 200_000
#: Pieces whose words are replayed together; memory and speed depend on it.
REPLAY_PIECES = 150_000
_SPACE = r"\t-\r \x85\xa0  -     　"
#: Before a space that something other than white space follows, a new match always begins.
_CUT = re.compile(r" (?=\S)")
#: Texts in which a space stands before white space or at the end are cut with more care.
_ODD = re.compile(r" (?:\s|\Z)")


class Vocabulary:
    """Tokens by rank, and the rank that any two neighbouring tokens merge into."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        # the pattern's \s is Unicode white space, without the four separators that Python adds
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"(?!\S)", f"(?![^{_SPACE}])").replace(r"\s", f"[{_SPACE}]"))
        self.byte_rank = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        keys = np.fromiter(pairs, dtype=np.int64, count=len(pairs))
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))[order]

    @classmethod
    def load(cls, content: bytes, pattern: str) -> Vocabulary:
        return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}, pattern)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it doesn't merge."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)


def replay(words: Sequence[bytes], vocabulary: Vocabulary) -> list[bytes]:
    """Token ids of each word, as 32-bit integers."""
    if not words:
        return []
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes)
    token = vocabulary.byte_rank[np.frombuffer(b"".join(words), dtype=np.uint8)]
    n = len(token)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    full = sizes > 0
    after[ends[full] - 1] = -1
    before[(ends - sizes)[full]] = -1
    rank_at = np.full(n, -1, dtype=np.int32)
    head = np.flatnonzero(after >= 0)
    rank_at[head] = vocabulary.merged(token[head], token[after[head]])
    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def enter(positions: np.ndarray, ranks: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for rank, part in zip(ranks[np.append(0, cuts)].tolist(), np.split(positions, cuts), strict=True):
            if rank in index:
                index[rank].append(part)
            else:
                index[rank] = [part]
                heapq.heappush(queue, rank)

    head = np.flatnonzero(rank_at >= 0)
    if len(head):
        enter(head, rank_at[head])
    word_of = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    late: set[int] = set()
    while queue:
        rank = heapq.heappop(queue)
        parts = index.pop(rank)
        at = parts[0] if len(parts) == 1 else np.concatenate(parts)
        at = at[rank_at[at] == rank]
        if not len(at):
            continue
        if len(at) > 1:
            at.sort()
            at = at[np.append(True, at[1:] != at[:-1])]
        if len(at) > 1 and (chained := after[at[:-1]] == at[1:]).any():
            # of pairs that share a token, the first, third, ... merge
            begins = np.flatnonzero(~np.append(False, chained))
            at = at[(np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))) % 2 == 0]
        gone = after[at]
        follow = after[gone]
        token[at] = rank
        rank_at[gone] = -1
        token[gone] = -1
        after[at] = follow
        linked = follow >= 0
        before[follow[linked]] = at[linked]
        left = before[at]
        touched = np.concatenate([left[left >= 0], at])  # some twice, which the next visit drops
        rank_at[touched] = -1
        touched = touched[after[touched] >= 0]
        new = vocabulary.merged(token[touched], token[after[touched]])
        rank_at[touched] = new
        touched, new = touched[new >= 0], new[new >= 0]
        if len(touched):
            if new.min() < rank:  # a pair that should have come earlier: such words are done one by one
                late.update(word_of[touched[new < rank]].tolist())
            enter(touched, new)
    kept = token >= 0
    cuts = (4 * np.append(0, np.cumsum(kept))[np.append(0, ends)]).tolist()
    ids = token[kept].astype(np.int32).tobytes()
    out = [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    for w in late:
        out[w] = np.array(_one_by_one(words[w], vocabulary), dtype=np.int32).tobytes()
    return out


def _one_by_one(word: bytes, vocabulary: Vocabulary) -> list[int]:
    """The pair of least rank merges, the leftmost of equals, until none is left."""
    ids = vocabulary.byte_rank[np.frombuffer(word, dtype=np.uint8)]
    while len(ids) > 1:
        ranks = vocabulary.merged(ids[:-1], ids[1:])
        possible = np.flatnonzero(ranks >= 0)
        if not len(possible):
            break
        i = possible[np.argmin(ranks[possible])]
        ids = np.concatenate([ids[:i], ranks[i : i + 1], ids[i + 2 :]])
    return ids.tolist()


def cut(text: str) -> list[str]:
    """The text without the single spaces before which a new match always begins, cut there."""
    return _CUT.split(text) if _ODD.search(text) else text.split(" ")


class Encoder:
    """Encodes texts from the ids of their pieces, which it remembers."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}

    def learn(self, texts: Iterable[str]) -> None:
        """Replays the merges over what the texts hold and earlier ones did not."""
        if len(self.later) > KEEP_PIECES:
            self.first, self.later = {}, {}
        begins, follows = set(), set()
        for text in texts:
            begin, *rest = cut(text)
            begins.add(begin)
            follows.update(rest)
        # a piece after a cut begins with the space that was cut off
        for known, pieces, space in ((self.first, begins, ""), (self.later, follows, " ")):
            fresh = [p for p in pieces if p not in known]
            for i in range(0, len(fresh), REPLAY_PIECES):
                some = fresh[i : i + REPLAY_PIECES]
                matches = [self.vocabulary.pattern.findall(space + p) for p in some]
                words = list({m for ms in matches for m in ms})
                ids = dict(zip(words, replay([w.encode("utf-8", "replace") for w in words], self.vocabulary), strict=True))
                known.update(zip(some, [ids[ms[0]] if len(ms) == 1 else b"".join([ids[m] for m in ms]) for ms in matches], strict=True))

    def encode(self, text: str) -> bytes:
        """The ids of a learnt text, as 32-bit integers."""
        begin, *rest = cut(text)
        return self.first[begin] + b"".join(map(self.later.__getitem__, rest))


def _shipped(spark: SparkSession, path: str | None):
    """The vocabulary file's content, sent to the executors once; its size is fixed."""
    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, text_column: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """The documents with ``ids``, the token ids of the text."""
    content = _shipped(docs.sparkSession, path)
    kept = [c for c in docs.columns if c.lower() != "ids"]
    source = docs.select(*[docs[c] for c in kept], docs[text_column].cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary.load(content.value, pattern))
        for batch in batches:
            column = batch.column(len(kept))
            # one replay for all texts of the batch; they are cut again afterwards rather than held
            encoder.learn(part.text(i).decode("utf-8", "replace") for part in slices(column) for i in range(len(part.start)))
            for part in slices(column):
                ids = [encoder.encode(part.text(i).decode("utf-8", "replace")) for i in range(len(part.start))]
                offsets = np.append(0, np.cumsum([len(x) // 4 for x in ids])).astype(np.int32)
                rows = batch.slice(part.first, len(ids))
                values = pa.array(np.frombuffer(b"".join(ids), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(kept)], pa.ListArray.from_arrays(pa.array(offsets), values)], [*kept, "ids"])

    schema = T.StructType([*[f for f in source.schema.fields[: len(kept)]], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, ids_column: str = "ids", path: str | None = None) -> DataFrame:
    """The rows with ``decoded``, the bytes that the ids stand for."""
    content = _shipped(encoded.sparkSession, path)
    kept = [c for c in encoded.columns if c.lower() != "decoded"]
    source = encoded.select(*[encoded[c] for c in kept], encoded[ids_column].alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = (line.split() for line in content.value.splitlines() if line)
        tokens = dict((int(b), base64.b64decode(a)) for a, b in pairs)
        for batch in batches:
            for first in range(0, max(1, batch.num_rows), 256):
                rows = batch.slice(first, 256)
                ids = rows.column(len(kept))
                flat = ids.flatten()
                if flat.null_count:
                    raise ValueError("a null id can't be decoded")
                cuts = np.append(0, np.cumsum(np.asarray(ids.value_lengths().fill_null(0)))).tolist()
                flat = np.asarray(flat)
                texts = [b"".join([tokens[i] for i in flat[a:b].tolist()]) for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(kept)], pa.array(texts, pa.binary(), mask=np.asarray(ids.is_null()))], [*kept, "decoded"])

    schema = T.StructType([*source.schema.fields[: len(kept)], T.StructField("decoded", T.BinaryType())])
    return source.mapInArrow(run, schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids beside the document."""
    return encode(docs).withColumn("n_tokens", F.size("ids").cast("long"))


def op4_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = decode(encode(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op4_bpe_roundtrip": op4_bpe_roundtrip}
ORACLE: dict[str, str] = {}
