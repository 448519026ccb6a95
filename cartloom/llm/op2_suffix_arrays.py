"""Removal of repeated byte strings by suffix arrays that are built by induced sorting.

Equal strings of ``WINDOW`` bytes have equal anchors (``cartloom.llm.repeats``), so the pieces of text around one anchor hash form a group that
holds every occurrence of its strings. Groups are dealt out to shards; a shard lays each group out as one text, induces the suffix arrays of
many groups in lock step (``cartloom.llm.induced``) and computes the permuted common prefixes. A position whose prefix in common with a
neighbour in the array reaches WINDOW starts a repeated string. Equal pieces are one text with a count, whose strings all repeat.

A group of more than ``GROUP_PIECES`` different pieces would burden one task, so its pieces are cut into narrower ranges of windows, which
fall into more groups since all windows of a range share a longer core; at the last level a range is a single window.

Defined cases: a null text is empty; a text shorter than a window loses nothing; strings never cross texts; of repeated rows each counts as a
document; an empty table gives no rows; input columns named like an output column are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom.llm.buffers import Rolling, Slice, slices
from cartloom.llm.common import lookup_join, own_columns, read, replace_columns, written
from cartloom.llm.induced import permuted_common_prefixes, suffix_arrays
from cartloom.llm.repeats import Unit, covered, distinct_texts, marks_of_texts, repeated_pieces, with_digest

WINDOW = 400
GROUP_PIECES = 12
#: Windows of a range at the second and at the last level.
RANGES = (26, 1)
#: Cells of the arrays that are worked on at once.
CELLS = 1_500_000
_BYTES = Rolling(21)


def _spans(part: Slice):
    at = np.arange(len(part.data) + 1)
    row = np.repeat(np.arange(len(part.start)), part.end - part.start)
    return row, at[:-1], at[1:], _BYTES.prefix(_BYTES.table[part.data]), _BYTES


def byte_unit(window: int) -> Unit:
    return Unit(window, max(1, window * 2 // 5), _spans)


def repeated_positions(groups: list[list[bytes]], window: int) -> list[list[np.ndarray]]:
    """For each group of texts, the places of each text where a string of ``window`` bytes starts that starts elsewhere in the group too."""
    order = sorted(range(len(groups)), key=lambda g: sum(map(len, groups[g])) + len(groups[g]))
    size = [sum(map(len, g)) + len(g) for g in groups]
    out: list[list[np.ndarray]] = [[] for _ in groups]
    i = 0
    while i < len(order):
        j = i + 1
        # lanes of like length together: little padding, and as many at once as the cells allow
        while j < len(order) and (j + 1 - i) * size[order[j]] <= CELLS and size[order[j]] <= 2 * size[order[i]] + 64:
            j += 1
        lanes = order[i:j]
        length = np.array([size[g] for g in lanes])
        most = max(len(groups[g]) for g in lanes)
        symbols = np.zeros((len(lanes), int(length.max())), dtype=np.int64)
        starts = []
        for lane, g in enumerate(lanes):
            at, mine = 0, []
            for k, text in enumerate(groups[g]):
                symbols[lane, at : at + len(text)] = np.frombuffer(text, dtype=np.uint8).astype(np.int64) + most
                mine.append(at)
                at += len(text) + 1
                symbols[lane, at - 1] = k + 1 if k + 1 < len(groups[g]) else 0
            starts.append(mine)
        array = suffix_arrays(symbols, length)
        common = permuted_common_prefixes(symbols, length, array)
        before = np.full(symbols.shape, -1, dtype=np.int64)
        lane_of, k = np.nonzero(array[:, 1:] >= 0)
        before[lane_of, array[lane_of, k + 1]] = array[lane_of, k]
        found = common >= window
        lane_of, at_ = np.nonzero(found)
        found[lane_of, before[lane_of, at_]] = True
        for lane, g in enumerate(lanes):
            hits = np.flatnonzero(found[lane])
            cuts = np.searchsorted(hits, [*starts[lane], symbols.shape[1]])
            out[g] = [(hits[a:b] - s).astype(np.int32) for a, b, s in zip(cuts[:-1], cuts[1:], starts[lane], strict=True)]
        i = j
    return out


def _in_shards(members: DataFrame, window: int) -> DataFrame:
    """``piece_id`` and ``offsets`` of the repeated windows of pieces that occur once, all pieces of a group being here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[list[tuple[bytes, bytes, int]]] = []
        held, key = 0, None

        def solve(ready: list[list[tuple[bytes, bytes, int]]]) -> pa.RecordBatch:
            marks = repeated_positions([[piece for _, piece, _ in g] for g in ready], window)
            rows = [(name, at) for g, places in zip(ready, marks, strict=True) for (name, _, n), at in zip(g, places, strict=True) if n == 1 and len(at)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], ["piece_id", "offsets"])

        for batch in batches:
            for k, name, piece, n in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if not groups or k != key:
                    if held > 4 * CELLS:
                        yield solve(groups)
                        groups, held = [], 0
                    groups.append([])
                    key = k
                groups[-1].append((name, piece, n))
                held += len(piece)
        if groups:
            yield solve(groups)

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.select("key", "piece_id", "piece", "n").repartition(parts, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "piece_id binary, offsets array<int>")


def _narrower(members: DataFrame, window: int, width: int) -> DataFrame:
    """The pieces cut into ranges of ``width`` windows by distance from the anchor: ``parent_id``, ``base``, ``key``, ``anchor``, ``piece``, ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, name, anchor, piece, n in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                last = len(piece) - window
                for r in range(max(0, anchor - last) // width, anchor // width + 1):
                    first, stop = max(0, anchor - (r + 1) * width + 1), min(last, anchor - r * width)
                    if first > stop:
                        continue
                    core = piece[anchor - r * width : anchor - (r + 1) * width + 1 + window]
                    digest = hashlib.blake2b(core, digest_size=8, salt=r.to_bytes(8, "little"), key=key.to_bytes(8, "little", signed=True)).digest()
                    rows.append((name, first, int.from_bytes(digest, "little", signed=True), anchor - first, piece[first : stop + window], n))
            if rows:
                types = [pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["parent_id", "base", "key", "anchor", "piece", "n"])

    return members.select("key", "piece_id", "anchor", "piece", "n").mapInArrow(run, "parent_id binary, base int, key long, anchor int, piece binary, n long")


def repeated_windows(pieces: DataFrame, window: int, widths: tuple[int, ...] = RANGES) -> DataFrame:
    """``piece_id``, ``n`` and ``offsets`` (null: all windows) of the pieces with repeated windows. ``pieces`` has ``key``, ``anchor``, ``piece``, ``n``."""
    distinct = written(pieces.groupBy("key", "anchor", "piece").agg(F.sum("n").alias("n")).withColumn("piece_id", F.unhex(F.md5("piece"))), "distinct")
    whole = distinct.filter("n > 1").select("piece_id", "n", F.lit(None).cast("array<int>").alias("offsets"))
    sizes = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("different")).filter("different > 1")
    members = lookup_join(distinct, sizes, ["key"], "different")
    if not widths:  # a range of one window: what is equal is one piece
        return whole
    one = F.lit(1).cast("long").alias("n")
    small = _in_shards(members.filter(F.col("different") <= GROUP_PIECES), window).select("piece_id", one, "offsets")
    cut = written(_narrower(members.filter(F.col("different") > GROUP_PIECES), window, widths[0]), "narrower")
    deeper = repeated_windows(cut.select("key", "anchor", "piece", "n"), window, widths[1:])
    mine = cut.filter("n = 1").select("parent_id", "base", F.octet_length("piece").alias("size"), F.unhex(F.md5("piece")).alias("piece_id"))
    back = lookup_join(mine, deeper, ["piece_id"], "n")
    every = F.sequence(F.lit(0), F.col("size") - window)
    offsets = F.transform(F.coalesce("offsets", every), lambda x: (x + F.col("base")).cast("int"))
    large = back.groupBy(F.col("parent_id").alias("piece_id")).agg(F.flatten(F.collect_list(offsets)).alias("offsets")).select("piece_id", one, "offsets")
    return whole.unionByName(small).unionByName(large)


def remove_repeats(docs: DataFrame, text_column: str = "text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """The documents with ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, if asked for, ``kept_bytes``."""
    (digest,) = own_columns(docs, "digest_")
    keyed = with_digest(docs, F.col(text_column), digest)
    texts = distinct_texts(keyed, F.col(text_column), digest)
    pieces = repeated_pieces(texts, byte_unit(window))
    marks = marks_of_texts(pieces, repeated_windows(pieces.withColumnRenamed("copies", "n"), window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies = np.asarray(batch.column(2))
            for part in slices(batch.column(1)):
                rows = slice(part.first, part.first + len(part.start))
                n_bytes = part.end - part.start
                gone = covered(part, n_bytes, copies[rows], batch.column(3)[rows].to_pylist(), window)
                texts, spans = [], []
                for a, b in zip(part.start.tolist(), part.end.tolist(), strict=True):
                    mine = gone[a:b]
                    spans.append(int((mine[1:] & ~mine[:-1]).sum()) + int(mine[:1].sum()))
                    texts.append(part.data[a:b][~mine].tobytes())
                out = [
                    batch.column(0).slice(part.first, len(texts)),
                    batch.column(2).slice(part.first, len(texts)),
                    pa.array(n_bytes.astype(np.int64)),
                    pa.array(n_bytes - np.array([len(t) for t in texts], dtype=np.int64)),
                    pa.array(spans, pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                ]
                names = ["digest", "copies", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    out.append(pa.array(texts, pa.binary()))
                    names.append("kept_bytes")
                yield pa.RecordBatch.from_arrays(out, names)

    schema = "digest binary, copies long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_bytes binary" if with_text else "")
    results = texts.join(marks, "digest", "left").select("digest", "text", "copies", "marks").mapInArrow(run, schema)
    values = [c for c in results.columns if c not in ("digest", "copies")]
    (out,) = own_columns(keyed, "out_")
    results = results.select(F.col("digest").alias(digest), F.struct(*values).alias(out), F.col("copies").alias("weight_"))
    back = lookup_join(keyed, results, [digest], "weight_", "left").drop("weight_")
    return replace_columns(back, {v: F.col(out)[v] for v in values}).drop(digest, out)


def op2_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).drop("text")


QUERIES = {"op2_repeated_bytes": op2_repeated_bytes}
ORACLE: dict[str, str] = {}
