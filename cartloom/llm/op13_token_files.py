"""Token-id files: texts as ids, range-coded in independent blocks, with an index of documents.

A file holds a run of documents in ascending id order; the files' numbers give the order of the runs. Ids stand one after another and are
cut into blocks of ``range_coder.BLOCK``, whatever documents they belong to; each block carries a checksum of its ids and is coded by itself,
given how often each id comes up in the blocks written together with it.
Files are written and read through Spark's own sources, so any store that Spark reaches will do.

Layout of a file: records of a tag byte, the payload's length (32 bits), the payload and a line feed; numbers are little-endian.

    H  file's number (64), size of the vocabulary (32), ids of a block (32)
    T  the ids that come up in the blocks up to the next such record, and what each takes of the code space (32 each; compressed by zlib)
    B  number of ids (32), CRC-32 of the ids as 32-bit numbers (32), code: one for each block, in order
    D  number of documents (32), their ids (64 each), a byte each that is 1 for a null id, their numbers of ids (64 each)
    E  number of documents (64), of ids (64), of blocks (64): the last record; a file without it, or with other sums, is refused

Defined cases: a null text is an empty one and holds the end id alone; a null document id comes last; rows with the same id are documents of
their own, in the table's order; texts are encoded whole, whatever their length; an empty table gives no documents; other columns of the
table aren't written.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartloom.llm import range_coder
from cartloom.llm.buffers import slices
from cartloom.llm.common import read, written
from cartloom.llm.word_ids import kept
from cartloom.session import scratch_dir

END_ID = 1
#: Bytes of text in a file, on average.
FILE_BYTES = 32_000_000
#: Bytes of text encoded at once, unless a text is longer.
ENCODE_BYTES = 6_000_000
_MISSING = "no end of the file's records"


def _record(tag: bytes, payload: bytes) -> bytes:
    return tag + struct.pack("<I", len(payload)) + payload


class FileWriter:
    """Records of one file, from documents in order."""

    def __init__(self, number: int, vocabulary: int):
        self.number, self.vocabulary = number, vocabulary
        self.held: list[np.ndarray] = []
        self.waiting = self.documents = self.ids = self.blocks = 0

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> Iterator[bytes]:
        if not self.documents:
            yield _record(b"H", struct.pack("<QII", self.number, self.vocabulary, range_coder.BLOCK))
        self.documents += len(sizes)
        self.ids += len(ids)
        yield _record(b"D", struct.pack("<I", len(sizes)) + doc_ids.astype("<i8").tobytes() + nulls.astype("u1").tobytes() + sizes.astype("<u8").tobytes())
        self.held.append(ids)
        self.waiting += len(ids)
        most = range_coder.BLOCK * range_coder.LANES
        if self.waiting >= most:
            yield from self._blocks(self.waiting // most * most)

    def _blocks(self, n: int) -> Iterator[bytes]:
        every = np.concatenate(self.held)
        self.held, self.waiting = [every[n:]], len(every) - n
        blocks = [every[i : min(i + range_coder.BLOCK, n)] for i in range(0, n, range_coder.BLOCK)]
        for first in range(0, len(blocks), range_coder.LANES):
            part = blocks[first : first + range_coder.LANES]
            table = range_coder.frequencies(every[first * range_coder.BLOCK : min((first + len(part)) * range_coder.BLOCK, n)], self.vocabulary)
            used = np.flatnonzero(table)
            yield _record(b"T", zlib.compress(used.astype("<u4").tobytes() + table[used].astype("<u4").tobytes()))
            for block, code in zip(part, range_coder.encode(part, self.vocabulary, table), strict=True):
                self.blocks += 1
                yield _record(b"B", struct.pack("<II", len(block), zlib.crc32(block.astype("<u4").tobytes())) + code)

    def end(self) -> Iterator[bytes]:
        if self.documents:
            yield from self._blocks(self.waiting)
            yield _record(b"E", struct.pack("<QQQ", self.documents, self.ids, self.blocks))


class FileReader:
    """The content of one file; refuses what isn't whole."""

    def __init__(self, content: bytes):
        self.blocks: list[tuple[int, int, bytes]] = []
        #: The frequencies, and the number of blocks before the first that is coded by them.
        self.tables: list[tuple[np.ndarray, int]] = []
        doc_ids, nulls, sizes = [np.empty(0, dtype="<i8")], [np.empty(0, dtype="u1")], [np.empty(0, dtype="<u8")]
        at, ended = 0, not content
        while at < len(content):
            tag, (size,) = content[at : at + 1], struct.unpack_from("<I", content, at + 1)
            payload = content[at + 5 : at + 5 + size]
            if ended or len(payload) < size or content[at + 5 + size : at + 6 + size] != b"\n":
                raise ValueError(_MISSING)
            at += size + 6
            if tag == b"H":
                self.number, self.vocabulary, self.block = struct.unpack("<QII", payload)
            elif tag == b"T":
                used, size = np.frombuffer(zlib.decompress(payload), "<u4").reshape(2, -1)
                table = np.zeros(self.vocabulary, dtype=np.uint32)
                table[used] = size
                self.tables.append((table, len(self.blocks)))
            elif tag == b"B":
                self.blocks.append((*struct.unpack_from("<II", payload), payload[8:]))
            elif tag == b"D":
                (n,) = struct.unpack_from("<I", payload)
                doc_ids.append(np.frombuffer(payload, "<i8", n, 4))
                nulls.append(np.frombuffer(payload, "u1", n, 4 + 8 * n))
                sizes.append(np.frombuffer(payload, "<u8", n, 4 + 9 * n))
            elif tag == b"E":
                sums, ended = struct.unpack("<QQQ", payload), True
            else:
                raise ValueError(f"unknown record {tag!r}")
        self.doc_ids, self.nulls = np.concatenate(doc_ids), np.concatenate(nulls).astype(bool)
        self.ends = np.cumsum(np.concatenate(sizes).astype(np.int64))
        self.documents = len(self.doc_ids)
        if not ended or (content and sums != (self.documents, self.ends[-1], len(self.blocks))):
            raise ValueError(_MISSING)

    def ids(self, codes: Iterator[np.ndarray]) -> np.ndarray:
        """All ids as 32-bit numbers, from this file's decoded blocks; checks them."""
        out = np.empty(int(self.ends[-1]), dtype="<u4")
        at = 0
        for n, checksum, _ in self.blocks:
            out[at : at + n] = next(codes)
            if zlib.crc32(out[at : at + n].tobytes()) != checksum:
                raise ValueError("a block's ids don't match its checksum")
            at += n
        return out


def decoded(files: list[FileReader]) -> Iterator[np.ndarray]:
    """Every block of the files; those of a table are decoded side by side."""
    files = [f for f in files if f.blocks]
    for f in files:
        if f.vocabulary != files[0].vocabulary:
            raise ValueError("files of different vocabularies in one folder")
        ends = [first for _, first in f.tables[1:]] + [len(f.blocks)]
        for (table, first), end in zip(f.tables, ends, strict=True):
            for at in range(first, end, range_coder.LANES):
                part = f.blocks[at : min(at + range_coder.LANES, end)]
                yield from range_coder.decode([b[2] for b in part], [b[0] for b in part], f.vocabulary, table)


def write_token_files(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", tokenizer: str | None = None, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> None:
    """Writes the texts' ids, each text followed by ``end_id``, to files below ``path`` in ascending order of the id (a whole number)."""
    spark = docs.sparkSession
    with open(tokenizer or public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        content = spark.sparkContext.broadcast(f.read())  # of a fixed size
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("binary").alias("text"), F.monotonically_increasing_id().alias("row"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // file_bytes))
    order = [F.col("id").asc_nulls_last(), F.col("row")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(content.value)
        writer = FileWriter(TaskContext.get().partitionId(), max(encoder.tokenizer.get_vocab_size(), end_id + 1))
        end = np.array([end_id], dtype=np.int32)
        for batch in batches:
            nulls, doc_ids = np.asarray(batch.column(0).is_null()), np.asarray(batch.column(0).fill_null(0))
            for part in slices(batch.column(1), ENCODE_BYTES):
                rows = slice(part.first, part.first + len(part.start))
                ids, sizes = encoder.encode(batch.column(1)[rows])
                ids = np.insert(ids, np.cumsum(sizes), end)
                for record in writer.add(doc_ids[rows], nulls[rows], sizes + 1, ids):
                    yield pa.record_batch([pa.array([record], pa.binary())], ["value"])
        # what Arrow keeps from the texts gives way to the blocks
        pa.default_memory_pool().release_unused()
        for record in writer.end():
            yield pa.record_batch([pa.array([record], pa.binary())], ["value"])

    # a document stands where its id puts it, so the ranges are cut over the texts' keys and every file is sorted by itself
    placed = rows.repartitionByRange(n_files, *order).sortWithinPartitions(*order)
    placed.select("id", "text").mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: ``file``, ``place`` (ids before it in the file), ``doc_id`` and ``ids`` (32-bit little-endian numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [f for i in range(batch.num_rows) if (f := FileReader(batch.column(0)[i].as_py())).documents]
            codes = decoded(files)
            for f in files:
                ids = f.ids(codes)
                begin = np.append(0, f.ends[:-1])
                for first in range(0, f.documents, 10_000):
                    some = slice(first, first + 10_000)
                    found = [ids[a:b].tobytes() for a, b in zip(begin[some].tolist(), f.ends[some].tolist(), strict=True)]
                    yield pa.record_batch(
                        [pa.array(np.full(len(found), f.number, dtype=np.int64)), pa.array(begin[some]), pa.array(f.doc_ids[some], pa.int64(), mask=f.nulls[some]), pa.array(found, pa.binary())],
                        ["file", "place", "doc_id", "ids"],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, "file long, place long, doc_id long, ids binary")


def token_index(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32`` of what ``read_token_files`` returns."""
    rows = written(documents.select("file", "place", "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")), "token_index")
    # one row a file
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(files, "file").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "token_files")
    write_token_files(read(spark, sf_dir, "documents"), path)
    return token_index(read_token_files(spark, path))


QUERIES = {"op13_token_files": op13_token_files}
ORACLE: dict[str, str] = {}
