"""Removal of repeated multi-line chunks with content-defined boundaries.

Chunks come in two overlapping levels, and the boundaries of both follow from the lines themselves, so they are the same wherever a passage
stands. Fine chunks reach from each line with words to the next one: any repeated run of lines is a union of them, so a match extends
line by line to both sides as far as the lines are equal. Coarse chunks end where a line's own hash is divisible by ``DIVISOR``, hold two
lines with words at least and cover the whole text, lines without words included. Chunks whose hash repeats are fetched and compared byte
by byte; of equal chunks the first stays (by document id, then place in the text) and the lines of the others are removed, so the first
place of every line stays. A single line that repeats between other neighbours stays as well.

Defined cases: a null text stays null and has no lines; lines are what stands between line feeds, and those that stay are joined by line
feeds again; a document whose every line goes keeps an empty text; of lines that
repeat at once (A A A) the first stays; rows that are equal in id and text count as one document; null ids
come last in order; an empty table gives no rows; input columns named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartloom.llm.buffers import Rolling, Slice, line_spans, mix, slices, words
from cartloom.llm.common import WORD, lookup_join, read, written

DIVISOR = 3
LEAST_LINES = 2
_BYTES, _CHUNKS = Rolling(51), Rolling(53)


def chunks(part: Slice, divisor: int = DIVISOR) -> tuple[np.ndarray, ...]:
    """Row, first line in the row, number of lines, byte span, hash and place of the chunks; each has LEAST_LINES lines that hold a word.

    The place is twice the first line, plus one for coarse chunks."""
    start, end, row, bound = line_spans(part)
    key = mix(_BYTES.spans(_BYTES.prefix(_BYTES.table[part.data]), start, end) + (end - start).astype(np.uint64))
    w = words(part)
    full = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    before = np.append(0, np.cumsum(full))
    worded = np.flatnonzero(full)
    # fine: neighbours among the lines with words
    last = LEAST_LINES - 1
    near = np.flatnonzero(row[worded[last:]] == row[worded[: len(worded) - last]])
    fine, fine_stop = worded[near], worded[near + last] + 1
    # coarse: of lines with words in a row that could all end a chunk each second one does; none that leaves too few before or behind it
    ends = key[worded] % np.uint64(divisor) == 0
    at = before[worded] - before[bound[row[worded]]]
    behind = before[bound[row[worded] + 1]] - before[worded] - 1
    count = np.arange(len(worded))
    since = count - np.maximum.accumulate(np.where(~ends | (at == 0), count, 0))
    cut = ends & (since % LEAST_LINES == LEAST_LINES - 1) & (behind >= LEAST_LINES)
    whole = bound[1:][before[bound[1:]] - before[bound[:-1]] >= LEAST_LINES]
    stop = np.sort(np.concatenate([worded[cut] + 1, whole]))
    first = np.maximum(np.append(0, stop[:-1]), bound[row[stop - 1]])
    other = ~((before[stop] - before[first] == LEAST_LINES) & full[first] & full[stop - 1])  # those that aren't fine chunks
    first, stop = np.append(fine, first[other]), np.append(fine_stop, stop[other])
    level = np.arange(len(first)) >= len(fine)
    order = np.lexsort((level, first))
    first, stop, level = first[order], stop[order], level[order]
    hashes = mix(_CHUNKS.spans(_CHUNKS.prefix(key), first, stop) + (stop - first).astype(np.uint64))
    line = first - bound[row[first]]
    return row[first], line, stop - first, start[first], end[stop - 1], hashes, 2 * line + level


def _among(lists: pa.ListArray, part: Slice, row: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Indices of the chunks whose place stands in the list of their row."""
    lists = lists.slice(part.first, len(part.start))
    n = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
    asked = (np.repeat(np.arange(len(n)), n) << 32) | np.asarray(lists.flatten()).astype(np.int64)
    return np.flatnonzero(np.isin((row << 32) | place, asked))


def _chunk_table(keyed: DataFrame, id_column: str, divisor: int) -> DataFrame:
    """``hash``, ``doc_key``, ``id`` and ``place`` of every chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(2)):
                row, _, _, _, _, found, place = chunks(part, divisor)
                who = pa.array(row + part.first)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), batch.column(0).take(who), batch.column(1).take(who), pa.array(place.astype(np.int32))], ["hash", "doc_key", "id", "place"])

    source = keyed.select("doc_key", F.col(id_column).alias("id"), "text")
    schema = T.StructType([T.StructField("hash", T.LongType()), T.StructField("doc_key", T.BinaryType()), T.StructField("id", source.schema["id"].dataType), T.StructField("place", T.IntegerType())])
    return source.mapInArrow(run, schema)


def _chunk_bytes(texts: DataFrame, divisor: int) -> DataFrame:
    """The chunks at the places ``places`` of each text: ``doc_key``, ``id``, ``place`` and ``chunk``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(2)):
                row, _, _, begin, stop, _, place = chunks(part, divisor)
                pick = _among(batch.column(3), part, row, place)
                who = pa.array(row[pick] + part.first, pa.int64())
                found = [part.data[a:b].tobytes() for a, b in zip(begin[pick].tolist(), stop[pick].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(who), batch.column(1).take(who), pa.array(place[pick].astype(np.int32)), pa.array(found, pa.binary())], ["doc_key", "id", "place", "chunk"])

    schema = T.StructType([T.StructField("doc_key", T.BinaryType()), T.StructField("id", texts.schema["id"].dataType), T.StructField("place", T.IntegerType()), T.StructField("chunk", T.BinaryType())])
    return texts.select("doc_key", "id", "text", "places").mapInArrow(run, schema)


def _kept_lines(texts: DataFrame, kept: list[str], divisor: int) -> DataFrame:
    new = ["kept_text", "n_lines", "n_removed_lines", "n_removed_chunks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            none = np.asarray(batch.column(len(kept)).is_null())
            for part in slices(batch.column(len(kept))):
                n_rows = len(part.start)
                start, end, of, bound = line_spans(part)
                row, line, count, _, _, _, place = chunks(part, divisor)
                pick = _among(batch.column(len(kept) + 1), part, row, place)
                first = bound[row[pick]] + line[pick]
                # chunks overlap: a line goes when any of them holds it
                gone = np.cumsum(np.bincount(first, minlength=len(start) + 1) - np.bincount(first + count[pick], minlength=len(start) + 1))[:-1] > 0
                removed, dropped = np.bincount(of[gone], minlength=n_rows), np.bincount(row[pick], minlength=n_rows)
                texts = []
                for i in range(n_rows):
                    if dropped[i]:
                        stay = bound[i] + np.flatnonzero(~gone[bound[i] : bound[i + 1]])
                        texts.append(b"\n".join(part.data[a:b].tobytes() for a, b in zip(start[stay].tolist(), end[stay].tolist(), strict=True)))
                    else:
                        texts.append(None if none[part.first + i] else part.text(i))
                rows = batch.slice(part.first, n_rows)
                lines = np.where(none[part.first : part.first + n_rows], 0, np.diff(bound))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[: len(kept)], pa.array([t if t is None else t.decode("utf-8", "replace") for t in texts], pa.string()), pa.array(lines), pa.array(removed), pa.array(dropped)],
                    [*kept, *new],
                )

    source = texts.select(*kept, "text", "places")
    schema = T.StructType([*source.schema.fields[: len(kept)], T.StructField("kept_text", T.StringType()), *(T.StructField(c, T.LongType()) for c in new[1:])])
    return source.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", divisor: int = DIVISOR) -> DataFrame:
    """The documents with ``kept_text``, ``n_lines``, ``n_removed_lines`` and ``n_removed_chunks``."""
    new = {"kept_text", "n_lines", "n_removed_lines", "n_removed_chunks"}
    plain = [f"column_{i}" for i in range(len(docs.columns))]
    names = dict(zip(plain, docs.columns, strict=True))
    at_id, at_text = plain[docs.columns.index(id_column)], plain[docs.columns.index(text_column)]
    frame = docs.toDF(*plain)
    text: Column = F.col(at_text).cast("binary")
    key = F.unhex(F.md5(F.concat_ws("\x00", F.coalesce(F.col(at_id).cast("string"), F.lit("")), F.coalesce(F.md5(text), F.lit("")))))
    keyed = frame.withColumn("doc_key", key).withColumn("text", text)
    table = _chunk_table(keyed, at_id, divisor)
    counted = table.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = written(lookup_join(table, counted, ["hash"], "n").select("doc_key", "id", "place"), "chunks")
    asked = found.groupBy("doc_key").agg(F.collect_set("place").alias("places"))
    texts = keyed.join(asked.hint("merge"), "doc_key").select("doc_key", F.col(at_id).alias("id"), "text", "places").dropDuplicates(["doc_key"])
    compared = written(_chunk_bytes(texts, divisor), "compared")
    order = F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("doc_key"), F.col("place"))
    # grouping by the bytes is the comparison; equal chunks of a task are added up before they are shuffled
    equal = compared.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).filter("n > 1")
    equal = equal.select(F.unhex(F.md5("chunk")).alias("chunk_id"), "n", "first")
    repeats = lookup_join(compared.select(F.unhex(F.md5("chunk")).alias("chunk_id"), order.alias("place")), equal, ["chunk_id"], "n")
    gone = repeats.filter("place > first").groupBy(F.col("place.doc_key").alias("doc_key")).agg(F.collect_set("place.place").alias("places"))
    kept = [c for c in plain if names[c].lower() not in new]
    out = _kept_lines(keyed.join(gone.hint("merge"), "doc_key", "left"), kept, divisor)
    return out.toDF(*[names.get(c, c) for c in out.columns])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the text that stays; ``n_chars`` follows it. A document that has no word left after lines went from it goes as well."""
    changed = F.col("n_removed_lines") > 0
    out = dedup_lines(docs).filter(~changed | F.col("kept_text").rlike(WORD))
    values = {"text": F.col("kept_text"), "n_chars": F.when(changed, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))}
    return out.select(*[values.get(c, out[c]).alias(c) for c in docs.columns])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op8_line_dedup": op8_line_dedup}
ORACLE: dict[str, str] = {}
