"""WARC archives in which equal payloads are stored once.

Headers are shuffled by payload digest to find the original of each group of equal payloads; each revisit record names the record it repeats;
the archives are written with fresh headers as gzip files of consecutive records and are read back as a stream, one record in memory
at a time. Writing and reading go through Spark's text source, so any store that Spark reaches will do.

Defined cases: a null payload is empty; payloads under ``LEAST_BYTES`` are never revisits; the smallest id of a group is its response,
and rows that repeat that id are responses as well; a row without id can only be a response where no row of its group has one; a
null URL leaves the header line out, and line breaks within a URL are dropped; an empty table gives an archive without records.
Other input columns aren't archived.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom.llm.common import lookup_join, read
from cartloom.session import scratch_dir

LEAST_BYTES = 100
END = "\r\n"
_RECORDS = "record_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string"


def resolve_revisits(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Records: ``id``, ``url``, ``payload``, ``payload_bytes``, ``payload_digest``, and ``refers_to``, the id of the response that a
    revisit repeats, else null."""
    payload = F.coalesce(F.col(payload_column), F.lit(""))
    records = pages.select(
        F.col(id_column).cast("string").alias("id"),
        F.col(id_column).alias("order_"),
        F.regexp_replace(url_column, r"[\r\n]", "").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload.cast("binary"), 256).alias("payload_digest"),
    )
    headers = records.filter(F.col("payload_bytes") >= least_bytes).select("payload_digest", "order_")
    originals = headers.groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n_"), F.min("order_").alias("first_")).filter("n_ > 1")
    found = lookup_join(records, originals, ["payload_digest"], "n_", "left")
    repeats = F.col("first_").isNotNull() & ~F.col("first_").eqNullSafe(F.col("order_"))
    return found.select("id", "url", "payload", "payload_bytes", "payload_digest", F.when(repeats, F.col("first_").cast("string")).alias("refers_to"))


def record_urn(record_id: Column, payload_digest: Column) -> Column:
    """The record's name: a UUID made of its id and payload, so a revisit can name its response without looking it up."""
    digest = F.md5(F.concat_ws(":", F.when(record_id.isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(record_id, F.lit("")), payload_digest))
    # the version and variant that mark a UUID made of a digest
    parts = [F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("3"), F.substring(digest, 14, 3)), F.concat(F.lit("8"), F.substring(digest, 18, 3)), F.substring(digest, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write_archives(records: DataFrame, path: str, content_type: str = "text/html; charset=utf-8") -> None:
    """A gzip file per partition: response records with payload, revisit records without; all are dated by the start of the job."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    flat = lambda c: F.regexp_replace(F.col(c), r"[\r\n]", " ")
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    revisit = F.col("refers_to").isNotNull()
    text = F.concat(
        F.lit(f"WARC/1.1{END}"),
        F.when(revisit, F.lit(f"WARC-Type: revisit{END}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{END}")).otherwise(F.lit(f"WARC-Type: response{END}")),
        line("WARC-Record-ID", record_urn(F.col("id"), F.col("payload_digest"))),
        line("WARC-Date", F.lit(date)),
        F.when(revisit, line("WARC-Refers-To", record_urn(F.col("refers_to"), F.col("payload_digest")))).otherwise(F.lit("")),
        F.coalesce(line("X-Row-ID", flat("id")), F.lit("")),
        F.coalesce(line("X-Refers-To-Row-ID", flat("refers_to")), F.lit("")),
        F.coalesce(line("WARC-Target-URI", F.col("url")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, F.lit("")).otherwise(line("Content-Type", F.lit(content_type))),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit(END),
        F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    )
    # each row ends with the two line breaks that close a record
    records.select(text.alias("value")).write.option("lineSep", END * 2).option("compression", "gzip").text(path)


def _records(lines: Iterator[tuple[str, bytes]], with_payload: bool) -> Iterator[tuple]:
    """Records of archive lines, which were split at each line feed."""
    head: list[bytes] | None = None
    body: list[bytes] = []
    fields: dict[bytes, bytes] = {}
    file, need, have = None, -1, 0
    for path, raw in lines:
        if path != file:
            if head or need >= 0:
                raise ValueError(f"{file} ends within a record")
            file, head, need = path, None, -1
        if need < 0:
            if head is None:
                if raw.rstrip(b"\r") != b"WARC/1.1":
                    raise ValueError(f"no record starts at {raw[:40]!r} in {file}")
                head = []
            elif raw == b"\r":
                fields = {k.strip(): v.strip() for k, _, v in (x.partition(b":") for x in head)}
                need, have, body = int(fields[b"Content-Length"]) + 4, 0, []
            else:
                head.append(raw)
            continue
        body.append(raw)
        have += len(raw) + 1
        if have < need:
            continue
        if have > need:
            raise ValueError(f"a record of {file} is longer than its header says")
        payload = b"\n".join(body)[:-3]  # without the closing \r\n\r, whose last line feed was split off
        digest = fields[b"WARC-Payload-Digest"].removeprefix(b"sha256:").decode()
        text = lambda x: x.decode() if x is not None else None
        kind = fields[b"WARC-Type"].decode()
        if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"a payload of {file} differs from its digest")
        row = (text(fields.get(b"X-Row-ID")), text(fields.get(b"WARC-Target-URI")), kind, int(fields[b"X-Payload-Length"]), digest, text(fields.get(b"X-Refers-To-Row-ID")))
        yield (*row, payload if kind == "response" else None) if with_payload else row
        head, need = None, -1
    if head is not None or need >= 0:
        raise ValueError(f"{file} ends within a record")


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of archives that ``write_archives`` wrote. Payloads are checked against their digests."""
    schema = _RECORDS + (", payload binary" if with_payload else "")
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * with_payload
    names = [x.split()[0] for x in schema.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lines() -> Iterator[tuple[str, bytes]]:
            for b in batches:
                yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)

        rows, held = [], 0
        for row in _records(lines(), with_payload):
            rows.append(row)
            held += len(row[6] or b"") if with_payload else 0
            if len(rows) >= 4096 or held > 8_000_000:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                rows, held = [], 0
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    # gzip files aren't split, so the lines of a file come to one task in order
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary"))
    return lines.mapInArrow(parse, schema)


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    path = scratch_dir(spark, "warc")
    write_archives(resolve_revisits(pages), path)
    back = read_archives(spark, path)
    return back.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


QUERIES = {"op10_warc_revisits": op10_warc_revisits}

ORACLE = {
    "op10_warc_revisits": """
WITH p AS (SELECT page_id, coalesce(strlen(html), 0)::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first_id IS DISTINCT FROM page_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to
FROM g"""
}
