"""The batch jobs on event streams."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cartloom.functions.urls import PUBLIC_SUFFIXES, with_url_components
from cartloom.operators.carts import normalize_raw_carts
from cartloom.operators.enrichment import enrich_cart
from cartloom.operators.product_ids import url_analysis
from cartloom.operators.product_views import normalize_raw_views
from cartloom.session import scratch_dir


def stream_normalize_views(events: DataFrame, registry: DataFrame) -> DataFrame:
    """Product views of a stream with the ids of the product's and all variants' URLs; stateless, like the batch job."""
    return normalize_raw_views(events, registry)


def stream_normalize_carts(events: DataFrame, registry: DataFrame) -> DataFrame:
    """Cart lines of a stream with their URL ids; stateless."""
    return normalize_raw_carts(events, registry)


def stream_url_dedup(urls: DataFrame, event_time: str, delay: str, url_col: str = "url", suffixes: Iterable[str] = PUBLIC_SUFFIXES) -> DataFrame:
    """First row per URL key within the watermark."""
    keyed = with_url_components(urls, url_col, suffixes).where(F.col("error").isNull())
    return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["key"])


def stream_batch_summary(
    urls: DataFrame, registry: DataFrame, event_time: str, delay: str, window: str = "5 minutes", store_col: str | None = None
) -> DataFrame:
    """Successful and failed URL analyses per tumbling window."""
    results = url_analysis(urls, registry, "url", store_col)
    return (
        results.withWatermark(event_time, delay)
        .groupBy(F.window(event_time, window).alias("w"))
        .agg(F.count(F.lit(1)).alias("total"), F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed"))
        .select(F.col("w.start").alias("window_start"), "total", "successful", "failed")
    )


def closed_sessions(carts: DataFrame, event_time: str, delay: str, gap: str) -> DataFrame:
    """Sessions whose gap has passed the watermark; each is emitted once, when no further event can join it."""
    return (
        carts.withWatermark(event_time, delay)
        .groupBy(F.session_window(event_time, gap).alias("w"), "session_id")
        .agg(F.count(F.lit(1)).alias("events"))
        .select("session_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")
    )


def stream_session_enrich(
    sessions: DataFrame,
    load_cart: Callable[[DataFrame], DataFrame],
    load_products: Callable[[DataFrame], DataFrame],
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    min_confidence: str = "high",
) -> StreamingQuery:
    """Enriches the carts of sessions as they close.

    The stream carries only the closed sessions; cart lines and products come from the tables the normalising streams
    write. The loaders get ``session_id, session_start, session_end`` of the closed windows: a loader of a table with event times takes the
    lines within them, so that a session id with several windows is enriched window by window, and prunes the table's days by the
    earliest start and latest end. ``sink`` must overwrite what an earlier try of the same batch wrote. Lines that arrive after their
    session closed stay in their table and are found by ``late_lines``.
    """

    def enrich(batch: DataFrame, batch_id: int) -> None:
        # written first: every read of the batch itself would run its state again
        path = scratch_dir(batch.sparkSession, "closed")
        batch.select("session_id", "session_start", "session_end").distinct().write.parquet(path)
        closed = batch.sparkSession.read.schema(batch.select("session_id", "session_start", "session_end").schema).parquet(path)
        sink(enrich_cart(load_cart(closed), load_products(closed), min_confidence), batch_id)

    return (
        sessions.writeStream.outputMode("append")
        .foreachBatch(enrich)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def late_lines(lines: DataFrame, closed: DataFrame, event_time: str) -> DataFrame:
    """Cart lines whose event time lies in no closed window of their session."""
    inside = (lines["session_id"] == closed["session_id"]) & lines[event_time].between(closed["session_start"], closed["session_end"])
    return lines.join(closed, inside, "left_anti")
