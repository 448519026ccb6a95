"""Sessions that close soon and are corrected while late lines may still come.

Each session has a small state: first and last event time, number of lines and revision. A session closes when nothing has come for the gap,
seen from the latest event less a short delay; that issues revision 0. A line that arrives later, but within the lateness allowed, opens
it again and issues the next revision when it closes anew, which is at once if the line is old. When no line can come any more the
state goes. The lines themselves stay in their table, so no state grows with a session.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from cartloom.operators.enrichment import enrich_cart

_STATE = "first long, last long, lines long, revision int, is_open boolean"


def session_revisions(lines: DataFrame, event_time: str, gap: str, delay: str, lateness: str, key: str = "session_id") -> DataFrame:
    """``key``, ``revision``, ``session_start``, ``session_end`` and ``lines`` each time a session closes, the first time or after late lines.

    ``gap``, ``delay`` and ``lateness`` are pandas time deltas such as ``30 minutes``; lines more than ``lateness`` behind the latest event are
    dropped by Spark's watermark. Rows without a time or a key are no lines.
    """
    gap_ms, delay_ms, late_ms = (int(pd.Timedelta(x).total_seconds() * 1000) for x in (gap, delay, lateness))
    if delay_ms > late_ms:
        raise ValueError("a session can't close later than its last line may come")
    kind = lines.schema[key].dataType.simpleString()
    out = f"`{key}` {kind}, revision int, first long, last long, lines long"

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, n, revision, is_open = state.get if state.exists else (2**62, -(2**62), 0, -1, False)
        for batch in batches:
            if not state.hasTimedOut:
                times = batch["t"].to_numpy()
                first, last, n, is_open = min(first, int(times.min())), max(last, int(times.max())), n + len(times), True
        # the watermark is the latest event less the lateness, so this is the latest event less the delay
        clock = state.getCurrentWatermarkMs() + late_ms - delay_ms
        closes = last + gap_ms
        if is_open and clock >= closes:
            revision, is_open = revision + 1, False
            yield pd.DataFrame({key: [group[0]], "revision": [revision], "first": [first], "last": [last], "lines": [n]})
        # an open session waits for its closing, a closed one for the time from which its lines would be dropped
        wait = closes - late_ms + delay_ms if is_open else closes
        if not is_open and state.getCurrentWatermarkMs() >= closes:
            if state.exists:
                state.remove()
            return
        state.update((first, last, n, revision, is_open))
        state.setTimeoutTimestamp(max(wait, state.getCurrentWatermarkMs() + 1))

    rows = lines.filter(F.col(event_time).isNotNull() & F.col(key).isNotNull())
    marked = rows.withWatermark(event_time, f"{late_ms} milliseconds").select(key, event_time, F.unix_millis(event_time).alias("t"))
    closed = marked.groupBy(key).applyInPandasWithState(step, out, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return closed.select(key, "revision", F.timestamp_millis("first").alias("session_start"), F.timestamp_millis("last").alias("session_end"), "lines")


def stream_enrich_with_corrections(
    revisions: DataFrame,
    load_cart: Callable[[DataFrame], DataFrame],
    load_products: Callable[[DataFrame], DataFrame],
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    min_confidence: str = "high",
    key: str = "session_id",
) -> StreamingQuery:
    """Enriches the whole cart of a session at each of its revisions; the sink gets the enriched lines with ``revision`` and ``session_end``.

    The loaders get the sessions of the batch and read the tables that the normalising streams write. ``sink`` must overwrite what an
    earlier try of the same batch wrote.
    """

    def enrich(batch: DataFrame, batch_id: int) -> None:
        # of several revisions in a batch the last one has seen all lines of the others
        of_session = Window.partitionBy(key).orderBy(F.col("revision").desc())
        closed = batch.withColumn("n_", F.row_number().over(of_session)).filter("n_ = 1").select(key, "revision", "session_end")
        enriched = enrich_cart(load_cart(closed.select(key)), load_products(closed.select(key)), min_confidence)
        sink(enriched.join(closed, key), batch_id)

    return revisions.writeStream.outputMode("append").foreachBatch(enrich).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_revisions(enriched: DataFrame, key: str = "session_id") -> DataFrame:
    """The lines of each session's last revision, without the columns that tell it."""
    last = enriched.groupBy(F.col(key).alias("of_")).agg(F.max(F.struct("session_end", "revision")).alias("last_"))
    same = (F.col(key) == F.col("of_")) & (F.col("session_end") == F.col("last_.session_end")) & (F.col("revision") == F.col("last_.revision"))
    return enriched.join(last, same).select(*[c for c in enriched.columns if c not in ("revision", "session_end")])
