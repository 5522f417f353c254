"""Incremental work: an ordered outbox, cursors, limits by window, sessions.

The same functions take batch and streaming DataFrames where the text says so. Windows
with watermarks and sessions go beyond what the catalogue itself needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import catalog


def window_counts(events: DataFrame, time: str, key: str, width: str, late: str | None = None) -> DataFrame:
    """(key, start, n) by fixed windows from the epoch; with a watermark for streams."""
    source = events.withWatermark(time, late) if late else events
    return source.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def over_limit(counts: DataFrame, most: int) -> DataFrame:
    """Windows above the limit, with how many events were too many."""
    return counts.where(F.col("n") > most).withColumn("rejected", F.col("n") - most)


def session_counts(events: DataFrame, time: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    """(key, start, n) of sessions that end after a gap."""
    source = events.withWatermark(time, late) if late else events
    return source.groupBy(F.session_window(time, gap).alias("s"), key).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), "n")


def drain_outbox(stream: DataFrame, order: str, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand every batch to `apply` in id order; a failure stops the query, and a restart takes up the same batch."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, n: apply(df.orderBy(order), n)).start()


def latest_per_title(changes: DataFrame) -> DataFrame:
    """Newest change of each title in the main namespace; changes (ns, title, rev_id, ts)."""
    return catalog.first_per(changes.where("ns = 0"), ["title"], F.desc("ts"), F.desc("rev_id"))


def safe_cursor(changes: DataFrame) -> DataFrame:
    """One row: the time up to which all changes succeeded, never past the oldest failure; changes (ts, ok)."""
    oldest = F.min(F.when(~F.col("ok"), F.col("ts")))
    return changes.agg(F.coalesce(oldest, F.max("ts")).alias("cursor"))


def moderate(log: DataFrame) -> DataFrame:
    """Current status of each id from its log (id, seq, action): amended after an amendment, rejected ends it, else auto."""
    any_of = lambda a: F.coalesce(F.bool_or(F.col("action") == a), F.lit(False))
    state = F.when(any_of("reject"), "rejected").when(any_of("amend"), "amended").otherwise("auto")
    return log.groupBy("id").agg(state.alias("status"))
