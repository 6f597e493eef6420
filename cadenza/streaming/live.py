"""The same rules on arriving files and events, by Structured Streaming.

Streams need `ts` as a timestamp (not without zone) for their watermark.
Results match the stored-event forms for everything the watermark has closed.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cadenza.operators.chains import NO_KEY, Rule
from cadenza.sources.ingest import Workspace, ingest_files, staged_files
from cadenza.streaming.flow import MAX_BATCH, SECOND
from cadenza.streaming.stateful import MATCHES, STARTS, LimitProcessor, RunProcessor, ThrottleProcessor, WaitProcessor

TS, ID = "ts", "event_id"


def ingest_stream(
    spark: SparkSession,
    workspace: Workspace,
    source: str,
    checkpoint: str,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Ingest all files waiting in a layout's staging folder, then stop.

    The stream is one of file names; each micro-batch ingests its files as a
    batch does, by their own headers, so a file that cannot be read is FAILED in
    the ledger and stops nothing. A run is named by layout, stream and number:
    a repeated micro-batch replaces what it wrote, and no stream another's.
    """
    folder = f"{workspace.staging}/{source}"
    names = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
        .select("path")
    )
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def store(batch: DataFrame, number: int) -> None:
        paths = [r["path"] for r in batch.collect()]  # at most files_per_batch
        if not paths:
            return
        files = staged_files(spark, workspace, {}, folder, paths).withColumn("source", F.lit(source))
        ingest_files(spark, workspace, files.collect(), f"{source}-{stream}-{number}")

    return (
        names.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def with_event_time(events: DataFrame, delay: str) -> DataFrame:
    """Events with a watermark; a time without zone is read as UTC."""
    return events.withColumn(TS, F.col(TS).cast("timestamp")).withWatermark(TS, delay)


def dedup(events: DataFrame, key: list[str]) -> DataFrame:
    """One event per key within the watermark's reach."""
    return events.dropDuplicatesWithinWatermark(key)


def windowed(events: DataFrame, key: str, length: str, slide: str | None = None) -> DataFrame:
    span = F.window(TS, length, slide) if slide else F.window(TS, length)
    return events.groupBy(key, span.alias("w")).agg(F.count("*").alias("n")).select(
        key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n"
    )


def sessions(events: DataFrame, key: str, gap: str) -> DataFrame:
    return (
        events.groupBy(key, F.session_window(TS, gap).alias("w"))
        .agg(F.count("*").alias("n"))
        .select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    )


def debounce(events: DataFrame, key: str, period: int) -> DataFrame:
    """Last event of each session; the session's end is when it fires."""
    last = F.max_by(F.col(ID), F.struct(TS, ID)).alias(ID)
    return (
        events.groupBy(key, F.session_window(TS, f"{period} seconds").alias("w"))
        .agg(last)
        .select(key, ID, F.col("w.end").alias("fire_at"))
    )


def wait_for(events: DataFrame, matches: DataFrame, key: str, timeout: int) -> DataFrame:
    """Each event with the matching events that follow in time (in id where times are equal), or none.

    For two streams: an outer join bounded in time by both watermarks. The first
    match per event is the least (match_ts, match_id); a sink keeps it with
    `first_match`. `await_first` gives it at once where both kinds come in one stream.
    """
    found = matches.select(
        F.col(key).alias("_key"), F.col(ID).alias("match_id"), F.col(TS).alias("match_ts")
    )
    in_time = (
        (F.col("_key") == F.col(key))
        & (F.struct("match_ts", "match_id") > F.struct(F.col(TS), F.col(ID)))
        & (F.col("match_ts") >= F.col(TS))
        & (F.col("match_ts") <= F.col(TS) + F.expr(f"INTERVAL {int(timeout)} SECONDS"))
    )
    return events.join(found, in_time, "left_outer").drop("_key")


def first_match(joined: DataFrame, key: str) -> DataFrame:
    """Earliest match per event of stored `wait_for` output."""
    best = F.min(
        F.when(F.col("match_id").isNotNull(), F.struct("match_ts", "match_id"))
    ).alias("m")
    return joined.groupBy(key, ID, TS).agg(best).select(
        key, ID, TS, F.col("m.match_id").alias("match_id"), F.col("m.match_ts").alias("match_ts")
    )


def _keyed(events: DataFrame, key: str, *more: str) -> DataFrame:
    """State needs a key: events without one share NO_KEY, which no text key is."""
    return events.select(
        F.coalesce(F.col(key).cast("string"), F.lit(NO_KEY)).alias("key"), ID, TS, *more
    )


def await_first(events: DataFrame, key: str, name: str, awaited: str, timeout: int) -> DataFrame:
    """Each `name` event with the first `awaited` one of its key after it, or null once `timeout` has passed.

    Exactly one row per starting event, as `flow.wait_for` has it. Equal times
    go by id; an event may wait for its own kind. Other events, and any that
    arrive behind the watermark, have no part.
    """
    kind = F.when(F.col("event_type") == name, STARTS).otherwise(0) + F.when(F.col("event_type") == awaited, MATCHES).otherwise(0)
    chosen = events.where(F.col("event_type").isin(name, awaited)).withColumn("kind", kind.cast("long"))
    return _stateful(chosen, key, WaitProcessor(timeout * SECOND), "kind")


def cancel_on(events: DataFrame, key: str, name: str, cancelled_by: str, timeout: int) -> DataFrame:
    """Each `name` event that no `cancelled_by` one of its key followed in time, as `flow.cancel_on` has it."""
    return await_first(events, key, name, cancelled_by, timeout).where("match_id IS NULL").drop("match_id", "match_ts")


def _stateful(events: DataFrame, key: str, processor, *more: str) -> DataFrame:
    return (
        _keyed(events, key, *more)
        .groupBy("key")
        .transformWithStateInPandas(
            statefulProcessor=processor,
            outputStructType=processor.OUTPUT,
            outputMode="Append",
            timeMode="EventTime",
        )
    )


def batch_events(events: DataFrame, key: str, max_size: int, timeout: int) -> DataFrame:
    """One row per closed batch."""
    if not 1 <= max_size <= MAX_BATCH:
        raise ValueError(f"max_size must be between 1 and {MAX_BATCH}")
    return _stateful(events, key, RunProcessor(Rule(span=timeout * SECOND, size=max_size)))


def debounce_capped(events: DataFrame, key: str, period: int, timeout: int) -> DataFrame:
    """One row per fired debounce; `last_id` is the event it fires with."""
    return _stateful(
        events, key, RunProcessor(Rule(span=timeout * SECOND, gap=period * SECOND))
    )


def singleton_skip(events: DataFrame, key: str, duration: int) -> DataFrame:
    """One row per run; `first_id` is the event that started it."""
    return _stateful(events, key, RunProcessor(Rule(span=duration * SECOND)))


def rate_limit(events: DataFrame, key: str, limit: int, period: int) -> DataFrame:
    """The events let through."""
    return _stateful(events, key, LimitProcessor(limit, period * SECOND))


def throttle(events: DataFrame, key: str, limit: int, period: int) -> DataFrame:
    """Every event with its release time."""
    return _stateful(events, key, ThrottleProcessor(limit, period * SECOND))
