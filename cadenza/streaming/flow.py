"""Event flow control over stored events. Durations are in seconds.

Each function follows one rule of event-driven work: which events start a run,
when, and with what. `key` names the column a rule is applied within.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.operators.chains import Rule, runs
from cadenza.operators.ordered import (
    SLICE_ROWS,
    ordered,
    with_next,
    with_next_where,
    with_position,
    with_running_max,
)
from cadenza.operators.windows import distinct_on

# Bounds of a batch.
MAX_BATCH = 100
MIN_BATCH_SECONDS, MAX_BATCH_SECONDS = 1, 60

TS, ID = "ts", "event_id"
ORDER = (TS, ID)
SECOND = 1_000_000


def micros(col: Column) -> Column:
    return F.unix_micros(col.cast("timestamp"))


def at(value: Column) -> Column:
    """Microseconds as a time without zone."""
    return F.timestamp_micros(value).cast("timestamp_ntz")


def later(col: Column, seconds: int) -> Column:
    return col + F.make_dt_interval(secs=F.lit(seconds))


ENVELOPE = "id string, name string, data string, ts bigint, v string"


def parse_envelope(rows: DataFrame, column: str, data_schema: str) -> DataFrame:
    """Event envelopes from JSON text; `data` is parsed with the given schema."""
    parsed = rows.select(F.from_json(column, ENVELOPE).alias("e")).select("e.*")
    return parsed.withColumns(
        {"data": F.from_json("data", data_schema), "ts": at(F.col("ts") * 1000)}
    )


def trigger(events: DataFrame, name: str, condition: str | None = None) -> DataFrame:
    """Events that start a run: by name and, if given, a SQL condition."""
    named = events.where(F.col("event_type") == name)
    return named if condition is None else named.where(condition)


def dedup(events: DataFrame, key: list[str]) -> DataFrame:
    """First event per idempotency key."""
    return distinct_on(events, key, [F.asc(c) for c in ORDER])


def rate_limit(events: DataFrame, key: str, limit: int, period: int) -> DataFrame:
    """First `limit` events per key and period; the rest are dropped.

    Periods are aligned to the epoch. The rank filter keeps `limit` rows per
    group in every task before the shuffle, so a busy key sends few.
    """
    period_no = F.floor(micros(F.col(TS)) / (period * SECOND))
    first = W.partitionBy(key, "_period").orderBy(*ORDER)
    return (
        events.withColumn("_period", period_no)
        .withColumn("_n", F.row_number().over(first))
        .where(F.col("_n") <= limit)
        .drop("_period", "_n")
    )


def debounce(
    events: DataFrame,
    key: str,
    period: int,
    timeout: int | None = None,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """The last event before each quiet period, with the time it fires.

    An event just as the period ends still extends it. With `timeout`, a run of events fires at the latest that long after its
    first event, and the next event starts afresh.
    """
    if timeout is None:
        data = ordered(events, [key], ORDER, slice_rows)
        last = with_next(data, TS, "_next").done()
        quiet = micros(F.col("_next")) - micros(F.col(TS)) > period * SECOND
        return (
            last.where(F.col("_next").isNull() | quiet)
            .drop("_next")
            .withColumn("fire_at", later(F.col(TS), period))
        )
    rule = Rule(span=timeout * SECOND, gap=period * SECOND)
    chained = runs(events, key, TS, ID, rule, slice_rows)
    rest = [c for c in events.columns if c not in (key, TS, ID)]
    newest = F.max(F.struct(TS, ID, *rest)).alias("e")
    fire = F.least(later(F.col(TS), period), later(at(F.col("run_ts")), timeout))
    return (
        chained.groupBy(key, "run_ts", "run_id")
        .agg(newest)
        .select(key, "run_ts", "e.*")
        .select(*events.columns, fire.alias("fire_at"))
    )


def throttle(
    events: DataFrame,
    key: str,
    limit: int,
    period: int,
    burst: int = 0,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """When each event is let through: `limit` per period, the others queue.

    The n-th event of a key waits for a place in lane n mod limit, which frees
    one place per period. So its release is m * period plus the greatest
    (time - m * period) in its lane so far, with m = n div limit. The first
    `burst` events pass at once and take no place.
    """
    data = with_position(ordered(events, [key], ORDER, slice_rows), "_n")
    n = F.col("_n") - burst
    span = period * SECOND
    queued = data.rows.withColumns(
        {
            "_lane": F.when(n < 0, -1).otherwise(F.pmod(n, F.lit(limit))),
            "_shift": F.when(n < 0, 0).otherwise(F.floor(n / limit) * span),
        }
    ).withColumn("_due", micros(F.col(TS)) - F.col("_shift"))
    done = with_running_max(data.with_rows(queued), "_due", "_max", ["_lane"]).done()
    release = F.when(F.col("_lane") < 0, micros(F.col(TS))).otherwise(
        F.col("_max") + F.col("_shift")
    )
    return done.withColumn("release_at", at(release)).select(*events.columns, "release_at")


def singleton_skip(
    events: DataFrame, key: str, duration: int, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Events that start a run; those arriving while one is active are dropped."""
    chained = runs(events, key, TS, ID, Rule(span=duration * SECOND), slice_rows)
    return chained.where(F.col(ID) == F.col("run_id")).drop("run_ts", "run_id")


def singleton_cancel(
    events: DataFrame, key: str, duration: int, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Every event starts a run; a newer event of the key ends an active one."""
    data = ordered(events, [key], ORDER, slice_rows)
    followed = with_next(data, TS, "_next").done()
    natural = later(F.col(TS), duration)
    cut = F.coalesce(F.col("_next") < natural, F.lit(False))
    return followed.withColumns(
        {"cancelled": cut, "ended_at": F.when(cut, F.col("_next")).otherwise(natural)}
    ).drop("_next")


def batch_events(
    events: DataFrame, key: str, max_size: int, timeout: int, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Events with their batch: closed when full or `timeout` after its first."""
    if not 1 <= max_size <= MAX_BATCH:
        raise ValueError(f"max_size must be between 1 and {MAX_BATCH}")
    if not MIN_BATCH_SECONDS <= timeout <= MAX_BATCH_SECONDS:
        raise ValueError(
            f"timeout must be between {MIN_BATCH_SECONDS} and {MAX_BATCH_SECONDS} seconds"
        )
    rule = Rule(span=timeout * SECOND, size=max_size)
    return runs(events, key, TS, ID, rule, slice_rows).withColumnRenamed("run_id", "batch_id").drop("run_ts")


def next_event(
    events: DataFrame,
    key: str,
    starts: Column,
    matches: Column,
    timeout: int,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Each starting event with the first matching one of its key in time.

    Adds `match_id` and `match_ts`, null where none came within `timeout`. One
    pass in order, not a join: pairs beyond the first are never made.
    """
    both = events.where(starts | matches)
    data = ordered(both, [key], ORDER, slice_rows)
    found = with_next_where(data, matches, F.struct(F.col(ID), F.col(TS)), "_match").done()
    in_time = F.col("_match.ts") <= later(F.col(TS), timeout)
    return (
        found.where(starts)
        .withColumns(
            {
                "match_id": F.when(in_time, F.col(f"_match.{ID}")),
                "match_ts": F.when(in_time, F.col(f"_match.{TS}")),
            }
        )
        .drop("_match")
    )


def wait_for(
    events: DataFrame, key: str, name: str, awaited: str, timeout: int,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Runs started by `name` with the awaited event, or null on timeout."""
    kind = F.col("event_type")
    return next_event(events, key, kind == name, kind == awaited, timeout, slice_rows)


def cancel_on(
    events: DataFrame, key: str, name: str, cancelled_by: str, timeout: int,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Runs started by `name` that no cancelling event of the key stopped in time."""
    waited = wait_for(events, key, name, cancelled_by, timeout, slice_rows)
    return waited.where("match_id IS NULL").drop("match_id", "match_ts")


def with_outcome(events: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Events with `error`: the first failed check, or null."""
    error = F.coalesce(*[F.when(failed, F.lit(why)) for why, failed in checks.items()])
    return events.withColumn("error", error)


def dead_letters(outcome: DataFrame) -> DataFrame:
    """Failed events with their error, for the failure handler."""
    return outcome.where("error IS NOT NULL")


def windowed(events: DataFrame, key: str, length: str, slide: str | None = None) -> DataFrame:
    """Count and sum per key and tumbling (or sliding) window."""
    span = F.window(TS, length, slide) if slide else F.window(TS, length)
    return (
        events.groupBy(key, span.alias("w"))
        .agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
        .select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")
    )


def sessions(events: DataFrame, key: str, gap: str) -> DataFrame:
    """Count and sum per session: events at most `gap` apart."""
    return (
        events.groupBy(key, F.session_window(TS, gap).alias("w"))
        .agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
        .select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")
    )
