"""Keyed state for rules that windows cannot express.

Events may arrive out of order. Each key holds its events in buckets of equal
time until the watermark has passed a bucket's end; then that bucket's events are
taken in order of time and id. Events of other buckets are neither read nor
written again. The result does not depend on how micro-batches were cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cadenza.operators.chains import NEVER, Rule

#: Length of a bucket in microseconds: events wait up to that much longer than the watermark asks.
BUCKET = 1_000_000


def _fields(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in types.items()])


_LONGS = T.ArrayType(T.LongType())
HELD = _fields(ts=_LONGS, id=_LONGS, kind=_LONGS)
PLACE = _fields(bucket=T.LongType())


class InOrder(StatefulProcessor):
    """Holds events back and hands them to `take` in order.

    All timers stand on bucket ends. Of those that expire together the first does
    the work: it takes all buckets the watermark has passed, one at a time.
    """

    STATE: T.StructType
    OUTPUT: T.StructType

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", PLACE, HELD)
        self.state = handle.getValueState("state", self.STATE)
        self.passed = handle.getValueState("passed", PLACE)

    def wake_at(self, ts: int) -> None:
        """Ask for a timer at the first bucket end after a time."""
        self.handle.registerTimer((ts // BUCKET + 1) * BUCKET // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        """Only holds, in the buckets the rows belong to."""
        for batch in rows:
            times = batch["ts"].astype("datetime64[us, UTC]" if batch["ts"].dt.tz else "datetime64[us]")
            stamps = times.astype("int64")
            kinds = batch["kind"] if "kind" in batch else pd.Series(0, index=batch.index)
            for bucket, own in pd.DataFrame({"ts": stamps, "id": batch["event_id"], "kind": kinds}).groupby(stamps // BUCKET):
                place, new = (int(bucket),), [own[c].tolist() for c in ("ts", "id", "kind")]
                known = self.held.getValue(place) if self.held.containsKey(place) else ([], [], [])
                self.held.updateValue(place, tuple([*old, *more] for old, more in zip(known, new, strict=True)))
                self.wake_at(int(own["ts"].iat[0]))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        until = timerValues.getCurrentWatermarkInMs() * 1000 // BUCKET
        if self.passed.exists() and self.passed.get()[0] >= until:
            return
        self.passed.update((until,))
        out: list[tuple] = []
        before = state = self.state.get() if self.state.exists() else None
        for bucket in sorted(place[0] for place in self.held.keys() if place[0] < until):
            for ts, row, kind in sorted(zip(*self.held.getValue((bucket,)), strict=True)):
                state = self.take(state, ts, row, kind, out)
            self.taken(bucket)
            self.held.removeKey((bucket,))
        state, wake = self.settle(state, until * BUCKET, out)
        if state is None:
            self.state.clear()
        elif state != before:
            self.state.update(state)
        if wake is not None:
            self.wake_at(wake)
        if out:
            frame = pd.DataFrame(out, columns=self.OUTPUT.fieldNames()[1:])
            for field in self.OUTPUT.fields:
                if isinstance(field.dataType, T.TimestampType):
                    frame[field.name] = pd.to_datetime(frame[field.name], unit="us")
                elif isinstance(field.dataType, T.LongType):
                    frame[field.name] = frame[field.name].astype("Int64")
            frame.insert(0, "key", key[0])
            yield frame

    def take(self, state, ts: int, row: int, kind: int, out: list):
        """State after one event; finished output goes to `out`."""
        raise NotImplementedError

    def taken(self, bucket: int) -> None:
        """All events of a bucket have been taken."""

    def settle(self, state, reached: int, out: list):
        """State once time has reached a point, and when to look again."""
        return state, None

    def close(self) -> None:
        pass


class RunProcessor(InOrder):
    """One row per run of events, when the run is over."""

    STATE = _fields(
        first_ts=T.LongType(), first_id=T.LongType(), count=T.LongType(),
        last_ts=T.LongType(), last_id=T.LongType(),
    )
    OUTPUT = _fields(
        key=T.StringType(), first_id=T.LongType(), first_ts=T.TimestampType(),
        last_id=T.LongType(), last_ts=T.TimestampType(), events=T.LongType(),
        closed_at=T.TimestampType(),
    )

    def __init__(self, rule: Rule):
        self.rule = rule

    def over(self, state) -> int:
        """When a run ends if no further event comes."""
        start, _, _, last, _ = state
        quiet = NEVER if self.rule.gap == NEVER else last + self.rule.gap
        return min(start + self.rule.span, quiet)

    def finish(self, state, at: int, out: list) -> None:
        start, first, count, last, last_id = state
        out.append((first, start, last_id, last, count, at))

    def take(self, state, ts, row, kind, out):
        if state is not None:
            start, _, count, last, _ = state
            if self.rule.ends(ts, start, count, last):
                self.finish(state, last if count >= self.rule.size else self.over(state), out)
                state = None
        if state is None:
            return (ts, row, 1, ts, row)
        start, first, count, _, _ = state
        return (start, first, count + 1, ts, row)

    def settle(self, state, reached, out):
        if state is None:
            return None, None
        if state[2] >= self.rule.size:
            self.finish(state, state[3], out)
            return None, None
        if self.over(state) < reached:
            self.finish(state, self.over(state), out)
            return None, None
        return state, self.over(state)


class LimitProcessor(InOrder):
    """Lets the first events of each period through."""

    STATE = _fields(period=T.LongType(), taken=T.LongType())
    OUTPUT = _fields(key=T.StringType(), event_id=T.LongType(), ts=T.TimestampType())

    def __init__(self, limit: int, period: int):
        self.limit, self.period = limit, period

    def take(self, state, ts, row, kind, out):
        own = ts // self.period
        taken = state[1] if state is not None and state[0] == own else 0
        if taken < self.limit:
            out.append((row, ts))
            taken += 1
        return (own, taken)


class ThrottleProcessor(InOrder):
    """Gives every event its release time; `lanes` holds the last releases."""

    STATE = _fields(lanes=T.ArrayType(T.LongType()))
    OUTPUT = _fields(
        key=T.StringType(), event_id=T.LongType(), ts=T.TimestampType(),
        release_at=T.TimestampType(),
    )

    def __init__(self, limit: int, period: int):
        self.limit, self.period = limit, period

    def take(self, state, ts, row, kind, out):
        lanes = [] if state is None else list(state[0])
        release = ts
        if len(lanes) == self.limit:
            release = max(ts, lanes.pop(0) + self.period)
        out.append((row, ts, release))
        return ([*lanes, release],)


#: What an event is to a wait, as bits.
STARTS, MATCHES = 1, 2


class WaitProcessor(InOrder):
    """One row per start: with the first matching event after it, if in time, else when its time is up.

    Open starts are kept by bucket too. A match empties them all; a timer reads
    the buckets whose starts have run out of time.
    """

    STATE = PLACE
    OUTPUT = _fields(
        key=T.StringType(), event_id=T.LongType(), ts=T.TimestampType(),
        match_id=T.LongType(), match_ts=T.TimestampType(),
    )

    def __init__(self, timeout: int):
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getMapState("open", PLACE, HELD)
        self.fresh: list[tuple[int, int]] = []

    def take(self, state, ts, row, kind, out):
        if kind & MATCHES:
            for starts, ids, _ in list(self.open.values()):
                self._matched(zip(starts, ids, strict=True), ts, row, out)
            self._matched(self.fresh, ts, row, out)
            self.open.clear()
            self.fresh = []
        if kind & STARTS:
            self.fresh.append((ts, row))
        return state

    def _matched(self, starts, ts, row, out):
        for start, own in starts:
            found = (row, ts) if ts <= start + self.timeout else (None, None)
            out.append((own, start, *found))

    def taken(self, bucket):
        if self.fresh:
            self.open.updateValue((bucket,), ([s for s, _ in self.fresh], [i for _, i in self.fresh], [0] * len(self.fresh)))
            self.handle.registerTimer(self._until(bucket) // 1000)
            self.fresh = []

    def settle(self, state, reached, out):
        for bucket in sorted(place[0] for place in self.open.keys() if self._until(place[0]) <= reached):
            starts, ids, _ = self.open.getValue((bucket,))
            out += [(own, start, None, None) for start, own in zip(starts, ids, strict=True)]
            self.open.removeKey((bucket,))
        return None, None

    def _until(self, bucket: int) -> int:
        """The time by which the starts of a bucket have met their match or never will."""
        return (bucket + 1 + -(-self.timeout // BUCKET)) * BUCKET
