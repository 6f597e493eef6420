"""Flow control against plain loops, with one key holding most rows.

`slice_rows` is set low so that the busy key is cut; results must not change.
"""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import ordered as od
from cadenza.streaming import flow
from tests.conftest import rows

START = dt.datetime(2024, 1, 1)
SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"
KINDS = ("view", "purchase", "error")


def make_events(seed: int, dense: bool):
    """400 events, most of one user, with ties in time and users without id."""
    rng = random.Random(seed)
    out = []
    for i in range(400):
        user = rng.choice([7, 7, 7, 7, 1, 2, None])
        second = rng.randrange(0, 900 if dense else 40_000)
        if rng.random() < 0.3:
            second = second // 60 * 60
        out.append((i, START + dt.timedelta(seconds=second), user, rng.choice(KINDS), float(i)))
    return out


@pytest.fixture(scope="module", params=[(1, True), (2, False)], ids=["dense", "sparse"])
def data(request, spark):
    events = make_events(*request.param)
    return events, spark.createDataFrame(events, SCHEMA)


def groups(events):
    found = {}
    for e in sorted(events, key=lambda e: (e[1], e[0])):
        found.setdefault(e[2], []).append(e)
    return found.values()


def seconds(a, b):
    return (a - b).total_seconds()


def greedy(events, span, size=10**9, gap=10**9):
    """Runs as lists of events."""
    out = []
    for group in groups(events):
        run = []
        for e in group:
            if run and (
                seconds(e[1], run[0][1]) >= span
                or len(run) >= size
                or seconds(e[1], run[-1][1]) > gap
            ):
                out.append(run)
                run = []
            run.append(e)
        out.append(run)
    return out


SLICED = pytest.mark.parametrize("slice_rows", [10**6, 20], ids=["whole", "sliced"])


@SLICED
def test_batches(data, slice_rows):
    events, frame = data
    for size, timeout in ((3, 60), (7, 20), (100, 60), (1, 5)):
        got = flow.batch_events(frame, "user_id", size, timeout, slice_rows)
        want = [(e[0], run[0][0]) for run in greedy(events, timeout, size) for e in run]
        assert rows(got.select("event_id", "batch_id")) == sorted(want, key=repr)


@SLICED
@pytest.mark.parametrize("duration", [5, 61, 600, 100_000])
def test_singleton_skip(data, slice_rows, duration):
    events, frame = data
    got = flow.singleton_skip(frame, "user_id", duration, slice_rows)
    want = [(run[0][0],) for run in greedy(events, duration)]
    assert rows(got.select("event_id")) == sorted(want, key=repr)


@SLICED
@pytest.mark.parametrize("period,timeout", [(10, 45), (120, 300), (5000, 9000)])
def test_debounce_with_cap(data, slice_rows, period, timeout):
    events, frame = data
    got = flow.debounce(frame, "user_id", period, timeout, slice_rows)
    want = [
        (
            run[-1][0],
            min(
                run[-1][1] + dt.timedelta(seconds=period),
                run[0][1] + dt.timedelta(seconds=timeout),
            ),
        )
        for run in greedy(events, timeout, gap=period)
    ]
    assert rows(got.select("event_id", "fire_at")) == sorted(want, key=repr)


@SLICED
def test_debounce(data, slice_rows):
    events, frame = data
    for period in (3, 40, 700):
        got = flow.debounce(frame, "user_id", period, slice_rows=slice_rows)
        want = []
        for group in groups(events):
            for e, after in zip(group, [*group[1:], None]):
                if after is None or seconds(after[1], e[1]) > period:
                    want.append((e[0], e[1] + dt.timedelta(seconds=period)))
        assert rows(got.select("event_id", "fire_at")) == sorted(want, key=repr)


@SLICED
def test_singleton_cancel(data, slice_rows):
    events, frame = data
    got = flow.singleton_cancel(frame, "user_id", 30, slice_rows)
    want = []
    for group in groups(events):
        for e, after in zip(group, [*group[1:], None]):
            natural = e[1] + dt.timedelta(seconds=30)
            cut = after is not None and after[1] < natural
            want.append((e[0], cut, after[1] if cut else natural))
    assert rows(got.select("event_id", "cancelled", "ended_at")) == sorted(want, key=repr)


@SLICED
@pytest.mark.parametrize("limit,burst", [(1, 0), (3, 0), (2, 5)])
def test_throttle(data, slice_rows, limit, burst):
    events, frame = data
    got = flow.throttle(frame, "user_id", limit, 45, burst, slice_rows)
    want = []
    for group in groups(events):
        free = [dt.datetime.min] * limit
        for n, e in enumerate(group):
            if n < burst:
                want.append((e[0], e[1]))
                continue
            lane = (n - burst) % limit
            release = max(e[1], free[lane])
            free[lane] = release + dt.timedelta(seconds=45)
            want.append((e[0], release))
    assert rows(got.select("event_id", "release_at")) == sorted(want, key=repr)


@SLICED
def test_wait_and_cancel(data, slice_rows):
    events, frame = data
    for timeout in (10, 300):
        want, kept = [], []
        for group in groups(events):
            for i, e in enumerate(group):
                if e[3] != "view":
                    continue
                match = next((x for x in group[i + 1 :] if x[3] == "purchase"), None)
                if match is not None and seconds(match[1], e[1]) > timeout:
                    match = None
                want.append((e[0], match and match[0], match and match[1]))
                if match is None:
                    kept.append((e[0],))
        got = flow.wait_for(frame, "user_id", "view", "purchase", timeout, slice_rows)
        assert rows(got.select("event_id", "match_id", "match_ts")) == sorted(want, key=repr)
        left = flow.cancel_on(frame, "user_id", "view", "purchase", timeout, slice_rows)
        assert rows(left.select("event_id")) == sorted(kept, key=repr)


def test_rate_limit_and_dedup(data):
    events, frame = data
    period = 100
    want, seen, taken = [], {}, []
    for e in sorted(events, key=lambda e: (e[1], e[0])):
        slot = (e[2], int(seconds(e[1], dt.datetime(1970, 1, 1)) // period))
        seen[slot] = seen.get(slot, 0) + 1
        if seen[slot] <= 2:
            want.append((e[0],))
        if e[3] not in taken:
            taken.append(e[3])
    got = flow.rate_limit(frame, "user_id", 2, period)
    assert rows(got.select("event_id")) == sorted(want, key=repr)
    assert flow.dedup(frame, ["event_type"]).count() == len(taken)


def test_slices_are_even_and_stable(spark, data):
    _, frame = data
    busy = frame.where("user_id = 7")
    cut = od.slices(busy, ["user_id"], ["ts", "event_id"])
    sizes = [r["count"] for r in cut.groupBy(od.SLICE).count().collect()]
    assert sum(sizes) == busy.count() and len(sizes) > 4 and max(sizes) < busy.count() / 2
    assert rows(cut) == rows(cut)


def test_slices_hold_what_they_should(spark):
    """As many slices as the busy rows need, also beyond the shuffle partitions."""
    frame = spark.range(4000).selectExpr("id", "'k' AS key", "id AS ts")
    data = od.ordered(frame, ["key"], ["ts"], slice_rows=100)
    sizes = [r["count"] for r in data.rows.groupBy(od.SLICE).count().collect()]
    assert len(sizes) >= 30 and max(sizes) <= 250 and sum(sizes) == 4000


def test_batch_bounds(data):
    _, frame = data
    with pytest.raises(ValueError, match="max_size"):
        flow.batch_events(frame, "user_id", 101, 5)
    with pytest.raises(ValueError, match="timeout"):
        flow.batch_events(frame, "user_id", 5, 61)


def test_dead_letters_keep_every_event(data):
    _, frame = data
    outcome = flow.with_outcome(frame, {"odd": F.col("event_id") % 2 == 1})
    assert flow.dead_letters(outcome).count() == 200
    assert outcome.where("error IS NULL").count() == 200
