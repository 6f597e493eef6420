"""Streams over files, compared with the stored-event forms."""

from __future__ import annotations

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadenza.operators.chains import Rule
from cadenza.streaming import flow, live
from cadenza.streaming.stateful import RunProcessor
from tests.conftest import rows

START = dt.datetime(2024, 1, 1)
SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"
END = 10**6


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """300 events in four files in shuffled order, then far later ones that close all."""
    rng = random.Random(5)
    events = [
        (i, START + dt.timedelta(seconds=rng.randrange(0, 3000)), rng.choice([1, 1, 1, 2, 3]),
         rng.choice(["view", "purchase"]), 1.0)
        for i in range(300)
    ]
    folder = str(tmp_path_factory.mktemp("events"))
    for n in range(4):
        spark.createDataFrame(events[n * 75 : (n + 1) * 75], SCHEMA).coalesce(1).write.mode(
            "append"
        ).parquet(folder)
    for n in (1, 2):
        far = START + dt.timedelta(days=n)
        spark.createDataFrame(
            [(END + n, far, 99, "view", 0.0), (END + 10 + n, far, 99, "purchase", 0.0)], SCHEMA
        ).coalesce(1).write.mode("append").parquet(folder)
    return spark.createDataFrame(events, SCHEMA), folder


def stream(spark, folder):
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(folder)
    return live.with_event_time(raw, "2 hours")


def run(frame, tmp_path, name):
    """Everything a stream has put out once its input is used up."""
    query = (
        frame.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(300)
    assert query.exception() is None
    return frame.sparkSession.table(name)


def ntz(*columns):
    return [F.col(c).cast("timestamp_ntz").alias(c) for c in columns]


def test_batches(spark, stored, tmp_path):
    batch, folder = stored
    got = run(live.batch_events(stream(spark, folder), "user_id", 3, 60), tmp_path, "s_batch")
    got = got.where("key <> '99'").select("first_id", "events")
    want = flow.batch_events(batch, "user_id", 3, 60).groupBy("batch_id").count()
    assert rows(got) == rows(want)


def test_debounce_capped(spark, stored, tmp_path):
    batch, folder = stored
    got = run(live.debounce_capped(stream(spark, folder), "user_id", 20, 90), tmp_path, "s_cap")
    got = got.where("key <> '99'").select("last_id", *ntz("closed_at"))
    want = flow.debounce(batch, "user_id", 20, 90).select("event_id", "fire_at")
    assert rows(got) == rows(want)


def test_singleton_skip(spark, stored, tmp_path):
    batch, folder = stored
    got = run(live.singleton_skip(stream(spark, folder), "user_id", 75), tmp_path, "s_single")
    want = flow.singleton_skip(batch, "user_id", 75).select("event_id")
    assert rows(got.where("key <> '99'").select("first_id")) == rows(want)


def test_rate_limit(spark, stored, tmp_path):
    batch, folder = stored
    got = run(live.rate_limit(stream(spark, folder), "user_id", 2, 60), tmp_path, "s_rate")
    want = flow.rate_limit(batch, "user_id", 2, 60).select("event_id")
    assert rows(got.where("key <> '99'").select("event_id")) == rows(want)


def test_throttle(spark, stored, tmp_path):
    batch, folder = stored
    got = run(live.throttle(stream(spark, folder), "user_id", 2, 30), tmp_path, "s_throttle")
    got = got.where("key <> '99'").select("event_id", *ntz("release_at"))
    want = flow.throttle(batch, "user_id", 2, 30).select("event_id", "release_at")
    assert rows(got) == rows(want)


def test_windows_and_sessions(spark, stored, tmp_path):
    batch, folder = stored
    got = run(live.windowed(stream(spark, folder), "user_id", "5 minutes"), tmp_path, "s_window")
    want = flow.windowed(batch, "user_id", "5 minutes").drop("total")
    assert rows(got.where("user_id <> 99")) == rows(want)


def test_debounce_and_sessions(spark, stored, tmp_path):
    batch, folder = stored
    got = run(live.debounce(stream(spark, folder), "user_id", 40), tmp_path, "s_debounce")
    got = got.where("user_id <> 99").select("event_id", *ntz("fire_at"))
    want = flow.debounce(batch, "user_id", 40).select("event_id", "fire_at")
    assert rows(got) == rows(want)


def test_wait_for(spark, stored, tmp_path):
    batch, folder = stored
    views = stream(spark, folder).where("event_type = 'view'").select("event_id", "ts", "user_id")
    buys = stream(spark, folder).where("event_type = 'purchase'")
    joined = run(live.wait_for(views, buys, "user_id", 30), tmp_path, "s_wait")
    got = live.first_match(joined, "user_id").where("user_id <> 99")
    want = flow.wait_for(batch, "user_id", "view", "purchase", 30)
    # At equal times the stored form orders by id, the join takes both sides.
    tied = batch.groupBy("user_id", "ts").agg(F.countDistinct("event_type").alias("n")).where("n > 1")
    clear = got.select("event_id", "match_id").join(
        want.join(tied.select("user_id", "ts"), ["user_id", "ts"], "left_anti")
        .where("match_ts IS NULL OR match_ts > ts").select("event_id"), "event_id"
    )
    assert clear.count() > 50
    assert rows(clear) == rows(want.join(clear.select("event_id"), "event_id").select("event_id", "match_id"))


@pytest.mark.parametrize("name,awaited,timeout", [("view", "purchase", 30), ("view", "view", 7), ("purchase", "view", 0)])
def test_first_match_of_every_start(spark, stored, tmp_path, name, awaited, timeout):
    batch, folder = stored
    got = run(live.await_first(stream(spark, folder), "user_id", name, awaited, timeout), tmp_path, f"s_first_{name}_{awaited}")
    got = got.where("key <> '99'").select("event_id", *ntz("ts"), "match_id", *ntz("match_ts"))
    want = flow.wait_for(batch, "user_id", name, awaited, timeout).select("event_id", "ts", "match_id", "match_ts")
    assert rows(got) == rows(want) and want.where("match_id is null").count() and want.count() > 100


def test_cancel_on(spark, stored, tmp_path):
    batch, folder = stored
    got = run(live.cancel_on(stream(spark, folder), "user_id", "view", "purchase", 20), tmp_path, "s_cancel")
    want = flow.cancel_on(batch, "user_id", "view", "purchase", 20)
    assert rows(got.where("key <> '99'").select("event_id", *ntz("ts"))) == rows(want.select("event_id", "ts"))


class Fake:
    """State of one key in memory, which counts the values read."""

    def __init__(self):
        self.maps, self.timers, self.read = [], set(), 0

    def getMapState(self, *_):
        self.maps.append(FakeMap(self))
        return self.maps[-1]

    def getValueState(self, *_):
        return FakeValue()

    def registerTimer(self, at):
        self.timers.add(at)


class FakeMap(dict):
    def __init__(self, owner):
        super().__init__()
        self.owner, self.containsKey, self.updateValue = owner, self.__contains__, self.__setitem__

    def getValue(self, key):
        self.owner.read += len(self[key][0])
        return self[key]

    def removeKey(self, key):
        del self[key]


class FakeValue:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Mark:
    def __init__(self, at):
        self.getCurrentWatermarkInMs = lambda: at


def test_a_timer_reads_one_bucket_of_a_busy_key():
    """20,000 events over 2,000 seconds: no timer reads more than its bucket, whatever is held."""
    fake, events = Fake(), 20_000
    processor = RunProcessor(Rule(span=60_000_000, size=50))
    processor.init(fake)
    batch = pd.DataFrame({"ts": pd.to_datetime([i * 100_000 for i in range(events)], unit="us"), "event_id": range(events)})
    list(processor.handleInputRows(("a",), iter([batch]), None))
    runs, most = 0, 0
    while fake.timers:
        at = min(fake.timers)
        fake.timers.discard(at)
        fake.read = 0
        for out in processor.handleExpiredTimer(("a",), Mark(at), None):
            runs += len(out)
        most = max(most, fake.read)
    assert (runs, most) == (events // 50, 10) and not any(fake.maps)


def test_dedup_drops_repeats(spark, stored, tmp_path):
    batch, folder = stored
    got = run(live.dedup(stream(spark, folder), ["user_id", "event_type"]), tmp_path, "s_dedup")
    assert got.where("user_id <> 99").count() == batch.select("user_id", "event_type").distinct().count()
