"""What is kept up to date against what is worked out afresh."""

from __future__ import annotations

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from cadenza.operators import catalog, paging, partials
from cadenza.operators.quantile import exact_percentile
from cadenza.operators.summary import summary
from cadenza.session import staged
from cadenza.sources import clustered, pages
from cadenza.sources.files import read_royalties
from cadenza.sources.buckets import Conflict, Store
from cadenza.sources.ingest import Workspace, catalog_store, ingest, read_catalog, update_catalog, workspace_summary
from cadenza.streaming import flow, late
from tests.conftest import rows

REPORT = "Reporting Month,Store,Artist,Song Title,ISRC,UPC,Quantity,Earnings (USD)\n"


def put(folder, name, *lines):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{name}.csv").write_text(REPORT + "".join(f"{line}\n" for line in lines))


def test_summary_follows_reruns_and_deletions(spark, tmp_path):
    home = Workspace(str(tmp_path), "w", "u")
    staging = tmp_path / "workspaces" / "w" / "staging"
    put(staging, "a", "2026-01,Spotify,Ann,Song,I1,,3,10.5", "2026-01,Deezer,Bob,Other,I2,,4,11")
    put(staging, "b", "2026-02,Spotify,Ann,Song,I1,,1,2")
    assert workspace_summary(spark, home).first()["total_tracks_monetized"] == 0
    ingest(spark, home)
    assert rows(workspace_summary(spark, home)) == rows(summary(read_royalties(spark, home.processed)))
    assert workspace_summary(spark, home).first()["top_artist"] == "Ann"
    put(staging, "a", "2026-01,Tidal,Cid,New,I3,,3,40")  # a rerun replaces what the file gave
    put(staging, "b")  # a file without rows takes its figures away
    ingest(spark, home)
    got = workspace_summary(spark, home)
    assert rows(got) == rows(summary(read_royalties(spark, home.processed)))
    assert (got.first()["top_artist"], got.first()["total_streams"]) == ("Cid", 3)
    files = [f.removeprefix("file:") for f in got.inputFiles()]
    assert files and not any("/processed/" in f for f in files)


def test_sketches_of_any_choice_of_datasets(spark):
    data = [(f"d{i % 4}", f"I{i % 3000}", float(i)) for i in range(12_000)]
    frame = spark.createDataFrame(data, "dataset_id string, isrc string, net_revenue double")
    stored = partials.sketches(frame)
    for chosen in (["d0"], ["d0", "d3"], ["d0", "d1", "d2", "d3"]):
        own = [d for d in data if d[0] in chosen]
        got = partials.estimates(stored.where(F.col("dataset_id").isin(chosen)), 0.5, 0.9).first()
        assert got["rows"] == len(own)
        assert abs(got["tracks"] / len({d[1] for d in own}) - 1) <= partials.DISTINCT_ERROR
        for at, q in zip(got["revenue_at"], (0.5, 0.9)):
            assert abs(sum(d[2] <= at for d in own) / len(own) - q) <= partials.RANK_ERROR


@pytest.mark.parametrize("fraction", [0.5, 0.0, 1.0, 0.93])
def test_exact_percentile_of_large_uneven_groups(spark, fraction):
    """Heavy tails, a value that holds half of a group, ties, nulls and a null key."""
    rng = random.Random(3)
    data = [("tail", rng.lognormvariate(0, 6)) for _ in range(1500)] + [("same", 7.0 if i % 2 else rng.random() * 20) for i in range(900)]
    data += [("few", float(i)) for i in range(7)] + [(None, float(i % 50)) for i in range(400)] + [("tail", None), ("none", None)]
    frame = spark.createDataFrame(data, "k string, v double").repartition(5)
    got = {r["k"]: r["percentile"] for r in exact_percentile(frame, ["k"], "v", fraction, held=40).collect()}
    assert set(got) == {"tail", "same", "few", None}
    for key in got:
        own = sorted(v for k, v in data if k == key and v is not None)
        at = (len(own) - 1) * fraction
        low, high = own[int(at)], own[-(-int(at * 1e9) // 10**9)] if at != int(at) else own[int(at)]
        assert got[key] == pytest.approx(low + (high - low) * (at - int(at)), rel=1e-12)
    assert got["few"] == pytest.approx(statistics.quantiles(range(7), n=100, method="inclusive")[int(fraction * 100) - 1]) if 0 < fraction < 1 else True


def test_stored_pages_equal_pages_and_open_few_files(spark, tmp_path):
    def listed(n):
        return spark.range(n).select(F.concat(F.lit("id-"), "id").alias("id"), F.timestamp_seconds((F.col("id") * 7919) % 500).alias("created_at"))

    opened = {}
    for n in (300, 1200):
        frame, path = listed(n), str(tmp_path / str(n))
        pages.store_list(frame, path, file_rows=60)
        for newest in (True, False):
            for cursor in (None, "id-0", "id-17", f"id-{n - 1}", "unknown"):
                got = pages.stored_page(spark, path, cursor, 20, newest)
                assert [tuple(r) for r in got.collect()] == [tuple(r) for r in paging.page(frame, cursor, 20, newest).collect()]
        opened[n] = len(pages.stored_page(spark, path, "id-17", 20).inputFiles())
    assert max(opened.values()) <= 3
    pages.store_list(listed(0), str(tmp_path / "none"))
    assert pages.stored_page(spark, str(tmp_path / "none")).collect() == []


def test_clustered_files_serve_several_filters(spark, tmp_path):
    """A date range, a track and a territory each read under a fifth of the files, whatever a value's share."""
    frame = spark.range(40_000).select(
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") * 31 % 1000).cast("int")).alias("day"),
        F.format_string("I%05d", F.col("id") * 7919 % 5000).alias("isrc"),
        F.when(F.col("id") % 3 == 0, "NG").otherwise(F.chr(65 + F.col("id") % 26)).alias("territory"),
        F.when(F.col("id") % 97 > 0, F.col("id")).alias("n"),
    )
    path = str(tmp_path / "c")
    clustered.write_clustered(frame, path, ["day", "isrc"], files=200)
    everything = len(spark.read.parquet(f"{path}/rows").inputFiles())
    days = tuple(dt.date(2021, 5, d) for d in (1, 14))
    for between, where in (
        ({"day": days}, "day between '2021-05-01' and '2021-05-14'"), ({"isrc": ("I00700", "I00700")}, "isrc = 'I00700'"),
        ({"isrc": (None, "I00050"), "day": (dt.date(2022, 6, 1), None)}, "isrc <= 'I00050' and day >= '2022-06-01'"),
    ):
        got = clustered.read_clustered(spark, path, between)
        assert rows(got) == rows(frame.where(where)) and got.count()
        assert len(got.inputFiles()) <= everything / 5
    assert clustered.read_clustered(spark, path, {"isrc": ("J", None)}).collect() == []
    clustered.write_clustered(frame.withColumn("day", F.lit(None).cast("date")).limit(10), path, ["day", "isrc"], files=4)
    assert clustered.read_clustered(spark, path, {"day": (None, None)}).collect() == []


def test_late_rows_are_counted_and_put_right(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, user_id long, value double"
    start = dt.datetime(2024, 1, 1)
    rng = random.Random(9)
    events = [(i, start + dt.timedelta(minutes=i // 2 if i % 9 else rng.randrange(i // 2 + 1)), i % 3, float(i)) for i in range(400)]
    for n in range(4):
        spark.createDataFrame(events[n * 100 : (n + 1) * 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    path = str(tmp_path / "out")
    late.keep_events(stream, path, str(tmp_path / "checkpoint"), "10 minutes", "20 minutes").awaitTermination()
    frame = spark.createDataFrame(events, schema)
    want = flow.windowed(frame, "user_id", "10 minutes")
    assert rows(late.corrected(spark, path, "user_id", "10 minutes")) == rows(want)
    assert rows(late.windows_in_time(spark, path, "user_id", "10 minutes")) != rows(want)
    counts = late.late_counts(spark, path).agg(F.sum("rows").alias("rows"), F.sum("late_rows").alias("late")).first()
    redone = late.corrections(spark, path, "user_id", "10 minutes").count()
    assert counts["rows"] == 400 and 0 < counts["late"] and 0 < redone <= counts["late"] < want.count()


ITEM = "isrc string, title string, artist string, album string, upc string"


def items(spark, *lines):
    return spark.createDataFrame([tuple(line) for line in lines], ITEM)


def folders(spark, home):
    return {(t, b): f for t, own in catalog_store(spark, home).newest()[0].tables.items() for b, f in own.items()}


def whole_catalog(spark, home, *batches):
    """The same batches by the set-based jobs over whole tables."""
    frames = {n: spark.createDataFrame([], ", ".join(f"{c} {'date' if c == 'release_date' else 'string'}" for c in columns))
              for n, columns in (("artists", catalog.ARTIST_COLUMNS), ("albums", catalog.ALBUM_COLUMNS), ("tracks", catalog.TRACK_COLUMNS))}
    for batch in batches:
        facts = catalog.catalog_items(batch.withColumn(catalog.OWNER, F.lit(home.owner_user_id)))
        artists = staged(catalog.upsert_artists(facts, frames["artists"]))
        albums = staged(catalog.upsert_albums(facts, frames["albums"], artists))
        frames = {"artists": artists, "albums": albums, "tracks": staged(catalog.upsert_tracks(facts, frames["tracks"], albums, artists))}
    return {n: rows(f) for n, f in frames.items()}


def test_a_run_writes_the_buckets_it_touches(spark, tmp_path):
    home = Workspace(str(tmp_path), "w", "u")
    first = items(spark, *[(f"I{i}", f"T{i}", f"A{i % 40}", f"D{i % 60}" if i % 3 else None, f"U{i % 60}" if i % 2 else None) for i in range(200)])
    update_catalog(spark, home, first, "one")
    before = folders(spark, home)
    new = items(spark, ("NEW", "New", "New Artist", "New Album", None))
    update_catalog(spark, home, new, "two")
    after = folders(spark, home)
    changed = [t for (t, b), f in after.items() if before.get((t, b)) != f]
    assert sorted(changed) == ["albums", "artists", "titles", "tracks"]
    update_catalog(spark, home, new, "three")  # nothing new: no bucket is written
    assert folders(spark, home) == after
    # Renamed albums, an album found by its new title, one that has its title no more.
    moved = items(spark, ("I1", "T1", "A1", "Renamed", "U1"), ("I7", "T7", "A7", None, None), ("I300", "X", "A1", "RENAMED", None), ("I301", "Y", "A1", "D1", None))
    update_catalog(spark, home, moved, "four")
    later = items(spark, ("I302", "Z", "A1", "renamed", None), ("I303", "Z", "A1", "d1", None))
    update_catalog(spark, home, later, "five")
    want = whole_catalog(spark, home, first, new, new, moved, later)
    assert {n: rows(read_catalog(spark, home, n)) for n in want} == want
    assert rows(read_catalog(spark, home, "tracks", 1)) == whole_catalog(spark, home, first)["tracks"]


def test_two_runs_at_once_both_hold(spark, tmp_path, monkeypatch):
    home = Workspace(str(tmp_path), "w", "u")
    a, b = items(spark, ("I1", "One", "Ann", "Disc", None)), items(spark, ("I2", "Two", "Ann", "disc", "U2"))
    update_catalog(spark, home, items(spark, ("I0", "Zero", "Ann", None, None)), "zero")
    commit, conflicts = Store.commit, []

    def overtaken(self, manifest):
        """Before run `a` puts its manifest, run `b` has come and gone."""
        monkeypatch.setattr(Store, "commit", counted)
        update_catalog(spark, home, b, "b")
        counted(self, manifest)

    def counted(self, manifest):
        try:
            commit(self, manifest)
        except Conflict:
            conflicts.append(manifest.runs[-1])
            raise

    monkeypatch.setattr(Store, "commit", overtaken)
    update_catalog(spark, home, a, "a")
    assert conflicts == ["a"]
    assert sorted(r["isrc"] for r in read_catalog(spark, home, "tracks").collect()) == ["I0", "I1", "I2"]
    assert read_catalog(spark, home, "albums").count() == 1  # made from `b`'s state, `a` found its album
    assert catalog_store(spark, home).newest()[0].runs == ("zero", "b", "a")


def test_a_manifest_that_is_not_whole_does_not_count(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("cadenza.sources.buckets.PATIENCE", 0.1)
    home = Workspace(str(tmp_path), "w", "u")
    update_catalog(spark, home, items(spark, ("I0", "Zero", "Ann", None, None)), "zero")
    folder = tmp_path / "workspaces" / "w" / "catalog" / "manifests"
    (folder / f"{2:012d}.json").write_text('{"runs": ["broken"], "tab')
    assert catalog_store(spark, home).newest()[0].version == 1
    update_catalog(spark, home, items(spark, ("I1", "One", "Ann", None, None)), "one")
    assert catalog_store(spark, home).newest()[0].version == 3
    assert read_catalog(spark, home, "tracks").count() == 2
