"""From staged report files to royalties, rejects, catalog and ledger.

Files of one layout and header are read in one scan; the number of Spark jobs
follows the number of distinct headers, not of files.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections import defaultdict
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import catalog, partials
from cadenza.operators.normalize import dataset_row_counts, normalize, rejects
from cadenza.schema import DATASET_ID, RequestError
from cadenza.sources.buckets import Manifest, Store, bucket_of, touched
from cadenza.sources.detect import source_of
from cadenza.session import staged
from cadenza.sources.files import clear_datasets, heads, processed_path, read_report, read_royalties, staging_path, write_royalties

LEDGER = "dataset_id string, status string, row_count bigint, error_message string, updated_at timestamp, seq int"
CATALOG_TABLES = {
    "artists": catalog.ARTIST_COLUMNS,
    "albums": catalog.ALBUM_COLUMNS,
    "tracks": catalog.TRACK_COLUMNS,
}
STRING_BUT = {"release_date": "date"}


@dataclass(frozen=True)
class Workspace:
    """Where one tenant's files live and who owns its catalog."""

    root: str
    workspace_id: str
    owner_user_id: str

    @property
    def home(self) -> str:
        return f"{self.root.rstrip('/')}/workspaces/{self.workspace_id}"

    @property
    def staging(self) -> str:
        return staging_path(self.root, self.workspace_id)

    @property
    def processed(self) -> str:
        return processed_path(self.root, self.workspace_id)

    def table(self, name: str) -> str:
        return f"{self.home}/{name}"


def stem(path: str):
    """Dataset id of a file: its name without folder and extension."""
    return F.regexp_extract(F.col(path), r"([^/]+?)(\.[^./]*)?$", 1)


def staged_files(
    spark: SparkSession,
    workspace: Workspace,
    declared: Mapping[str, str],
    folder: str | None = None,
    paths: list[str] | None = None,
) -> DataFrame:
    """Path, dataset id, layout, header line and kind of line end of every staged file."""
    files = heads(spark, paths or folder or workspace.staging).withColumn(DATASET_ID, stem("path"))
    named = spark.createDataFrame(list(declared.items()), f"{DATASET_ID} string, named string")
    return files.join(F.broadcast(named), DATASET_ID, "left").select(
        "path", DATASET_ID, source_of(F.col("named"), F.col("snippet")).alias("source"), "header", "line_end"
    )


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def catalog_store(spark: SparkSession, workspace: Workspace) -> Store:
    return Store(spark, workspace.table("catalog"))


def committed_snapshot(spark: SparkSession, workspace: Workspace) -> tuple[int, set[str]]:
    """The number of the newest whole state of the catalog (0 for none), and the runs that led to it."""
    newest, _ = catalog_store(spark, workspace).newest()
    return newest.version, set(newest.runs)


def read_catalog(spark: SparkSession, workspace: Workspace, name: str, snapshot: int | None = None) -> DataFrame:
    """A catalog table as its newest whole state has it, or as of a snapshot; empty where there is none."""
    store = catalog_store(spark, workspace)
    return store.table(store.newest(snapshot)[0], name, _schema(name))


def _schema(name: str) -> str:
    return ", ".join(f"{c} {STRING_BUT.get(c, 'string')}" for c in CATALOG_TABLES[name])


def read_ledger(spark: SparkSession, workspace: Workspace) -> DataFrame:
    """All entries ever written about the workspace's datasets."""
    return _stored(spark, workspace.table("datasets"), LEDGER)


def tables_of(spark: SparkSession, workspace: Workspace) -> DataFrame:
    """table_name, column_name, data_type and position of all a workspace's tables."""
    frames = {"royalty_data": read_royalties(spark, workspace.processed), "datasets": read_ledger(spark, workspace)}
    frames |= {name: read_catalog(spark, workspace, name) for name in CATALOG_TABLES}
    rows = [(name, column, kind, k) for name, frame in sorted(frames.items()) for k, (column, kind) in enumerate(frame.dtypes)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, position int")


def workspace_summary(spark: SparkSession, workspace: Workspace) -> DataFrame:
    """The workspace's summary from what each dataset's run has stored; no royalty file is opened."""
    kept = "kind string, name string, net_revenue decimal(38,9), quantity bigint, dataset_id string"
    return partials.summary_of(_stored(spark, workspace.table("totals"), kept))


#: Albums by artist and title, so that an item without a UPC finds its album: the album's id and bucket.
TITLES = "owner_user_id string, artist_id string, title_key string, album_id string, album_bucket int"


def _album_key() -> list[Column]:
    """An album is told by its UPC, one without by artist and title."""
    coded = F.col("upc").isNotNull()
    return [F.col(catalog.OWNER), coded, F.when(coded, F.col("upc")).otherwise(F.concat_ws("\x1f", "artist_id", F.lower("title")))]


def _titles(albums: DataFrame) -> DataFrame:
    return albums.select(catalog.OWNER, "artist_id", F.lower("title").alias("title_key"), F.col("id").alias("album_id"), bucket_of(_album_key()).alias("album_bucket"))


def update_catalog(spark: SparkSession, workspace: Workspace, royalties: DataFrame, run: str) -> None:
    """Bring a run's artists, albums and tracks into the catalog.

    Only buckets that the run's items fall into are read, only those that change
    are written. Runs may go on at once: one that was overtaken is worked out
    again from the newer state. A run that was committed before is not applied
    again.
    """
    owned = royalties.withColumn(catalog.OWNER, F.lit(workspace.owner_user_id))
    # Each table's job reads the items, so they are worked out once.
    items = staged(catalog.catalog_items(owned))
    store = catalog_store(spark, workspace)

    def make(base: Manifest) -> dict[str, dict[int, str]]:
        def kept(name: str, schema: str, buckets: list[int]) -> DataFrame:
            return store.table(base, name, schema, buckets)

        def put(name: str, old: DataFrame, new: DataFrame, keys: list[Column]) -> None:
            written[name] = store.write(name, old, new, keys)

        written: dict[str, dict[int, str]] = {}
        owner = F.col(catalog.OWNER)
        by_name = [owner, F.col("name")]
        old_artists = kept("artists", _schema("artists"), touched(items.withColumn("name", F.col("artist")), by_name))
        artists = staged(catalog.upsert_artists(items, old_artists))
        put("artists", old_artists, artists, by_name)

        # Albums the items can mean: by UPC, by artist and title, and others that have that title now.
        ids = artists.select(catalog.OWNER, F.col("name").alias("artist"), F.col("id").alias("artist_id"))
        named = items.where("album_title is not null").join(ids, [catalog.OWNER, "artist"]).withColumn("title", F.col("album_title"))
        by_title = [owner, F.col("artist_id"), F.col("title_key")]
        asked = named.where("upc is null").select(catalog.OWNER, "artist_id", F.lower("title").alias("title_key")).distinct()
        known = kept("titles", TITLES, touched(asked, by_title)).join(asked, [catalog.OWNER, "artist_id", "title_key"], "left_semi")
        buckets = touched(named, _album_key()) + [r[0] for r in known.select("album_bucket").distinct().collect()]  # at most BUCKETS
        old_albums = kept("albums", _schema("albums"), buckets)
        albums = staged(catalog.upsert_albums(items, old_albums, artists))
        put("albums", old_albums, albums, _album_key())

        gone, come = _titles(old_albums).exceptAll(_titles(albums)), _titles(albums).exceptAll(_titles(old_albums))
        old_titles = kept("titles", TITLES, touched(gone.union(come), by_title))
        put("titles", old_titles, old_titles.exceptAll(gone).union(come), by_title)

        by_isrc = [owner, F.col("isrc")]
        old_tracks = kept("tracks", _schema("tracks"), touched(items, by_isrc))
        put("tracks", old_tracks, catalog.upsert_tracks(items, old_tracks, albums, artists), by_isrc)
        return written

    store.change(run, make)


def write_ledger(
    spark: SparkSession, workspace: Workspace, run: str, seq: int, entries: list[tuple]
) -> None:
    """Add entries (dataset, status, rows, message) to the ledger; a repeated run replaces its own."""
    now = dt.datetime.now(dt.timezone.utc)
    rows = [(*entry, now, seq) for entry in entries]
    path = f"{workspace.table('datasets')}/batch={run}/part={seq}"
    spark.createDataFrame(rows, LEDGER).coalesce(1).write.mode("overwrite").parquet(path)


def store_batch(
    spark: SparkSession,
    workspace: Workspace,
    rows: DataFrame | None,
    bad: DataFrame | None,
    datasets: list[str],
    failed: list[tuple[str, str]],
    run: str,
) -> None:
    """Store one batch of normalized rows; running it again changes nothing.

    `datasets` are those whose files could be read, also files without a row:
    they are READY with 0 rows, and rows stored of them earlier go.
    """
    counts: dict[str, int] = {}
    if rows is not None:
        ready = staged(rows)
        write_royalties(ready, workspace.processed)
        bad.write.mode("overwrite").parquet(f"{workspace.table('rejects')}/batch={run}")
        counts = {r[DATASET_ID]: r["row_count"] for r in dataset_row_counts(ready).collect()}  # one per file
        partials.store(partials.totals(ready), workspace.table("totals"))
        partials.store(partials.sketches(ready), workspace.table("sketches"))
        update_catalog(spark, workspace, ready, run)
    empty = [d for d in datasets if d not in counts]
    for path in (workspace.processed, workspace.table("totals"), workspace.table("sketches")):
        clear_datasets(spark, path, empty)
    entries = [(d, "READY", counts.get(d, 0), None) for d in datasets]
    entries += [(d, "FAILED", 0, message) for d, message in failed]
    write_ledger(spark, workspace, run, 1, entries)


def ingest_files(spark: SparkSession, workspace: Workspace, files: list, run: str) -> None:
    """Ingest files given as rows of `staged_files`. One that cannot be read is FAILED in the ledger.

    Files are read together only if layout and header are the same, so columns
    are never taken for others by their place.
    """
    if not files:
        return
    write_ledger(spark, workspace, run, 0, [(f[DATASET_ID], "PROCESSING", 0, None) for f in files])
    groups: dict[tuple[str, str, str], list] = defaultdict(list)
    for file in files:
        groups[(file["source"], file["header"], file["line_end"])].append(file)
    rows, bad, datasets, failed = None, None, [], []
    for (source, *_), same in sorted(groups.items()):
        raw = read_report(spark, [f["path"] for f in same], "_path")
        raw = raw.withColumn(DATASET_ID, stem("_path")).drop("_path")
        try:
            part, notes = normalize(raw, source), rejects(raw, source)
        except RequestError as error:
            failed += [(f[DATASET_ID], str(error)) for f in same]
            continue
        datasets += [f[DATASET_ID] for f in same]
        rows = part if rows is None else rows.unionByName(part)
        bad = notes if bad is None else bad.unionByName(notes)
    store_batch(spark, workspace, rows, bad, datasets, failed, run)


def ingest(
    spark: SparkSession,
    workspace: Workspace,
    declared: Mapping[str, str] | None = None,
    run: str | None = None,
) -> str:
    """Ingest every staged file and return the name of the run, a new one unless given.

    What comes to the driver is one short row per file, as file listing does:
    its layout and header, which tasks have read.
    """
    run = run or f"files-{uuid.uuid4().hex}"
    files = staged_files(spark, workspace, declared or {}).collect()
    ingest_files(spark, workspace, files, run)
    return run
