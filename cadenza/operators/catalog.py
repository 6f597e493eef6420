"""Artist, album and track catalog kept up by set-based jobs.

Every job reads frames and returns the next snapshot. Ids are hashes of natural
keys, so running a job twice gives the same catalog.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.cleaning import blank, trimmed_or_null
from cadenza.functions.music import natural_id
from cadenza.operators.access import role_rank
from cadenza.schema import UNKNOWN_ARTIST

OWNER = "owner_user_id"
ARTIST_COLUMNS = ["id", OWNER, "name"]
ALBUM_COLUMNS = ["id", OWNER, "artist_id", "title", "upc", "release_date"]
TRACK_COLUMNS = ["id", OWNER, "artist_id", "album_id", "isrc", "title"]


def catalog_items(royalties: DataFrame) -> DataFrame:
    """Distinct catalog facts in royalty rows; rows lacking isrc or title are skipped.

    An `owner_user_id` column is kept if the rows carry one.
    """
    return catalog_facts(royalties).distinct()


def catalog_facts(royalties: DataFrame) -> DataFrame:
    """As `catalog_items`, once per royalty row: enough for the jobs below, which reduce them by their own keys."""
    kept = [OWNER] if OWNER in royalties.columns else []
    return royalties.where(~blank(F.col("isrc")) & ~blank(F.col("title"))).select(
        *kept,
        F.coalesce(trimmed_or_null(F.col("artist")), F.lit(UNKNOWN_ARTIST)).alias("artist"),
        trimmed_or_null(F.col("album")).alias("album_title"),
        trimmed_or_null(F.col("upc")).alias("upc"),
        F.trim("isrc").alias("isrc"),
        F.trim("title").alias("track_title"),
    )


def catalog_rejects(royalties: DataFrame) -> DataFrame:
    """How many rows the catalog skips, per missing field."""
    reason = F.when(blank(F.col("isrc")), "blank isrc").when(blank(F.col("title")), "blank title")
    return (
        royalties.select(reason.alias("reason"))
        .where("reason IS NOT NULL")
        .groupBy("reason")
        .agg(F.count("*").alias("rejected"))
    )


def blank_names(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose name is empty after trimming; creating them is refused."""
    return rows.where(blank(F.col(column)))


def upsert_artists(items: DataFrame, artists: DataFrame) -> DataFrame:
    """Artists after adding those the items name; key (owner, name)."""
    key = [OWNER, "name"]
    named = items.select(OWNER, F.col("artist").alias("name")).distinct()
    added = named.join(artists, key, "left_anti").withColumn("id", natural_id(*map(F.col, key)))
    return artists.select(*ARTIST_COLUMNS).unionByName(added.select(*ARTIST_COLUMNS))


def _with_artist_id(items: DataFrame, artists: DataFrame) -> DataFrame:
    ids = artists.select(
        OWNER, F.col("name").alias("artist"), F.col("id").alias("artist_id")
    )
    return items.join(ids, [OWNER, "artist"], "left")


def _by_title(albums: DataFrame) -> DataFrame:
    """Smallest album id per (owner, artist, title without case)."""
    return albums.groupBy(OWNER, "artist_id", F.lower("title").alias("title_key")).agg(
        F.min("id").alias("album_id")
    )


def upsert_albums(items: DataFrame, albums: DataFrame, artists: DataFrame) -> DataFrame:
    """Albums after adding or renaming those the items name.

    Items with a UPC go first: key (owner, upc), title and artist overwritten.
    Items without one match an album of that artist and title, case ignored,
    and are added if none is there. Of rival items the greatest
    (artist, title) wins.
    """
    named = _with_artist_id(
        items.where("album_title IS NOT NULL")
        .select(OWNER, "artist", F.col("album_title").alias("title"), "upc")
        .distinct(),
        artists,
    )
    rival = F.max(F.struct("artist", "title", "artist_id")).alias("new")
    coded = named.where("upc IS NOT NULL").groupBy(OWNER, "upc").agg(rival)
    kept = albums.select(*ALBUM_COLUMNS).where("upc IS NOT NULL")
    with_upc = kept.join(coded, [OWNER, "upc"], "full").select(
        F.coalesce("id", natural_id(F.col(OWNER), F.lit("upc"), F.col("upc"))).alias("id"),
        OWNER,
        F.coalesce("new.artist_id", "artist_id").alias("artist_id"),
        F.coalesce("new.title", "title").alias("title"),
        "upc",
        "release_date",
    )
    current = with_upc.unionByName(albums.select(*ALBUM_COLUMNS).where("upc IS NULL"))

    title_key = F.lower("title").alias("title_key")
    plain = (
        named.where("upc IS NULL")
        .groupBy(OWNER, "artist_id", title_key)
        .agg(F.max("title").alias("title"))
    )
    added = plain.join(_by_title(current), [OWNER, "artist_id", "title_key"], "left_anti").select(
        natural_id(F.col(OWNER), F.col("artist_id"), F.col("title_key")).alias("id"),
        OWNER,
        "artist_id",
        "title",
        F.lit(None).cast("string").alias("upc"),
        F.lit(None).cast("date").alias("release_date"),
    )
    return current.unionByName(added)


def upsert_tracks(
    items: DataFrame, tracks: DataFrame, albums: DataFrame, artists: DataFrame
) -> DataFrame:
    """Tracks after adding or renaming those the items name; key (owner, isrc).

    Title and artist are overwritten; the album only if the item has one. Of
    rival items the greatest (has an album, artist, title, album, upc) wins.
    """
    winner = F.max(
        F.struct(
            F.col("album_title").isNotNull().alias("has_album"),
            "artist",
            "track_title",
            "album_title",
            "upc",
        )
    ).alias("w")
    best = (
        items.groupBy(OWNER, "isrc")
        .agg(winner)
        .select(OWNER, "isrc", "w.artist", "w.track_title", "w.album_title", "w.upc")
    )
    best = _with_artist_id(best, artists)
    by_upc = albums.where("upc IS NOT NULL").select(
        OWNER, "upc", F.col("id").alias("album_by_upc")
    )
    titled = (
        best.withColumn("title_key", F.lower("album_title"))
        .join(by_upc, [OWNER, "upc"], "left")
        .join(
            _by_title(albums).withColumnRenamed("album_id", "album_by_title"),
            [OWNER, "artist_id", "title_key"],
            "left",
        )
    )
    album = F.when(F.col("upc").isNotNull(), F.col("album_by_upc")).otherwise(
        F.col("album_by_title")
    )
    new = titled.select(
        OWNER,
        "isrc",
        F.col("artist_id").alias("new_artist"),
        F.when(F.col("album_title").isNotNull(), album).alias("new_album"),
        "track_title",
    )
    return tracks.select(*TRACK_COLUMNS).join(new, [OWNER, "isrc"], "full").select(
        F.coalesce("id", natural_id(F.col(OWNER), F.col("isrc"))).alias("id"),
        OWNER,
        F.coalesce("new_artist", "artist_id").alias("artist_id"),
        F.coalesce("new_album", "album_id").alias("album_id"),
        "isrc",
        F.coalesce("track_title", "title").alias("title"),
    )


def upsert_named(named: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Existing rows plus those whose key is new (payees by owner and name).

    Of new rows with one key that with the greatest other columns is taken.
    """
    rest = [c for c in named.columns if c not in key]
    if rest:
        named = named.groupBy(*key).agg(F.max(F.struct(*rest)).alias("one")).select(*key, "one.*")
    else:
        named = named.distinct()
    added = named.join(existing, key, "left_anti")
    added = added.withColumn("id", natural_id(*[F.col(k) for k in key]))
    return existing.unionByName(added, allowMissingColumns=True)


def upsert_members(changes: DataFrame, members: DataFrame) -> DataFrame:
    """Workspace members after the changes; a known member's role is overwritten.

    Of rival changes the latest by `changed_at` holds; among equal times, or
    without that column, the weaker role, so that no rival gains rights by chance.
    """
    key = ["workspace_id", "user_id"]
    when = F.col("changed_at") if "changed_at" in changes.columns else F.lit(0)
    new = changes.groupBy(*key).agg(F.max_by("role", F.struct(when, -role_rank(F.col("role")), F.col("role"))).alias("new_role"))
    return members.join(new, key, "full").select(
        *key, F.coalesce("new_role", "role").alias("role")
    )


def patch(rows: DataFrame, changes: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """Partial update: a null in the change keeps the old value.

    Of several changes to one row the greatest value of each column holds.
    """
    new = changes.groupBy(key).agg(*[F.max(c).alias(f"new_{c}") for c in columns])
    return rows.join(new, key, "left").select(
        *[F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns]
    )


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys held by more than one row, with how often."""
    return rows.groupBy(*key).agg(F.count("*").alias("copies")).where("copies > 1")


def _without(rows: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """Rows whose `column` is not among the deleted ids; null never is."""
    return rows.join(gone.select(F.col("id").alias(column)), column, "left_anti").select(
        *rows.columns
    )


def delete_albums(gone: DataFrame, catalog: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Catalog without the albums: their splits go, their tracks lose the album."""
    ids = gone.select(F.col("id").alias("album_id"), F.lit(True).alias("gone")).distinct()
    tracks = catalog["tracks"]
    cleared = tracks.join(ids, "album_id", "left").withColumn(
        "album_id", F.when(F.col("gone").isNull(), F.col("album_id"))
    )
    return {
        **catalog,
        "albums": _without(catalog["albums"], gone, "id"),
        "tracks": cleared.select(*tracks.columns),
        "splits": _without(catalog["splits"], gone, "album_id"),
    }


def delete_artists(gone: DataFrame, catalog: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Catalog without the artists and all that hangs on them."""
    ids = gone.select(F.col("id").alias("artist_id"))
    albums = catalog["albums"].join(ids, "artist_id", "left_semi").select("id")
    tracks = catalog["tracks"].join(ids, "artist_id", "left_semi").select("id")
    rest = delete_albums(albums, catalog)
    return {
        **rest,
        "artists": _without(rest["artists"], gone, "id"),
        "tracks": _without(rest["tracks"], gone, "artist_id"),
        "splits": _without(_without(rest["splits"], gone, "artist_id"), tracks, "track_id"),
    }


def payees_in_use(gone: DataFrame, splits: DataFrame) -> DataFrame:
    """Payees that must not be deleted because a split still names them."""
    return gone.join(splits.select(F.col("payee_id").alias("id")), "id", "left_semi")

