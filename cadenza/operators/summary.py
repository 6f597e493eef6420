"""Headline figures of a workspace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.schema import MONEY


def kpis(royalties: DataFrame) -> DataFrame:
    """Revenue, streams and the number of tracks that earned, in one row."""
    return royalties.agg(
        F.coalesce(F.sum("net_revenue"), F.lit(0).cast(MONEY))
        .cast("double")
        .alias("total_net_revenue"),
        F.countDistinct("isrc").alias("total_tracks_monetized"),
        F.coalesce(F.sum("quantity"), F.lit(0).cast("bigint")).alias("total_streams"),
    )


def top_by_revenue(royalties: DataFrame, column: str, count: int = 1) -> DataFrame:
    """Highest earning values of a column; equal revenue sorts by name."""
    return (
        royalties.groupBy(column)
        .agg(F.sum("net_revenue").alias("rev"))
        .orderBy(F.desc("rev"), F.asc(column))
        .limit(count)
    )


def summary(royalties: DataFrame) -> DataFrame:
    """The figures of `kpis` plus the top artist, platform and track title.

    The rows are reduced once to their distinct (artist, platform, title, isrc);
    grouping sets over that small frame give all totals in one further shuffle,
    and a last aggregate picks the winners. No join, no second scan, and no
    group is ever held whole.
    """
    reduced = royalties.groupBy("artist", "platform", "title", "isrc").agg(
        F.sum("net_revenue").alias("rev"), F.sum("quantity").alias("qty")
    )
    names = [F.col(c) for c in ("artist", "platform", "title", "isrc")]
    sets = [[n] for n in names]
    totals = reduced.groupingSets(sets, *names).agg(
        F.sum("rev").alias("rev"),
        F.sum("qty").alias("qty"),
        *[F.grouping(n).alias(f"no_{c}") for n, c in zip(names, ("artist", "platform", "title", "isrc"))],
    )

    own = {c: F.col(f"no_{c}") == 0 for c in ("artist", "platform", "title", "isrc")}
    return from_totals(totals, own, {c: F.col(c) for c in own})


def from_totals(totals: DataFrame, own: dict[str, Column], names: dict[str, Column]) -> DataFrame:
    """The summary from rows of `rev` and `qty` per artist, platform, title and isrc.

    `own` tells per column which rows are its totals, `names` where their names are.
    """

    def top(column: str) -> Column:
        rank = F.when(own[column], F.struct(-F.col("rev"), names[column]))
        return F.min_by(names[column], rank).alias(f"top_{'track' if column == 'title' else column}")

    per_track = own["isrc"]
    return totals.agg(
        F.coalesce(F.sum(F.when(per_track, F.col("rev"))), F.lit(0).cast(MONEY))
        .cast("double")
        .alias("total_net_revenue"),
        F.coalesce(F.sum(F.when(per_track, F.col("qty"))), F.lit(0).cast("bigint")).alias(
            "total_streams"
        ),
        top("artist"),
        top("platform"),
        top("title"),
        F.count(F.when(per_track, names["isrc"])).alias("total_tracks_monetized"),
    )
