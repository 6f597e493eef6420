"""Connected components of a link table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.session import staged


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node that each node of `a`, `b` links reaches.

    Large-star and small-star steps in turn: every node hangs its larger, then
    its smaller neighbours on the smallest one it knows. Each turn is written to
    the shared folder; they end when every node hangs on one root. A node with
    very many links is only ever a group with a minimum and one side of a join.
    Nulls and links of a node to itself are left out.
    """
    low, high = F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")
    stars = staged(links.where("a <> b").select(high, low).distinct())
    while _unsettled(stars):
        stars = staged(_small_star(_large_star(stars)))
    return stars.select(F.col("high").alias("node"), F.col("low").alias("component"))


def _unsettled(stars: DataFrame) -> bool:
    """Whether a node hangs on two others, or on one that hangs on a third."""
    ends = stars.select(F.col("high").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
    ends = ends.union(stars.select("low", F.lit(0), F.lit(1)))
    ends = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return bool(ends.where("hangs > 1 or (hangs > 0 and holds > 0)").limit(1).count())


def _large_star(stars: DataFrame) -> DataFrame:
    both = stars.select(F.col("high").alias("at"), F.col("low").alias("to")).union(stars.select("low", "high"))
    least = both.groupBy("at").agg(F.min("to").alias("root"))
    least = least.select("at", F.least("at", "root").alias("root"))
    return both.join(least, "at").where("to > at").select(F.col("to").alias("high"), F.col("root").alias("low")).distinct()


def _small_star(stars: DataFrame) -> DataFrame:
    least = stars.groupBy("high").agg(F.min("low").alias("root"))
    moved = stars.join(least, "high").where("low <> root").select(F.col("low").alias("high"), F.col("root").alias("low"))
    return moved.union(least.select("high", F.col("root").alias("low"))).distinct()
