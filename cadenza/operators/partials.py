"""Figures of a workspace kept per dataset and merged when they are read.

What a dataset adds to the summary is a few rows per name it holds; what it adds
to approximate figures is one sketch each. A rerun replaces its own rows only, a
deleted dataset takes its rows along, and no royalty file is read to answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.summary import from_totals
from cadenza.schema import DATASET_ID

NAMED = ("artist", "platform", "title", "isrc")
#: Sizes of the sketches. A distinct count is off by 0.8% in the mean square, a rank by 0.4% at most in 99 of 100 cases.
DISTINCT_LG, RANK_K = 14, 800
DISTINCT_ERROR, RANK_ERROR = 0.025, 0.005


def totals(royalties: DataFrame) -> DataFrame:
    """dataset_id, kind, name, net_revenue and quantity: sums by artist, platform, title and isrc, per dataset.

    Every task adds up its own rows first, so that a dataset of any size sends
    one row per name and task.
    """
    dataset, names = F.col(DATASET_ID), [F.col(c) for c in NAMED]
    sets = royalties.groupingSets([[dataset, name] for name in names], dataset, *names)
    grouped = sets.agg(F.sum("net_revenue").alias("net_revenue"), F.sum("quantity").alias("quantity"), *[F.grouping(n).alias(f"no_{c}") for n, c in zip(names, NAMED)])
    kind, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for column in NAMED:
        own = F.col(f"no_{column}") == 0
        kind, name = F.when(own, column).otherwise(kind), F.when(own, F.col(column)).otherwise(name)
    return grouped.select(DATASET_ID, kind.alias("kind"), name.alias("name"), "net_revenue", "quantity")


def sketches(royalties: DataFrame) -> DataFrame:
    """dataset_id, rows and, as sketches, its isrcs and its revenues."""
    return royalties.groupBy(DATASET_ID).agg(
        F.count(F.lit(1)).alias("rows"),
        F.hll_sketch_agg("isrc", F.lit(DISTINCT_LG)).alias("isrcs"),
        F.kll_sketch_agg_double(F.col("net_revenue").cast("double"), F.lit(RANK_K)).alias("revenues"),
    )


def store(parts: DataFrame, path: str) -> None:
    """Store what `totals` or `sketches` gave; datasets that were there are replaced, others left alone."""
    writer = parts.hint("rebalance", F.col(DATASET_ID)).write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy(DATASET_ID).parquet(path)


def summary_of(stored: DataFrame) -> DataFrame:
    """The workspace's summary from stored totals: the same row as `summary` gives on the royalties."""
    merged = stored.groupBy("kind", "name").agg(F.sum("net_revenue").alias("rev"), F.sum("quantity").alias("qty"))
    own = {column: F.col("kind") == column for column in NAMED}
    return from_totals(merged, own, dict.fromkeys(NAMED, F.col("name")))


def estimates(stored: DataFrame, *fractions: float) -> DataFrame:
    """rows, tracks (estimated) and revenue_at (estimated values at the fractions), of any choice of stored datasets."""
    merged = stored.agg(
        F.sum("rows").alias("rows"), F.hll_union_agg("isrcs").alias("isrcs"), F.kll_merge_agg_double("revenues", F.lit(RANK_K)).alias("revenues")
    )
    at: list[Column] = [F.kll_sketch_get_quantile_double("revenues", F.lit(float(f))) for f in fractions]
    return merged.select("rows", F.hll_sketch_estimate("isrcs").alias("tracks"), F.array(*at).alias("revenue_at"))
