"""Window forms Spark SQL has no syntax for."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def over_groups(
    rows: DataFrame,
    aggregate: Callable[[], Column],
    partition: Sequence[str],
    order: str,
    preceding: int,
    following: int,
    name: str,
) -> DataFrame:
    """Aggregate over a GROUPS frame: whole sets of rows that tie on `order`.

    The dense rank numbers those sets, and a range over it is the frame.
    """
    ranked = rows.withColumn("_set", F.dense_rank().over(W.partitionBy(*partition).orderBy(order)))
    frame = W.partitionBy(*partition).orderBy("_set").rangeBetween(-preceding, following)
    return ranked.withColumn(name, aggregate().over(frame)).drop("_set")


def distinct_on(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in the given order.

    The rank filter lets Spark keep one row per key in every task before the
    shuffle, so a key that holds most rows sends few.
    """
    first = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
