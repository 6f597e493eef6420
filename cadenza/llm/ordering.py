"""A total order's row numbers without any task that sees more than its share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.session import parallelism, staged

_INDEX = 33  # bits of a row's place in its partition, as monotonically_increasing_id has them


def ranked(frame: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """The frame with each row's place, from 0, in the order of the given columns.

    Rows are range-partitioned, sorted and written once; a row's place is that
    in its partition plus the rows of the partitions before, which are one small
    count each. A salt ends the sort key, so rows that agree in all of it are
    dealt over partitions too; which of them comes first is left open.
    """
    salted = frame.withColumn("__salt", F.monotonically_increasing_id())
    parts = parallelism(frame.sparkSession)
    dealt = salted.repartitionByRange(parts, *order, "__salt").sortWithinPartitions(*order, "__salt").drop("__salt")
    placed = staged(dealt.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", _INDEX)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))  # one row per partition
    so_far = F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = F.broadcast(sizes.select("__part", F.coalesce(so_far, F.lit(0)).alias("__before")))
    place = F.col("__at").bitwiseAND(F.lit((1 << _INDEX) - 1)) + F.col("__before")
    return placed.withColumn("__part", part).join(offsets, "__part").withColumn(name, place).drop("__at", "__part", "__before")


def running_totals(frame: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The frame with the sum of `value` over the rows before in its group, as `name`, and the group's `total`.

    Groups may be of any size: rows are range-partitioned by group and order,
    sums run within a partition, and what a group has in the partitions before
    is added from one row per group and partition. Null groups are a group.
    Rows that tie follow each other in an order left open.
    """
    parts = parallelism(frame.sparkSession)
    dealt = frame.repartitionByRange(parts, *group, *order).sortWithinPartitions(*group, *order)
    placed = staged(dealt.withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumn("__part", F.shiftright("__at", _INDEX))
    inner = Window.partitionBy("__part", *group).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("__part", *group).agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)))
    sums = sums.withColumn("total", F.sum("__sum").over(Window.partitionBy(*group))).drop("__sum")
    same = F.col("__part") == F.col("__p")
    for column in group:
        same &= F.col(column).eqNullSafe(F.col(f"__{column}"))
    sums = sums.select(F.col("__part").alias("__p"), *[F.col(c).alias(f"__{c}") for c in group], "__before", "total")
    run = F.coalesce(F.sum(value).over(inner), F.lit(0))
    placed = placed.withColumn("__run", run).join(sums, same)
    return placed.withColumn(name, F.col("__run") + F.col("__before")).drop("__at", "__part", "__p", "__run", "__before", *[f"__{c}" for c in group])
