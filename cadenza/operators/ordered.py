"""Look-ahead and running values in order per key, with busy keys split.

A window per key hands each key to one task. Keys with more rows than
`slice_rows` are cut into slices of equal size along their order instead
(a range partitioning by key and order, written to the shared checkpoint
folder so that slices never change). Windows then run per slice, and what
crosses a slice's edge comes from one small row per slice. All other keys take
the plain path and one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.operators.joins import BROADCAST_BYTES
from cadenza.session import ensure_checkpoint_dir, parallelism, staged

SLICE = "_slice"
WHOLE = -1
SLICE_ROWS = 2_000_000


@dataclass(frozen=True)
class Ordered:
    """Rows with a slice column; `split` tells whether any key was cut."""

    rows: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    split: bool

    def group(self) -> list[str]:
        return [SLICE, *self.keys]

    def with_rows(self, rows: DataFrame) -> Ordered:
        return Ordered(rows, self.keys, self.order, self.split)

    def window(self, *more: str, backwards: bool = False) -> WindowSpec:
        order = [F.desc(c) if backwards else F.asc(c) for c in self.order]
        return W.partitionBy(*self.group(), *more).orderBy(*order)

    def across(self, *more: str) -> WindowSpec:
        """The slices of a key in order: one row per slice, so never many."""
        return W.partitionBy(*self.keys, *more).orderBy(SLICE)

    def cut(self) -> DataFrame:
        return self.rows.where(F.col(SLICE) != WHOLE)

    def done(self) -> DataFrame:
        return self.rows.drop(SLICE)


def slices(rows: DataFrame, keys: Sequence[str], order: Sequence[str], number: int | None = None) -> DataFrame:
    """Rows cut into equal slices by keys and order, numbered and sorted.

    There are `number` slices, or as many as shuffle partitions. `order` must tell any two rows of a key apart.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    by = [*keys, *order]
    return (
        rows.repartitionByRange(number or parallelism(rows.sparkSession), *by)
        .sortWithinPartitions(*by)
        .withColumn(SLICE, F.spark_partition_id())
        .checkpoint()
    )


def _busy(rows: DataFrame, keys: Sequence[str], slice_rows: int) -> tuple[DataFrame, int] | None:
    """Keys with more rows than a slice should hold and the slices to cut them into, or None if there are none."""
    counted = staged(rows.groupBy(*keys).count().where(F.col("count") > slice_rows))
    text = sum((F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0)) + 32 for k in keys), F.lit(0))
    found = counted.agg(F.sum("count").alias("rows"), F.sum(text).alias("bytes")).first()
    if not found["rows"]:
        return None
    busy = counted.drop("count")
    cuts = max(parallelism(rows.sparkSession), -(-found["rows"] // slice_rows))
    return (F.broadcast(busy) if found["bytes"] <= BROADCAST_BYTES else busy), cuts


def busy_keys(rows: DataFrame, keys: Sequence[str], slice_rows: int) -> DataFrame | None:
    """Keys with more rows than a slice should hold, or None if there are none."""
    found = _busy(rows, keys, slice_rows)
    return found and found[0]


def part(
    rows: DataFrame, keys: Sequence[str], slice_rows: int
) -> tuple[DataFrame, DataFrame | None, int]:
    """Rows of ordinary keys, rows of busy ones if there are any, and the slices to cut these into."""
    found = _busy(rows, keys, slice_rows)
    if found is None:
        return rows, None, 0
    busy, cuts = found
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    left, right = rows.alias("r"), busy.alias("b")
    return left.join(right, same, "left_anti"), left.join(right, same, "left_semi"), cuts


def ordered(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], slice_rows: int = SLICE_ROWS
) -> Ordered:
    plain, busy, cuts = part(rows, keys, slice_rows)
    whole = plain.withColumn(SLICE, F.lit(WHOLE))
    if busy is None:
        return Ordered(whole, tuple(keys), tuple(order), False)
    both = whole.unionByName(slices(busy, keys, order, cuts))
    return Ordered(both, tuple(keys), tuple(order), True)


def _carry(data: Ordered, edges: DataFrame, name: str, more: Sequence[str] = ()) -> DataFrame:
    """Rows with their slice's carried value as `_carry`; null keys match too.

    `edges` has one row per slice and key (and `more`), so it is small.
    """
    key = [*data.group(), *more]
    edges = edges.select(*[F.col(k).alias(f"_e{i}") for i, k in enumerate(key)], F.col(name).alias("_carry"))
    same = [F.col(k).eqNullSafe(F.col(f"_e{i}")) for i, k in enumerate(key)]
    return data.rows.join(edges, same, "left").drop(*[f"_e{i}" for i in range(len(key))])


def with_next(data: Ordered, value: str, name: str) -> Ordered:
    """The key's next value of a column that is never null."""
    local = data.with_rows(data.rows.withColumn(name, F.lead(value).over(data.window())))
    if not data.split:
        return local
    first = F.min_by(F.col(value), F.struct(*data.order)).alias("edge")
    edges = data.cut().groupBy(*data.group()).agg(first)
    edges = edges.withColumn("edge", F.lead("edge").over(data.across()))
    return local.with_rows(
        _carry(local, edges, "edge").withColumn(name, F.coalesce(name, "_carry")).drop("_carry")
    )


def with_next_where(data: Ordered, flag: Column, value: Column, name: str) -> Ordered:
    """`value` of the key's next row that has `flag` set.

    The window runs backwards: a frame that ends before the current row grows
    row by row, while one that reaches to the end would be redone for each.
    """
    hit = F.when(flag, value)
    back = data.window(backwards=True).rowsBetween(W.unboundedPreceding, -1)
    local = data.with_rows(data.rows.withColumn(name, F.last(hit, ignorenulls=True).over(back)))
    if not data.split:
        return local
    first = F.min_by(hit, F.when(flag, F.struct(*data.order))).alias("edge")
    edges = data.cut().groupBy(*data.group()).agg(first)
    later = W.partitionBy(*data.keys).orderBy(F.desc(SLICE)).rowsBetween(W.unboundedPreceding, -1)
    edges = edges.withColumn("edge", F.last("edge", ignorenulls=True).over(later))
    return local.with_rows(
        _carry(local, edges, "edge").withColumn(name, F.coalesce(name, "_carry")).drop("_carry")
    )


def with_position(data: Ordered, name: str) -> Ordered:
    """How many rows of the key come before this one."""
    place = F.row_number().over(data.window()).cast("bigint") - 1
    local = data.with_rows(data.rows.withColumn(name, place))
    if not data.split:
        return local
    before = data.across().rowsBetween(W.unboundedPreceding, -1)
    edges = data.cut().groupBy(*data.group()).agg(F.count("*").alias("edge"))
    edges = edges.withColumn("edge", F.sum("edge").over(before))
    return local.with_rows(
        _carry(local, edges, "edge")
        .withColumn(name, F.col(name) + F.coalesce("_carry", F.lit(0)))
        .drop("_carry")
    )


def with_running_max(data: Ordered, value: str, name: str, more: Sequence[str] = ()) -> Ordered:
    """Greatest value so far within the key (and the `more` columns)."""
    so_far = data.window(*more).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = data.with_rows(data.rows.withColumn(name, F.max(value).over(so_far)))
    if not data.split:
        return local
    before = data.across(*more).rowsBetween(W.unboundedPreceding, -1)
    edges = data.cut().groupBy(*data.group(), *more).agg(F.max(value).alias("edge"))
    edges = edges.withColumn("edge", F.max("edge").over(before))
    return local.with_rows(
        _carry(local, edges, "edge", more)
        .withColumn(name, F.greatest(name, "_carry"))
        .drop("_carry")
    )
