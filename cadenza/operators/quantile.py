"""Exact percentiles of groups of any size.

A built-in exact percentile holds a group's distinct values in one task. Here a
large group is narrowed down: mergeable summaries of bounded size give values
that bracket the wanted ranks, exact counts tell how many rows lie below, and
only rows within the bracket stay. Each round leaves some three hundredths of
the rows, until few enough are left to be sorted.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.joins import lookup
from cadenza.session import staged

#: Rows of a group that one task may hold; steps of the grid, and the precision of its points.
HELD = 10_000
STEPS = 100
ACCURACY = 10_000


def _same(keys: list[str]) -> Column:
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return same


def _with(rows: DataFrame, known: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows with the columns known of their group; null keys are a group."""
    columns = [] if how in ("left_semi", "left_anti") else [F.col(f"b.{c}") for c in known.columns if c not in keys]
    return rows.alias("a").join(lookup(known, row_bytes=256).alias("b"), _same(keys), how).select("a.*", *columns)


def exact_percentile(rows: DataFrame, keys: list[str], value: str, fraction: float = 0.5, name: str = "percentile", held: int = HELD) -> DataFrame:
    """keys and the value at `fraction` of each group's order, between two neighbours in proportion, as a double.

    Null values do not count; a group of nulls alone has no row. `held` is how
    many rows of a group are ever sorted in one task.
    """
    return exact_percentiles(rows, keys, value, {name: fraction}, held)


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, fractions: Mapping[str, float], held: int = HELD) -> DataFrame:
    """As `exact_percentile`, a column for every named fraction.

    The rows are worked out once: keys and values are written, and all rounds read those.
    """
    data = staged(rows.select(*keys, F.col(value).alias("_v")).where("_v is not null"))
    sizes = staged(data.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    large = sizes.where(F.col("_n") > held)
    small = _with(data, large.select(*keys), keys, "left_anti").groupBy(*keys)
    small = small.agg(*[F.percentile("_v", F.lit(float(f))).alias(name) for name, f in fractions.items()])
    if large.isEmpty():
        return small
    own, found = _with(data, large.select(*keys), keys, "left_semi"), None
    for name, fraction in fractions.items():
        one = _of_large(own, large, keys, fraction, name, held)
        found = one if found is None else _with(found, one, keys)
    return small.unionByName(found)


def _of_large(left: DataFrame, large: DataFrame, keys: list[str], fraction: float, name: str, held: int) -> DataFrame:
    """One percentile of groups with more rows than are held; `large` has their sizes, `left` their rows."""
    place = (F.col("_n") - 1) * F.lit(float(fraction))
    wanted = large.select(*keys, "_n", F.floor(place).alias("_low"), F.ceil(place).alias("_high"), (place - F.floor(place)).alias("_part"))
    found = None
    while True:
        wanted = staged(_narrowed(left, wanted, keys))
        left = staged(_with(left, wanted.select(*keys, "_from", "_to"), keys).where("_v between _from and _to").drop("_from", "_to"))
        ready = wanted.where((F.col("_n") <= held) | (F.col("_from") == F.col("_to")))
        done = _picked(left, ready, keys, name)
        found = done if found is None else found.unionByName(done)
        wanted = wanted.where((F.col("_n") > held) & (F.col("_from") != F.col("_to"))).drop("_from", "_to")
        if wanted.isEmpty():
            return found
        left = _with(left, wanted.select(*keys), keys, "left_semi")


def _narrowed(left: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Each group's ranks among the rows of a smaller bracket, and the bracket (_from, _to).

    A point of the grid is off by at most 1 / ACCURACY of the rows, a step is a
    hundred times that: one step of margin makes the bracket certain.
    """
    points = F.array(*[F.lit(k / STEPS) for k in range(1, STEPS)])
    grid = left.groupBy(*keys).agg(F.array(F.min("_v")).alias("_least"), F.percentile_approx("_v", points, ACCURACY).alias("_grid"), F.array(F.max("_v")).alias("_most"))
    grid = grid.withColumn("_grid", F.concat("_least", "_grid", "_most"))
    known = _with(wanted, grid.select(*keys, "_grid"), keys)
    below = F.greatest(F.floor(F.col("_low") / F.col("_n") * STEPS) - 1, F.lit(0)).cast("int")
    above = F.least(F.ceil(F.col("_high") / F.col("_n") * STEPS) + 1, F.lit(STEPS)).cast("int")
    known = known.withColumns({"_from": F.get("_grid", below), "_to": F.get("_grid", above)}).drop("_grid")
    placed = _with(left, known.select(*keys, "_from", "_to"), keys).groupBy(*keys)
    counts = placed.agg(F.count_if(F.col("_v") < F.col("_from")).alias("_skipped"), F.count_if(F.expr("_v between _from and _to")).alias("_kept"))
    moved = _with(known, counts, keys)
    ranks = [(F.col(c) - F.col("_skipped")).alias(c) for c in ("_low", "_high")]
    return moved.select(*keys, F.col("_kept").alias("_n"), *ranks, "_part", "_from", "_to")


def _picked(left: DataFrame, ready: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The wanted values of groups whose bracket is one value or holds few rows."""
    one = ready.where("_from = _to").select(*keys, F.col("_from").cast("double").alias(name))
    few = ready.where("_from <> _to")
    sets = _with(left, few.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.sort_array(F.collect_list("_v")).alias("_sorted"))
    held = _with(few, sets, keys)
    low, high = (F.get("_sorted", F.col(c).cast("int")).cast("double") for c in ("_low", "_high"))
    return one.unionByName(held.select(*keys, (low + (high - low) * F.col("_part")).alias(name)))
