"""Lookup sides of joins: made once, and broadcast only if they measure small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.session import staged

BROADCAST_BYTES = 64 * 1024 * 1024


def lookup(frame: DataFrame, row_bytes: Column | int) -> DataFrame:
    """A lookup table derived by its own job, with its size known to the join.

    The planner can only guess the size of what aggregates and joins produce,
    so the table is staged and measured: `row_bytes` is what a row holds besides
    its top-level texts, whose bytes are added up. To the bound it is broadcast
    and the big side is not shuffled; beyond it the join shuffles and the
    adaptive planner splits hot keys.
    """
    made = staged(frame)
    weight = F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes
    for name, kind in made.dtypes:
        if kind == "string":
            weight = weight + F.coalesce(F.octet_length(name), F.lit(0))
    size = made.agg(F.sum(weight).alias("bytes")).first()["bytes"] or 0
    return F.broadcast(made) if size <= BROADCAST_BYTES else made
