"""Rows laid out so that filters on several columns each read few files.

Every column's values are put into 64 ranges, and the bits of a row's range
numbers are interleaved to one number (a Z-order curve). Files are ranges of that
number, so each file is narrow in every column. A table with the least and
greatest value per file tells which files a filter needs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.session import staged
from cadenza.sources.splitcsv import file_path

BITS = 6  # of a column's range number
#: Rows that are looked at to cut a column's values into ranges; decides the layout, never a result.
SAMPLE = 20_000
#: Rows of a file at most, in the mean; a task sorts one file's rows.
FILE_ROWS = 1_000_000


def split_points(rows: DataFrame, columns: Sequence[str]) -> dict[str, list]:
    """Up to 63 values per column that cut a bounded sample of its values into equal parts."""
    n = rows.count()
    some = rows.select(*columns).sample(min(1.0, SAMPLE / max(n, 1)), seed=7).collect()
    points = {}
    for column in columns:
        values = sorted(r[column] for r in some if r[column] is not None)
        cuts = [values[k * len(values) >> BITS] for k in range(1, 1 << BITS)] if values else []
        points[column] = sorted(set(cuts))
    return points


def curve(points: Mapping[str, list]) -> Column:
    """A row's number on the curve: bit k of every column's range number, the highest bits first; nulls are lowest."""
    numbers = []
    for column, cuts in points.items():
        ranges = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array()
        numbers.append(F.coalesce(F.size(F.filter(ranges, _up_to(column))), F.lit(0)))
    out = F.lit(0).cast("long")
    for bit in reversed(range(BITS)):
        for number in numbers:
            out = F.shiftleft(out, 1).bitwiseOR(F.shiftright(number, bit).bitwiseAND(F.lit(1)).cast("long"))
    return out


def _up_to(column: str):
    return lambda cut: cut <= F.col(column)


def write_clustered(rows: DataFrame, path: str, columns: Sequence[str], files: int) -> None:
    """Write rows as about `files` files, or more where these would be large, along the curve over `columns`, with their table of bounds, in place of what was there.

    Rows that agree in all ranges are dealt over files by a salt, so no value,
    however common, makes one file large.
    """
    spark = rows.sparkSession
    rows = staged(rows)  # they are counted, sampled twice and written
    files = max(files, -(-rows.count() // FILE_ROWS))
    number = curve(split_points(rows, columns))
    placed = rows.withColumns({"__curve": number, "__salt": F.monotonically_increasing_id()})
    dealt = placed.repartitionByRange(files, "__curve", "__salt").sortWithinPartitions(*columns).drop("__curve", "__salt")
    dealt.write.mode("overwrite").parquet(f"{path}/rows")
    written = spark.read.schema(rows.schema).parquet(f"{path}/rows").groupBy(file_path().alias("file"))
    sides = [side(c).alias(f"{word}_{c}") for c in columns for side, word in ((F.min, "least"), (F.max, "most"))]
    missing = [F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in columns]
    written.agg(*sides, *missing).coalesce(1).write.mode("overwrite").parquet(f"{path}/bounds")  # one row per file


def read_clustered(spark: SparkSession, path: str, between: Mapping[str, tuple]) -> DataFrame:
    """Rows whose columns lie within the given bounds (both included; None leaves a side open), from the files that can hold any.

    `between` may name any of the clustered columns. Null values lie within no bounds.
    """
    bounds, wanted = spark.read.parquet(f"{path}/bounds"), F.lit(True)
    may = F.lit(True)
    for column, (low, high) in between.items():
        may &= F.col(f"least_{column}").isNotNull()
        wanted &= F.col(column).isNotNull()
        if low is not None:
            may, wanted = may & (F.col(f"most_{column}") >= F.lit(low)), wanted & (F.col(column) >= F.lit(low))
        if high is not None:
            may, wanted = may & (F.col(f"least_{column}") <= F.lit(high)), wanted & (F.col(column) <= F.lit(high))
    files = [r["file"] for r in bounds.where(may).select("file").collect()]  # the names of the files to read
    rows = spark.read.parquet(f"{path}/rows")
    return spark.read.schema(rows.schema).parquet(*files).where(wanted) if files else rows.limit(0)
