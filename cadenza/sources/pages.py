"""Long lists stored so that a page opens a few files, however long the list.

Rows lie in files by ranges of (creation time, id), with a table of the ranges.
A second table, by hash of the id, gives a cursor's creation time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators.paging import page_size
from cadenza.session import parallelism
from cadenza.sources.splitcsv import file_path

#: Rows of a file, and ids of a file of the second table, about.
FILE_ROWS = 100_000


def store_list(rows: DataFrame, path: str, created: str = "created_at", key: str = "id", file_rows: int = FILE_ROWS) -> None:
    """Write a list, its ranges and its ids below `path`, in place of what was there."""
    spark = rows.sparkSession
    n = rows.count()
    parts = max(1, -(-n // file_rows))
    dealt = rows.repartitionByRange(parts, created, key).sortWithinPartitions(created, key)
    dealt.write.mode("overwrite").parquet(f"{path}/rows")
    written = spark.read.schema(rows.schema).parquet(f"{path}/rows").select("*", file_path().alias("file"))
    place = F.struct(F.col(created).alias("created"), F.col(key).alias("key"))
    ranges = written.groupBy("file").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("rows"))
    ranges = ranges.withColumn("buckets", F.lit(parts))
    ranges.coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")  # one row per file
    ids = rows.select(F.col(key).alias("key"), F.col(created).alias("created"), _bucket(F.col(key), parts).alias("bucket"))
    ids.repartition(min(parts, 8 * parallelism(spark)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/ids")


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def stored_page(
    spark: SparkSession, path: str, cursor: str | None = None, limit: int | None = None, newest_first: bool = True,
    created: str = "created_at", key: str = "id",
) -> DataFrame:
    """The page after the row whose id is `cursor`, plus one row if more follow, as `paging.page` gives it.

    Opened are one file of ids, the table of ranges, and as many files of rows
    as hold a page. An unknown cursor gives an empty page.
    """
    ranges = spark.read.parquet(f"{path}/ranges")
    every = spark.read.parquet(f"{path}/rows")
    place, at = F.struct(F.col(created).alias("created"), F.col(key).alias("key")), None
    if cursor is not None:
        found = _cursor_row(spark, path, cursor, ranges)
        if found is None:
            return every.limit(0)
        at = F.struct(F.lit(found["created"]).alias("created"), F.lit(found["key"]).alias("key"))
        ranges = ranges.where(F.col("first") <= at if newest_first else F.col("last") >= at)
    files, sure, size = [], 0, page_size(limit) + 1
    # Ranges hold at least one row each, so one more of them than rows asked for is enough.
    near = ranges.orderBy(F.desc("last") if newest_first else F.asc("first")).limit(size + 1).collect()
    for one in near:
        files.append(one["file"])
        # Rows of the range that holds the cursor may all lie on its other side.
        sure += one["rows"] if at is None or len(files) > 1 else 0
        if sure >= size:
            break
    if not files:
        return every.limit(0)
    rows = spark.read.schema(every.schema).parquet(*files)
    if at is not None:
        rows = rows.where(place < at if newest_first else place > at)
    order = [F.desc(created), F.desc(key)] if newest_first else [F.asc(created), F.asc(key)]
    return rows.orderBy(*order).limit(size)


def _cursor_row(spark: SparkSession, path: str, cursor: str, ranges: DataFrame):
    first = ranges.select("buckets").first()
    if first is None:
        return None
    own = spark.range(1).select(_bucket(F.lit(cursor), first["buckets"]).alias("b")).first()["b"]
    return spark.read.parquet(f"{path}/ids").where((F.col("bucket") == own) & (F.col("key") == cursor)).first()
