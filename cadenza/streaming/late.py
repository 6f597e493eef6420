"""Windows over a stream whose late rows are kept, counted and put right afterwards.

Spark's windowed aggregates drop rows behind the watermark without a trace. Here
a micro-batch stores its rows first: those in time, and those too late for their
window, with the watermark they missed. A correction redoes only the windows that
late rows fall into.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

TS = "ts"
MARKS = "batch long, seen timestamp_ntz"


def _stored(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def watermark(spark: SparkSession, path: str, batch: int, delay: str):
    """The watermark a micro-batch meets: the latest time of all batches before it, less the delay; None at first."""
    marks = _stored(spark, f"{path}/marks", MARKS)
    if marks is None:
        return None
    return marks.where(F.col("batch") < batch).agg(F.max("seen").alias("seen")).select(F.col("seen") - F.expr(f"INTERVAL {delay}")).first()[0]


def keep_events(stream: DataFrame, path: str, checkpoint: str, length: str, delay: str) -> StreamingQuery:
    """Store a stream's events below `path` until its input is used up, late ones apart.

    A row is late if its window of the given length had ended by the watermark.
    What a micro-batch stores replaces what an earlier try of it has stored.
    """

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        mark = watermark(spark, path, number, delay)
        rows = batch.withColumn(TS, F.col(TS).cast("timestamp_ntz"))
        end = F.window(TS, length)["end"]
        rows = rows.withColumn("watermark", F.lit(mark).cast("timestamp_ntz"))
        late = F.coalesce(F.col("watermark") >= end, F.lit(False))
        marked = rows.withColumn("late", late)
        marked.write.mode("overwrite").partitionBy("late").parquet(f"{path}/events/batch={number}")
        seen = rows.agg(F.max(TS).alias("seen")).select(F.lit(number).cast("long").alias("batch"), "seen")
        seen.write.mode("overwrite").parquet(f"{path}/marks/of={number}")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def events(spark: SparkSession, path: str, late: bool | None = None) -> DataFrame:
    """Stored events, with their batch, the watermark they met and whether they were late."""
    rows = spark.read.option("basePath", f"{path}/events").parquet(f"{path}/events")
    return rows if late is None else rows.where(F.col("late") == late)


def late_counts(spark: SparkSession, path: str) -> DataFrame:
    """How many rows each micro-batch had, how many of them late, and behind which watermark."""
    return events(spark, path).groupBy("batch", "watermark").agg(F.count("*").alias("rows"), F.count_if("late").alias("late_rows"))


def _windows(rows: DataFrame, key: str, length: str) -> DataFrame:
    grouped = rows.groupBy(key, F.window(TS, length).alias("w"))
    totals = grouped.agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
    return totals.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def windows_in_time(spark: SparkSession, path: str, key: str, length: str) -> DataFrame:
    """Windows as the stream alone gives them: late rows have no part."""
    return _windows(events(spark, path, late=False), key, length)


def corrections(spark: SparkSession, path: str, key: str, length: str) -> DataFrame:
    """The windows that late rows fall into, as they are with them; no other window is worked out.

    Late rows are few: the windows they touch are found first, and only events
    of those windows are read into the aggregate.
    """
    own = F.struct(F.col(key), F.window(TS, length)["start"].alias("start")).alias("own")
    touched = events(spark, path, late=True).select(own).distinct()
    rows = events(spark, path).withColumn("own", own).join(touched, "own", "left_semi").drop("own")
    return _windows(rows, key, length)


def corrected(spark: SparkSession, path: str, key: str, length: str) -> DataFrame:
    """All windows: those of the stream, with the corrected ones in place of what late rows have changed."""
    right = corrections(spark, path, key, length)
    place = [key, "start"]
    stale = right.select(*[F.col(c).alias(f"_{c}") for c in place])
    same = F.col(key).eqNullSafe(F.col(f"_{key}")) & (F.col("start") == F.col("_start"))
    return windows_in_time(spark, path, key, length).join(stale, same, "left_anti").unionByName(right)
