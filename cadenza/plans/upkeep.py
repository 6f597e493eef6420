"""Queries over what is kept up to date: stored partials, sketches, clustered files, ranges of lists, corrected windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import partials, quantile
from cadenza.plans import fixtures as fx_data
from cadenza.plans.fixtures import DATASETS_CTE, ROYALTY_CTE, royalties, table
from cadenza.plans.registry import query
from cadenza.plans.royalty import CURSOR, SUMMARY_SQL
from cadenza.session import drop_at_exit, shared_path, staged
from cadenza.sources import clustered, pages
from cadenza.sources.files import clear_datasets
from cadenza.streaming import late


def _place(spark, name):
    path = shared_path(spark, name)
    drop_at_exit(spark, path)
    return path


@query("summary_incremental", SUMMARY_SQL)
def _(spark, sf):
    """All datasets stored, one of them wrong at first and one deleted again, merged at read."""
    rows = royalties(spark, sf, "dataset_id").select("dataset_id", *partials.NAMED, "net_revenue", "quantity")
    rows, path = staged(rows), _place(spark, "totals")  # three stores read them
    wrong = rows.withColumn("net_revenue", F.expr("CASE WHEN dataset_id = 'ds-1' THEN CAST(-7 AS DECIMAL(38,9)) ELSE net_revenue END"))
    partials.store(partials.totals(wrong), path)
    partials.store(partials.totals(rows.where("dataset_id = 'ds-1'")), path)
    partials.store(partials.totals(rows.where("dataset_id = 'ds-2'").withColumn("dataset_id", F.lit("gone"))), path)
    clear_datasets(spark, path, ["gone"])
    return partials.summary_of(spark.read.parquet(path))


@query(
    "sketch_summary",
    ROYALTY_CTE
    + """SELECT dataset_id IN ('ds-0', 'ds-3') AS chosen, count(*) AS rows, true AS tracks_close, true AS median_close, true AS high_close
    FROM royalty_data GROUP BY 1""",
)
def _(spark, sf):
    """Sketches of two choices of datasets against exact figures: true where the stated bounds hold."""
    rows, path = royalties(spark, sf, "dataset_id"), _place(spark, "sketches")
    partials.store(partials.sketches(rows), path)
    stored = spark.read.parquet(path)
    out = None
    for chosen in (True, False):
        own = F.col("dataset_id").isin("ds-0", "ds-3") == F.lit(chosen)
        guess = partials.estimates(stored.where(own), 0.5, 0.95).first()  # one row
        revenue = F.col("net_revenue").cast("double")
        known = F.abs(F.lit(guess["tracks"]) / F.countDistinct("isrc") - 1) <= partials.DISTINCT_ERROR
        near = [F.abs(F.avg((revenue <= at).cast("int")) - q) <= partials.RANK_ERROR for at, q in zip(guess["revenue_at"], (0.5, 0.95))]
        seen = rows.where(own).agg(known.alias("tracks_close"), near[0].alias("median_close"), near[1].alias("high_close"))
        part = seen.select(F.lit(chosen).alias("chosen"), F.lit(guess["rows"]).alias("rows"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "agg_median_exact",
    ROYALTY_CTE
    + """SELECT platform, median(CAST(net_revenue AS DOUBLE)) AS middle, quantile_cont(CAST(net_revenue AS DOUBLE), 0.99) AS high
    FROM royalty_data GROUP BY 1""",
)
def _(spark, sf):
    rows = royalties(spark, sf).select("platform", F.col("net_revenue").cast("double").alias("net_revenue"))
    return quantile.exact_percentiles(rows, ["platform"], "net_revenue", {"middle": 0.5, "high": 0.99})


@query(
    "page_stored",
    DATASETS_CTE
    + f"""SELECT * FROM datasets WHERE (created_at, id) < (SELECT (created_at, id) FROM datasets
    WHERE id = '{CURSOR}') ORDER BY created_at DESC, id DESC LIMIT 51""",
)
def _(spark, sf):
    path = _place(spark, "list")
    pages.store_list(fx_data.datasets(spark, sf), path, file_rows=2_000)
    return pages.stored_page(spark, path, cursor=CURSOR)


@query(
    "date_range_clustered",
    ROYALTY_CTE
    + """SELECT isrc, territory, reporting_date, net_revenue FROM royalty_data
    WHERE reporting_date BETWEEN DATE '1997-03-01' AND DATE '1997-05-31' AND territory >= 'M'""",
)
def _(spark, sf):
    path = _place(spark, "clustered")
    rows = royalties(spark, sf).select("isrc", "territory", "reporting_date", "net_revenue")
    clustered.write_clustered(rows, path, ["reporting_date", "isrc", "territory"], files=32)
    span = tuple(F.lit(day).cast("date") for day in ("1997-03-01", "1997-05-31"))
    return clustered.read_clustered(spark, path, {"reporting_date": span, "territory": ("M", None)})


@query(
    "ev_late_corrected",
    """SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS start, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS "end",
      count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total FROM events GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    """Events arrive in four micro-batches in no order of time, so many are late; corrections bring them in."""
    events = table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    source, path = _place(spark, "arriving"), _place(spark, "windows")
    events.repartition(4, F.crc32(F.col("event_id").cast("string"))).write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    running = late.keep_events(stream, path, f"{path}/checkpoint", "6 hours", "1 day")
    running.awaitTermination()
    return late.corrected(spark, path, "event_type", "6 hours")
