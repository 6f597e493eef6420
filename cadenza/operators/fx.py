"""Currency conversion with exact-day and as-of rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions.music import apply_fx
from cadenza.operators.joins import lookup
from cadenza.schema import DEFAULT_CURRENCY

KEY = ["currency", "reporting_date"]


def needed_days(royalties: DataFrame) -> DataFrame:
    """Days and currencies the royalties need: at most currencies times days."""
    return royalties.select(*KEY).distinct()


def daily_rates(rates: DataFrame) -> DataFrame:
    """currency, date and rate, one row a day: of several rates of a day the greatest counts."""
    known = rates.where("rate_to_usd is not null").groupBy(F.col("currency_code").alias("currency"), "date")
    return known.agg(F.max("rate_to_usd").alias("rate"))


def repeated_rates(rates: DataFrame) -> DataFrame:
    """Days and currencies with more than one rate, how many, and the least and greatest of them."""
    known = rates.where("rate_to_usd is not null").groupBy("currency_code", "date")
    least, most = F.min("rate_to_usd").alias("least_rate"), F.max("rate_to_usd").alias("greatest_rate")
    return known.agg(F.count("*").alias("rates"), least, most).where("rates > 1")


def rate_calendar(rates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rate of every day between a currency's first and last rate, and its last one with its day.

    Works on the rates alone, so the royalties are read once.
    """
    known = daily_rates(rates)
    until = F.lead("date").over(W.partitionBy("currency").orderBy("date"))
    spans = known.withColumn("until", until)
    days = F.explode(F.sequence("date", F.date_sub("until", 1))).alias("reporting_date")
    calendar = spans.where("until is not null").select("currency", days, "rate")
    return calendar, spans.where("until is null").select("currency", F.col("date").alias("since"), F.col("rate").alias("newest"))


def _with_rate(royalties: DataFrame, daily: DataFrame) -> DataFrame:
    """Royalties with their day's rate and USD amount, by a plain equi-join."""
    return _rated(royalties.join(daily.select(*KEY, "rate"), KEY, "left"))


def _rated(joined: DataFrame) -> DataFrame:
    """Rows with a `rate` (null where none is known) and their USD amount."""
    usd = apply_fx(F.col("net_revenue"), F.col("currency"), F.col("rate"))
    rate = F.when(F.col("currency") == DEFAULT_CURRENCY, F.coalesce("rate", F.lit(1))).otherwise(
        F.col("rate")
    )
    return joined.withColumns({"net_revenue_usd": usd, "rate": rate.cast("decimal(10,6)")})


def convert_exact(royalties: DataFrame, rates: DataFrame) -> DataFrame:
    """USD amounts by the rate of the very day; null where that day has none."""
    daily = daily_rates(rates).withColumnRenamed("date", "reporting_date")
    return _with_rate(royalties, lookup(daily, row_bytes=64))


def convert_as_of(royalties: DataFrame, rates: DataFrame) -> DataFrame:
    """USD amounts by the latest rate on or before the day."""
    calendar, last = rate_calendar(rates)
    rows = royalties.join(lookup(calendar, row_bytes=64), KEY, "left").join(lookup(last, row_bytes=64), "currency", "left")
    later = F.when(F.col("reporting_date") >= F.col("since"), F.col("newest"))
    rows = rows.withColumn("rate", F.coalesce("rate", later)).drop("since", "newest")
    return _rated(rows)


def missing_rates(royalties: DataFrame, rates: DataFrame) -> DataFrame:
    """Days and currencies that have royalties but no rate of that day."""
    wanted = needed_days(royalties).where(F.col("currency") != DEFAULT_CURRENCY)
    return wanted.join(
        rates.select(F.col("currency_code").alias("currency"), F.col("date").alias("reporting_date")),
        KEY,
        "left_anti",
    )
