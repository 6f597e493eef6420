"""Domain functions as Column expressions, usable in any select."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.schema import AMOUNT, DEFAULT_CURRENCY, MONEY, RATE


def normalize_platform(col: Column) -> Column:
    """One spelling per platform: trimmed, single spaces, each word capitalised."""
    return F.initcap(F.regexp_replace(F.trim(col), r"[\s_\-]+", " "))


def apply_fx(amount: Column, currency: Column, rate: Column) -> Column:
    """Amount in USD, nine places. USD needs no rate; an absent rate gives null."""
    known = F.when(currency == DEFAULT_CURRENCY, F.coalesce(rate, F.lit(1))).otherwise(rate)
    return F.round(amount.cast(AMOUNT) * known.cast(RATE), 9).cast(MONEY)


def natural_id(*parts: Column) -> Column:
    """Id of a catalog row: a hash of its natural key, so that reruns agree."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p, F.lit("")) for p in parts]), 256)
