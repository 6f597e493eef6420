"""Column expressions that clean report cells. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.schema import MONEY

EPOCH = "1970-01-01"


def text(col: Column) -> Column:
    """A null cell reads as the empty string."""
    return F.coalesce(col.cast("string"), F.lit(""))


def quantity_or_null(col: Column) -> Column:
    """Whole number of a cell, `12.0` included; null where it is not a number.

    The shape of the text picks the cast: a cast that fails costs far more than
    the test that avoids it.
    """
    whole = col.rlike(r"^\s*[+-]?\d+\s*$")
    number = col.rlike(r"^\s*[+-]?(\d+\.\d*|\.\d+|\d+(\.\d*)?[eE][+-]?\d+)\s*$")
    return F.when(whole, col.try_cast("bigint")).when(
        number, col.try_cast("double").try_cast("bigint")
    )


def quantity(col: Column) -> Column:
    """A cell that holds no number counts as one unit; `1,234` is not a number."""
    return F.coalesce(quantity_or_null(col), F.lit(1).cast("bigint"))


def report_date_or_null(col: Column) -> Column:
    """Date of a cell in any of six layouts, month first where both orders fit.

    The shape of the text picks the pattern, so a row pays for one parse instead
    of failing through all six.
    """
    s = F.trim(text(col))
    return (
        F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(s, "yyyy-M-d"))
        .when(s.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.try_to_date(s, "yyyy/M/d"))
        .when(
            s.rlike(r"^(0?[1-9]|1[0-2])/\d{1,2}/\d{4}$"),
            F.coalesce(F.try_to_date(s, "M/d/yyyy"), F.try_to_date(s, "d/M/yyyy")),
        )
        .when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(s, "d/M/yyyy"))
        .when(s.rlike(r"^\d{4}-\d{1,2}$"), F.try_to_date(s, "yyyy-M"))
        .when(s.rlike(r"^\d{1,2}/\d{4}$"), F.try_to_date(s, "M/yyyy"))
    )


def report_date(col: Column) -> Column:
    """As above; text that is no date reads as 1970-01-01."""
    return F.coalesce(report_date_or_null(col), F.lit(EPOCH).cast("date"))


def amount_or_null(col: Column) -> Column:
    """Decimal made of a cell's digits, points and minus signs, nine places, half up."""
    kept = F.regexp_replace(text(col), r"[^0-9.\-]", "")
    return F.when(kept != "", kept.try_cast(MONEY))


def amount(col: Column) -> Column:
    """As above; what is left of `junk` or an empty cell reads as zero."""
    return F.coalesce(amount_or_null(col), F.lit(0).cast(MONEY))


def amount_is_suspect(col: Column) -> Column:
    """True where dropping characters changed the value's meaning: `1e5`, `(12.34)`."""
    s = text(col)
    return s.rlike(r"[0-9.][eE][+-]?[0-9]") | s.rlike(r"\(.*[0-9].*\)")


def blank(col: Column) -> Column:
    return F.trim(text(col)) == ""


def trimmed_or_null(col: Column) -> Column:
    return F.nullif(F.trim(col), F.lit(""))
