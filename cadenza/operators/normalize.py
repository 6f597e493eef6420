"""Distributor reports to the royalty table: one select per layout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import cleaning as clean
from cadenza.operators.layouts import LAYOUTS, Layout, resolve
from cadenza.schema import DATASET_ID, DEFAULT_CURRENCY, ROYALTY_COLUMNS, UNKNOWN_ARTIST


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _fields(raw: DataFrame, layout: Layout) -> dict[str, Column | None]:
    carried = {DATASET_ID}
    columns = [c for c in raw.columns if c not in carried]
    return {
        field: None if column is None else _quoted(column)
        for field, column in resolve(columns, layout).items()
    }


def normalize(raw: DataFrame, source: str | Layout) -> DataFrame:
    """Royalty rows of one layout's raw report rows (every column a string).

    A `dataset_id` column rides along when the raw rows carry one.
    """
    layout = source if isinstance(source, Layout) else LAYOUTS[source]
    at = _fields(raw, layout)

    def optional(field: str, default: str) -> Column:
        return F.lit(default) if at.get(field) is None else clean.text(at[field])

    if layout.always_usd:
        currency = F.lit(DEFAULT_CURRENCY)
    else:
        currency = optional("currency", DEFAULT_CURRENCY)
    quantity = F.lit(1).cast("bigint") if at["quantity"] is None else clean.quantity(at["quantity"])
    made = {
        "isrc": clean.text(at["isrc"]),
        "upc": optional("upc", ""),
        "title": clean.text(at["title"]),
        "artist": optional("artist", UNKNOWN_ARTIST),
        "album": optional("album", ""),
        "platform": clean.text(at["platform"]),
        "territory": optional("territory", ""),
        "transaction_type": optional("transaction_type", ""),
        "reporting_date": clean.report_date(at["reporting_date"]),
        "net_revenue": clean.amount(at["net_revenue"]),
        "currency": currency,
        "quantity": quantity,
    }
    carried = [F.col(DATASET_ID)] if DATASET_ID in raw.columns else []
    return raw.select(*[made[name].alias(name) for name in ROYALTY_COLUMNS], *carried)


def rejects(raw: DataFrame, source: str | Layout) -> DataFrame:
    """One row per cell that normalizing replaced or may have misread.

    Columns: the dataset (if any), field, reason and the cell as it stood.
    """
    layout = source if isinstance(source, Layout) else LAYOUTS[source]
    at = _fields(raw, layout)

    def note(field: str, reason: str, when: Column) -> Column:
        return F.when(
            when,
            F.struct(
                F.lit(field).alias("field"),
                F.lit(reason).alias("reason"),
                clean.text(at[field]).alias("cell"),
            ),
        )

    date, money = at["reporting_date"], at["net_revenue"]
    notes = [
        note("reporting_date", "no date", clean.report_date_or_null(date).isNull()),
        note("net_revenue", "no amount", clean.amount_or_null(money).isNull()),
        note("net_revenue", "amount misread", clean.amount_is_suspect(money)),
    ]
    if at["quantity"] is not None:
        missing = clean.quantity_or_null(at["quantity"]).isNull()
        notes.append(note("quantity", "no quantity", missing))
    carried = [F.col(DATASET_ID)] if DATASET_ID in raw.columns else []
    return (
        raw.select(*carried, F.explode(F.array_compact(F.array(*notes))).alias("reject"))
        .select(*carried, "reject.*")
    )


def union_reports(parts: list[DataFrame]) -> DataFrame:
    """Every report in one table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def dataset_row_counts(rows: DataFrame) -> DataFrame:
    """Rows per dataset; counts combine map-side, so a huge dataset is no hot key."""
    return rows.groupBy(DATASET_ID).agg(F.count("*").alias("row_count"))
