"""Structured analytics requests as DataFrame plans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.sqlrun import require_plain
from cadenza.schema import DATASET_ID, DIMENSION_COLUMN, DIMENSIONS, ROYALTY_COLUMNS, RequestError

# Metric names and the result column each makes.
METRICS = {
    "net_revenue": ("net_revenue", "total_revenue"),
    "quantity": ("quantity", "total_streams"),
}
DEFAULT_LIMIT = 100

COMPARE = {
    "eq": lambda col, value: col == value,
    "ne": lambda col, value: col != value,
    "gt": lambda col, value: col > value,
    "gte": lambda col, value: col >= value,
    "lt": lambda col, value: col < value,
    "lte": lambda col, value: col <= value,
}


def dimension(name: str) -> Column:
    """Column of an allowed dimension under the name the request used."""
    if name not in DIMENSIONS:
        raise RequestError(f"Dimension '{name}' is not allowed")
    return F.col(DIMENSION_COLUMN.get(name, name)).alias(name)


def metric(name: str) -> Column:
    if name not in METRICS:
        raise RequestError(f"Metric '{name}' is not supported")
    source, result = METRICS[name]
    return F.sum(source).alias(result)


def condition(field: str, operator: str, value: Any) -> Column:
    """One filter. Values become literals, so nothing in them needs escaping."""
    if field not in DIMENSIONS:
        raise RequestError(f"Filter field '{field}' is not allowed")
    column = F.col(DIMENSION_COLUMN.get(field, field))
    is_date = field == "reporting_date"

    def literal(v: Any) -> Column:
        return F.lit(v).cast("date") if is_date else F.lit(v)

    if operator in COMPARE:
        return COMPARE[operator](column, literal(value))
    if operator == "like":
        return column.cast("string").like(value)
    if operator == "in":
        values = [value] if isinstance(value, str) else list(value)
        return column.isin([literal(v) for v in values])
    raise RequestError(f"Filter operator '{operator}' is not supported")


def where_all(rows: DataFrame, conditions: Sequence[Column]) -> DataFrame:
    return rows.where(reduce(lambda a, b: a & b, conditions)) if conditions else rows


def structured_query(
    royalties: DataFrame,
    dimensions: Sequence[str] | None = None,
    metrics: Sequence[str] | None = None,
    date_range: Mapping[str, str | None] | None = None,
    filters: Sequence[Mapping[str, Any]] | None = None,
    dataset_ids: Sequence[str] | None = None,
    where: str | None = None,
    sort: Sequence[tuple[str, str]] | None = None,
    transform: Mapping[str, str] | None = None,
    limit: int | None = DEFAULT_LIMIT,
    offset: int = 0,
) -> DataFrame:
    """Plan of one request.

    Dimensions with metrics group; with an empty metric list they are distinct;
    without metrics they are projected and keep duplicates. Metrics alone give
    one row and nothing at all gives every column. `limit=None` means no limit.
    `where` is a SQL condition over the royalty columns. A limit without `sort` sorts by the dimensions, so the rows are defined.
    """
    dims = [dimension(d) for d in dimensions or []]
    aggregates = [metric(m) for m in metrics or []]
    conditions: list[Column] = []
    if dataset_ids:
        conditions.append(F.col(DATASET_ID).isin(list(dataset_ids)))
    span = date_range or {}
    if span.get("from"):
        conditions.append(F.col("reporting_date") >= F.lit(span["from"]).cast("date"))
    if span.get("to"):
        conditions.append(F.col("reporting_date") <= F.lit(span["to"]).cast("date"))
    conditions += [condition(f["field"], f["operator"], f["value"]) for f in filters or []]
    for text in [*([where] if where else []), *(transform or {}).values()]:
        require_plain(royalties.sparkSession, text)
    if where:
        conditions.append(F.expr(where))
    rows = where_all(royalties, conditions)

    extra = {name: F.expr(text) for name, text in (transform or {}).items()}
    if dims and metrics is not None:
        grouped = rows.groupBy(*dims)
        result = grouped.agg(*aggregates) if aggregates else rows.select(*dims).distinct()
        result = result.withColumns(extra) if extra else result
    elif aggregates:
        result = rows.agg(*aggregates)
        result = result.withColumns(extra) if extra else result
    else:
        rows = rows.withColumns(extra) if extra else rows
        kept = dims or [F.col(c) for c in rows.columns if c in ROYALTY_COLUMNS]
        result = rows.select(*kept, *extra)

    if sort is not None:
        result = result.orderBy(*[ordering(c, d) for c, d in sort])
    elif limit is not None or offset:
        result = result.orderBy(*[F.col(c).asc_nulls_last() for c in dimensions or result.columns])
    if offset:
        result = result.offset(offset)
    return result if limit is None else result.limit(limit)


def ordering(column: str, direction: str) -> Column:
    """Sort key; nulls come last ascending and first descending."""
    key = F.col(column)
    return key.desc_nulls_first() if direction.upper() == "DESC" else key.asc_nulls_last()
