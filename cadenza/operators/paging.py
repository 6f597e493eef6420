"""Keyset pages over a list ordered by creation time and id."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Page size when none is asked for, and its bounds.
DEFAULT_PAGE = 50
MIN_PAGE, MAX_PAGE = 1, 100


def page_size(limit: int | None) -> int:
    return min(max(DEFAULT_PAGE if limit is None else limit, MIN_PAGE), MAX_PAGE)


def _keyed(rows: DataFrame, created: str, key: str):
    return F.struct(F.col(created), F.col(key))


def page(
    rows: DataFrame,
    cursor: str | None = None,
    limit: int | None = None,
    newest_first: bool = True,
    created: str = "created_at",
    key: str = "id",
    well_formed: str | None = None,
) -> DataFrame:
    """The page after the row whose id is `cursor`, plus one row if more follow.

    The cursor row is found by a scalar subquery, and the page is a top-k, so
    only page-sized data leaves a task. An unknown cursor gives an empty page; a
    malformed one (`well_formed` is a pattern of ids) gives the first page.
    """
    if cursor is not None and well_formed is not None and not re.fullmatch(well_formed, cursor):
        cursor = None
    position = _keyed(rows, created, key)
    if cursor is not None:
        at = rows.where(F.col(key) == cursor).select(position.alias("at")).scalar()
        rows = rows.where(position < at if newest_first else position > at)
    order = [F.desc(created), F.desc(key)] if newest_first else [F.asc(created), F.asc(key)]
    return rows.orderBy(*order).limit(page_size(limit) + 1)


def page_rows(fetched: DataFrame, limit: int | None, newest_first: bool = True,
              created: str = "created_at", key: str = "id") -> DataFrame:
    """The rows to show of a fetched page: the one that only tells of more is cut."""
    order = [F.desc(created), F.desc(key)] if newest_first else [F.asc(created), F.asc(key)]
    return fetched.orderBy(*order).limit(page_size(limit))


def page_meta(fetched: DataFrame, limit: int | None, newest_first: bool = True,
              created: str = "created_at", key: str = "id") -> DataFrame:
    """One row: whether more rows follow, the cursor to ask for them, the size."""
    size = page_size(limit)
    shown = page_rows(fetched, limit, newest_first, created, key)
    position = _keyed(shown, created, key)
    last = F.min_by(F.col(key), position) if newest_first else F.max_by(F.col(key), position)
    more = fetched.agg((F.count("*") > size).alias("more")).scalar()
    return shown.agg(last.alias("last")).select(
        F.when(more, F.col("last")).alias("next_cursor"),
        more.alias("has_more"),
        F.lit(size).cast("bigint").alias("page_limit"),
    )
