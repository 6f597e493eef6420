"""Query history and the dataset ledger: append-only logs, latest entry wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.sqlrun import Tables, run_sql
from cadenza.schema import RequestError


def query_id(sql: Column) -> Column:
    """`q_` and 16 hex digits of a 64-bit hash, so equal text shares an id."""
    return F.concat(F.lit("q_"), F.substring(F.md5(sql), 1, 16))


def history_records(runs: DataFrame) -> DataFrame:
    """History rows of executed queries, ready to append."""
    return runs.select(
        "workspace_id",
        "user_id",
        query_id(F.col("sql_executed")).alias("query_id"),
        "sql_executed",
        "row_count",
        "execution_time_ms",
        "created_at",
    )


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest log row per key.

    An aggregate, not a window: each task keeps one row per key, so a key that
    holds most of the log is reduced before the shuffle. Columns outside `order`
    break its ties, so the row is the same on every run.
    """
    rest = order + [c for c in log.columns if c not in keys + order]
    newest = F.max(F.struct(*rest)).alias("newest")
    return log.groupBy(*keys).agg(newest).select(*keys, "newest.*")


def latest_by_query_id(history: DataFrame) -> DataFrame:
    return latest(
        history, ["workspace_id", "query_id"], ["created_at", "execution_time_ms", "user_id"]
    )


def rerun(history: DataFrame, workspace_id: str, query_id: str, tables: Tables) -> DataFrame:
    """Run the newest recorded SQL of a query id again."""
    own = history.where(
        (F.col("workspace_id") == workspace_id) & (F.col("query_id") == query_id)
    )
    found = latest_by_query_id(own).select("sql_executed").first()
    if found is None:
        raise RequestError(f"Query '{query_id}' is not in the history")
    return run_sql(history.sparkSession, found["sql_executed"], tables)


def dataset_status(log: DataFrame) -> DataFrame:
    """Current state of every dataset from its status log."""
    return latest(log, ["dataset_id"], ["updated_at", "seq"])
