"""Who may see what, and how much each workspace stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Roles from weakest to strongest.
ROLES = ("Viewer", "Manager", "Admin", "Owner")


def role_rank(role: Column) -> Column:
    """Place of a role in the order above; an unknown role counts as the weakest."""
    rank = F.lit(0)
    for place, name in enumerate(ROLES):
        rank = F.when(F.lower(F.trim(role)) == name.lower(), place).otherwise(rank)
    return rank


def _is_role(role: Column) -> Column:
    return F.coalesce(F.lower(F.trim(role)).isin([name.lower() for name in ROLES]), F.lit(False))


def effective_role(requests: DataFrame, workspaces: DataFrame, members: DataFrame) -> DataFrame:
    """Answer each (workspace_id, user_id, required_role) request.

    The owner has every right; a member has the stored role. `outcome` is
    `granted`, `forbidden`, `not a member` or `no workspace`; asking for a role
    that does not exist is forbidden.
    """
    known = (
        requests.join(
            workspaces.select("workspace_id", F.col("owner_user_id").alias("owner")),
            "workspace_id",
            "left",
        )
        .join(
            members.select("workspace_id", "user_id", F.col("role").alias("member_role")),
            ["workspace_id", "user_id"],
            "left",
        )
    )
    owns = F.col("owner") == F.col("user_id")
    held = F.when(F.coalesce(owns, F.lit(False)), "Owner").when(
        F.col("member_role").isNotNull(), F.element_at(
            F.array(*[F.lit(r) for r in ROLES]), role_rank(F.col("member_role")) + 1
        )
    )
    outcome = (
        F.when(F.col("owner").isNull(), "no workspace")
        .when(F.col("role").isNull(), "not a member")
        .when(_is_role(F.col("required_role")) & (role_rank(F.col("role")) >= role_rank(F.col("required_role"))), "granted")
        .otherwise("forbidden")
    )
    return known.withColumn("role", F.when(F.col("owner").isNotNull(), held)).select(
        "workspace_id", "user_id", "required_role", "role", outcome.alias("outcome")
    )


def visible_to(rows: DataFrame, entitlements: DataFrame, user_id: str) -> DataFrame:
    """Rows of the workspaces a user may read."""
    allowed = entitlements.where(F.col("user_id") == user_id).select("workspace_id")
    return rows.join(allowed, "workspace_id", "left_semi")


def workspace_storage(datasets: DataFrame) -> DataFrame:
    """Bytes stored and datasets held per workspace."""
    return datasets.groupBy("workspace_id").agg(
        F.sum("file_size_bytes").alias("storage_used_bytes"), F.count("*").alias("datasets")
    )
