"""Scopes and existence filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.choices import expand_ranges

ELIGIBLE_TYPES = ("chart", "table")


def select_blocks(df: DataFrame, selection: str | list[int] | None, block: str = "block_id") -> DataFrame:
    """Rows of the selected blocks; an empty selection keeps everything.  The
    selection is a literal, so the filter reaches the scan."""
    if isinstance(selection, str):
        chosen = df.sparkSession.range(1).select(expand_ranges(F.lit(selection)).alias("b")).first()["b"]
        if chosen is None:
            raise ValueError("use a selection such as 3, 5, 8-10")
    else:
        chosen = sorted({int(b) for b in selection or [] if int(b) > 0})
    return df.where(F.col(block).isin(chosen)) if chosen else df


def eligible(targets: DataFrame) -> DataFrame:
    return targets.where(F.col("object_type").isin(*ELIGIBLE_TYPES))


def keep_allowed(df: DataFrame, allowed: DataFrame, key: str = "target_id") -> DataFrame:
    return df.join(allowed.select(key).distinct(), key, "left_semi")


def readable_tables(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """Tables with at least one non-blank cell."""
    filled = cells.where(F.col("num").isNotNull() | (F.trim(F.coalesce(F.col("raw"), F.lit(""))) != ""))
    return tables.join(filled.select("table_id").distinct(), "table_id", "left_semi")


def valid_suggestions(suggestions: DataFrame, targets: DataFrame, tables: DataFrame, floor: float = 0.55) -> DataFrame:
    """Suggestions at or above the floor that name a known contract and table."""
    return (
        suggestions.where(F.col("confidence") >= floor)
        .join(targets.select("target_id").distinct(), "target_id", "left_semi")
        .join(tables.select("table_id").distinct(), "table_id", "left_semi")
    )


def scope_to_tenant(df: DataFrame, users: DataFrame, email: str, tenant: str = "tenant") -> DataFrame:
    """Rows the user may see: their tenant's, or all for an administrator.
    Unknown, inactive or tenantless users see nothing, and so does an e-mail that is
    active under several tenants or roles: it doesn't say which of them it is."""
    user = users.where((F.lower("email") == email.strip().lower()) & F.col("active")).select(
        F.col("tenant").alias("_tenant"), F.coalesce(F.col("role") == "admin", F.lit(False)).alias("_admin")
    ).distinct()
    user = user.groupBy().agg(F.count("*").alias("_n"), F.first("_tenant").alias("_tenant"), F.first("_admin").alias("_admin")).where("_n = 1").drop("_n")
    known = df.where(F.col(tenant).isNotNull())
    allowed = known.join(F.broadcast(user), F.col("_admin") | (F.col(tenant) == F.col("_tenant")), "left_semi")
    return allowed


def out_of_scope(requested: DataFrame, inventory: DataFrame, block: str = "block_id") -> DataFrame:
    """Requested blocks past the last existing one."""
    last = inventory.agg(F.max(block).alias("_last"))
    return requested.join(F.broadcast(last), F.col(block) > F.col("_last"), "left_semi")


def expired(artifacts: DataFrame, now, days: int, kind: str = "run") -> DataFrame:
    """Artifacts of one kind older than the retention period; others never expire."""
    limit = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return artifacts.where((F.col("kind") == kind) & (F.col("ts") < limit))
