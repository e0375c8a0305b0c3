"""Sinks: run reports, versioned publishing and delivery matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_MATRIX_COLUMNS = 10_000


def write_run_report(plans: DataFrame, path: str, run_id: str) -> None:
    """One partition per run; re-running a run replaces only its own partition."""
    (
        plans.withColumn("run_id", F.lit(run_id)).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
    )


def publish_version(data: DataFrame, root: str, name: str, version_id: str, created_at) -> None:
    """Data first, pointer last: readers see a version only when its manifest row
    exists, so a job lost half-way leaves the earlier version current."""
    spark = data.sparkSession
    data.write.mode("overwrite").parquet(f"{root}/{name}/version={version_id}")
    row = spark.range(1).select(
        F.lit(name).alias("name"), F.lit(version_id).alias("version_id"), F.lit(created_at).cast("timestamp").alias("created_at")
    )
    row.write.mode("append").parquet(f"{root}/_manifest")


def current_version(spark: SparkSession, root: str, name: str) -> str | None:
    newest = (
        spark.read.parquet(f"{root}/_manifest").where(F.col("name") == name)
        .agg(F.max_by("version_id", F.struct("created_at", "version_id")).alias("v")).first()
    )
    return newest["v"] if newest else None


def read_current(spark: SparkSession, root: str, name: str) -> DataFrame:
    version = current_version(spark, root, name)
    if version is None:
        raise FileNotFoundError(f"{name} has no published version")
    return spark.read.parquet(f"{root}/{name}/version={version}")


def delivery_matrix(cells: DataFrame, keys: list[str], column: str, value: str, labels: list | None = None) -> DataFrame:
    """Long cells to one row per key with a column per label, in label order.
    Without ``labels`` they are looked up; a width beyond the limit is refused."""
    if labels is None:
        found = cells.select(column).distinct().orderBy(column).limit(MAX_MATRIX_COLUMNS + 1).collect()
        labels = [r[0] for r in found]
        if len(labels) > MAX_MATRIX_COLUMNS:
            raise ValueError(f"more than {MAX_MATRIX_COLUMNS} columns")
    return cells.groupBy(*keys).pivot(column, labels).agg(F.max(value))
