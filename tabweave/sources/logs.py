"""Append-only event logs as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def append_events(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append records; every call adds files and rewrites none."""
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.json(path)


def read_events(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of a log with a declared schema: no inference pass over the data."""
    return spark.read.schema(schema).json(path)


def stream_events(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)
