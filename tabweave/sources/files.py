"""File listings: block hints and content hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import _col, block_hint_path


def file_manifest(files: DataFrame, path: str = "path", extension: str = ".xlsx") -> DataFrame:
    """Files of one extension with their block and whether they are general."""
    hinted = files.where(F.lower(path).endswith(extension) & ~F.col(path).endswith("/"))
    return hinted.withColumn("block_id", block_hint_path(path)).withColumn("is_general", F.col("block_id").isNull())


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, length, modificationTime and content of every file below a folder."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    )


def content_hash(df: DataFrame, content="content") -> DataFrame:
    return df.withColumn("sha256", F.sha2(_col(content).cast("binary"), 256)).drop(content if isinstance(content, str) else "")
