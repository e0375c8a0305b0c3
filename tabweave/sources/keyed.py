"""A table with one row per key that grows by versions, of which each rewrites only the buckets it touches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class KeyedTable:
    """Rows in hash buckets of their key.

    ``root/data/version=v/bucket=b`` holds the rows of a bucket as version v wrote them; ``root/manifest/version=v`` names, for every bucket, the version that
    holds it.  The manifest is written last, so a job lost half-way leaves the earlier version current, and a new process finds the current version
    from the store alone.  Writes grow with the buckets that a batch touches: choose ``buckets`` well above the keys of a usual batch."""

    root: str
    key: str
    schema: str
    buckets: int = 256

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _manifest(self, spark: SparkSession) -> DataFrame | None:
        try:
            return spark.read.schema("bucket int, held long, version long").parquet(f"{self.root}/manifest")
        except AnalysisException:
            return None

    def version(self, spark: SparkSession) -> int | None:
        """The newest complete version, None before the first."""
        known = self._manifest(spark)
        return None if known is None else known.agg(F.max("version")).first()[0]

    def _held(self, spark: SparkSession, version: int | None) -> dict[int, int]:
        """Bucket to the version that holds it: at most one entry per bucket."""
        if version is None:
            return {}
        return {r["bucket"]: r["held"] for r in self._manifest(spark).where(F.col("version") == version).collect() if r["bucket"] >= 0}

    def _rows(self, spark: SparkSession, held: dict[int, int]) -> DataFrame:
        if not held:
            return spark.createDataFrame([], self.schema)
        paths = [f"{self.root}/data/version={v}/bucket={b}" for b, v in sorted(held.items())]
        return spark.read.schema(self.schema).parquet(*paths)

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """Rows of a version, the newest one by default; no rows before the first."""
        return self._rows(spark, self._held(spark, self.version(spark) if version is None else version))

    def upsert(self, rows: DataFrame, version: int) -> int:
        """Put ``rows`` (one per key) in place of those of the same keys, as ``version``; the number of buckets rewritten.  A version that is
        complete already is left alone, so a replayed batch changes nothing."""
        spark = rows.sparkSession
        newest = self.version(spark)
        if newest is not None and version <= newest:
            return 0
        held = self._held(spark, newest)
        new = rows.select(*self._rows(spark, {}).columns).withColumn("bucket", self._bucket())
        touched = {r["bucket"] for r in new.select("bucket").distinct().collect()}
        old = self._rows(spark, {b: v for b, v in held.items() if b in touched}).withColumn("bucket", self._bucket())
        merged = old.join(new.select(self.key), self.key, "left_anti").unionByName(new)
        if touched:
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/version={version}")
        held |= dict.fromkeys(touched, version)
        listed = sorted(held.items()) or [(-1, version)]
        spark.createDataFrame(listed, "bucket int, held long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/version={version}")
        return len(touched)
