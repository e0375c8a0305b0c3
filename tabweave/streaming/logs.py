"""Structured Streaming over the append-only logs.

One job per log, the same expressions as the batch reports.  The checkpoint of a
query is its only writer's progress, so no lock is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.aggregates import latest_state, usage_cost
from ..operators.learning import learned_rows
from ..sources.keyed import KeyedTable


def usage_hourly(calls: DataFrame, rates, late: str = "2 hours") -> DataFrame:
    """Usage and cost per hour and operation; records later than ``late`` are dropped."""
    hours = calls.withWatermark("returned_at", late).withColumn("w", F.window("returned_at", "1 hour"))
    out = usage_cost(hours, rates, ["w", "operation"])
    return out.withColumn("hour", F.col("w.start")).drop("w")


def job_state(progress: DataFrame) -> DataFrame:
    """Newest state of each job; run in update mode."""
    return latest_state(progress)


def audit_rows(entries: DataFrame) -> DataFrame:
    return entries.withColumn("identified", F.coalesce(F.trim("actor"), F.lit("")) != "")


def audit_stream(entries: DataFrame, late: str = "2 hours") -> DataFrame:
    """Audit entries once per id, for an append sink partitioned by tenant."""
    return audit_rows(entries.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"]))


def learn_stream(plans: DataFrame, store: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Merge each micro-batch of plans into a table of entries (``ENTRIES``), as the version of that batch.  Only the buckets of its ids are rewritten, a
    replayed batch finds its version complete, and after a restart the store itself tells what is current."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        current = store.read(batch.sparkSession)
        learned = learned_rows(current, batch, str(batch_id))
        for field in current.schema:
            if field.name not in learned.columns:
                learned = learned.withColumn(field.name, F.lit(None).cast(field.dataType))
        store.upsert(learned, batch_id)

    return plans.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_available(df: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None) -> None:
    """Append everything that has arrived to parquet files, then stop."""
    writer = df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.trigger(availableNow=True).start().awaitTermination()
