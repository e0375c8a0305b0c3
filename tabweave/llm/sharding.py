"""Balanced contiguous shards from global prefix sums of byte sizes, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import kept, named


def balanced_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id_col, size, text_crc32, shard, slot).

    Rows are put in the order of the id (equal ids by checksum and size) over range partitions.  Only the partitions' totals,
    one row each, are summed up in one place; each row's global byte offset is its partition's start plus the sum
    before it within the partition.  A row goes to the shard whose equal share holds the middle of its bytes, so shards are
    contiguous in that order and a cut is at most half a row from its target.  Slots count a shard's rows from 0.

    Size is the UTF-8 length plus 1.  A null or empty text has size 1 and checksum 0.  Null ids come first.  Repeated rows
    each get a slot; many equal ids spread over partitions, as the order ends with a number of the row.
    An empty table gives no rows.  Other columns are ignored."""
    spark = docs.sparkSession
    body = F.coalesce(named(text_col), F.lit(""))
    rows = docs.select(
        named(id_col).alias("id"), (F.octet_length(body) + F.lit(1)).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("tie"),
    )
    rows = kept(rows, "shard-sizes")
    ranged = rows.repartitionByRange(F.col("id").asc_nulls_first(), "text_crc32", "size", "tie")
    ranged = kept(ranged.withColumn("part", F.spark_partition_id()), "shard-ranges")
    # one row for each range partition
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(
        "part", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(W.partitionBy()).alias("total"),
    )
    inside = W.partitionBy("part").orderBy(F.col("id").asc_nulls_first(), "text_crc32", "size", "tie")
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    numbered = ranged.select("*", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("b"), (F.row_number().over(inside) - 1).alias("r"))
    placed = numbered.join(F.broadcast(starts), "part").select(
        "id", "size", "text_crc32", (F.col("rows_before") + F.col("r")).alias("place"),
        F.expr(f"(cast(2 * (bytes_before + b) + size as decimal(38,0)) * {int(shards)}) div (2 * total)").cast("int").alias("shard"),  # no rounding
    )
    placed = kept(placed, "shard-places")
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))  # one row for each shard
    out = placed.join(F.broadcast(firsts), "shard")
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("place") - F.col("first")).cast("long").alias("slot"))
