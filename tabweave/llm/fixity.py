"""Merkle fixity audit of record archives: trees of hashes over records and ordered offset ranges, compared from the root down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import kept, named

#: Bytes of a lowest range and ranges that a node joins.
RANGE_BYTES, FAN = 1 << 16, 16


def hashed(records: DataFrame, id_col: str, payload: list[str]) -> DataFrame:
    """(id, size, hash) of each record: its columns as text, each preceded by its byte length (or n for null), so that no two records share a form."""
    texts = [named(c).cast("string") for c in payload]
    parts = [F.when(t.isNull(), F.lit("n:")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    body = F.concat(*parts)
    return records.select(named(id_col).cast("long").alias("id"), F.octet_length(body).cast("long").alias("size"), F.sha2(body, 256).alias("hash"))


def placed(rows: DataFrame) -> DataFrame:
    """Records with their offsets [first, past) in the order of ids, from the totals of range partitions (one row each).  Equal ids
    are told apart by their number ``nth`` in the order of hashes."""
    ranged = kept(rows.withColumn("tie", F.monotonically_increasing_id()), "fixity-records").repartitionByRange(F.col("id").asc_nulls_first(), "hash", "tie")
    ranged = kept(ranged.withColumn("part", F.spark_partition_id()), "fixity-ranges")
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"))
    starts = totals.select("part", (F.sum("bytes").over(W.orderBy("part")) - F.col("bytes")).alias("before"))
    inside = W.partitionBy("part").orderBy(F.col("id").asc_nulls_first(), "hash", "tie")
    at = F.col("before") + F.sum("size").over(inside) - F.col("size")
    return ranged.join(F.broadcast(starts), "part").withColumn("first", at).select("id", "hash", "first", (F.col("first") + F.col("size")).alias("past"))


def _leaves(rows: DataFrame) -> DataFrame:
    """(node, hash) of the lowest ranges: the number of their records and two sums of parts of the records' hashes, so the digest is put together before
    the shuffle and no range's records are collected."""
    part = lambda first: F.conv(F.substring("hash", first, 15), 16, 10).cast("decimal(38,0)")
    sums = rows.groupBy("node").agg(F.count("*").alias("n"), F.sum(part(1)).alias("a"), F.sum(part(16)).alias("b"))
    return sums.select("node", F.sha2(F.concat_ws(":", "n", "a", "b"), 256).alias("hash"))


def tree(rows: DataFrame, levels: int) -> list[DataFrame]:
    """Levels of (node, hash) from the lowest ranges of (node, hash) records up to the root.  A node above has the hash of its children's places and
    hashes in order, of which there are ``FAN`` at most."""
    out = [kept(_leaves(rows), "fixity-level")]
    for _ in range(levels):
        children = F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda c: F.concat_ws(":", c["node"].cast("string"), c["hash"]))
        up = out[-1].groupBy(F.floor(F.col("node") / FAN).alias("up")).agg(F.sha2(F.array_join(children, ","), 256).alias("hash"))
        out.append(kept(up.withColumnRenamed("up", "node"), "fixity-level"))
    return out


def in_ranges(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """``rows`` (id, hash) with the range that their id falls into, by the smallest id of each range (``bounds``: node, id); ids before all bounds belong to
    the first.  Rows and bounds are sorted together, and the last bound of each partition (one row) goes on to the next."""
    nothing = F.lit(None)
    both = rows.select("id", "hash", nothing.cast("long").alias("bound"), F.lit(1).alias("kind")).unionByName(
        bounds.select("id", nothing.cast("string").alias("hash"), F.col("node").alias("bound"), F.lit(0).alias("kind")))
    ranged = kept(both.repartitionByRange(F.col("id").asc_nulls_first(), "kind", "hash").withColumn("part", F.spark_partition_id()), "fixity-sides")
    last = ranged.groupBy("part").agg(F.max("bound").alias("last"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carried = last.select("part", F.max("last").over(before).alias("carried"))
    order = W.partitionBy("part").orderBy(F.col("id").asc_nulls_first(), "kind").rowsBetween(W.unboundedPreceding, 0)
    found = ranged.withColumn("own", F.last("bound", ignorenulls=True).over(order)).join(F.broadcast(carried), "part")
    first = bounds.agg(F.min("node").alias("lowest"))
    return found.where("kind = 1").join(F.broadcast(first)).select("id", "hash", F.coalesce("own", "carried", "lowest").alias("node"))


def differing(here: list[DataFrame], there: list[DataFrame]) -> DataFrame:
    """Lowest ranges in which two trees differ: the roots are compared, then the children of the nodes that differ."""
    bad = None
    for a, b in zip(reversed(here), reversed(there), strict=True):
        if bad is not None:
            a, b = (x.join(bad.select(F.col("node").alias("up")), F.floor(F.col("node") / FAN) == F.col("up"), "left_semi") for x in (a, b))
        both = a.join(b.select("node", F.col("hash").alias("other")), "node", "full")
        bad = kept(both.where(~F.col("hash").eqNullSafe(F.col("other"))).select("node"), "fixity-bad")
    return bad


def layout(master: DataFrame, id_col: str, payload: list[str]) -> DataFrame:
    """The master's records (id, hash, first, past, node).  Records of one id share the range in which the first of them starts."""
    own = kept(placed(hashed(master, id_col, payload)), "fixity-master")
    begin = own.groupBy("id").agg(F.floor(F.min("first") / RANGE_BYTES).cast("long").alias("node"))
    return kept(own.join(begin.withColumnRenamed("id", "at"), F.col("id").eqNullSafe(F.col("at"))).drop("at"), "fixity-layout")


def compare(own: DataFrame, theirs: DataFrame) -> DataFrame:
    """The lowest ranges that differ between the master's layout and a replica's records in the same ranges."""
    size = own.agg(F.max("past")).first()[0] or 0
    levels = 0
    while RANGE_BYTES * FAN**levels < size:
        levels += 1
    return differing(tree(own.select("node", "hash"), levels), tree(theirs.select("node", "hash"), levels))


def audit(master: DataFrame, replica: DataFrame, id_col: str, payload: list[str]) -> DataFrame:
    """One row per record of ``master``, and per id that only ``replica`` has: (id_col, first, past, hash, replica_hash, intact).

    The master's records are laid out by id; first and past are byte offsets, and fixed offset ranges are the leaves of its tree.  The replica is hashed
    into the same ranges by their smallest ids, without looking at the master's records.  The roots are compared, and only children of
    differing nodes; records meet by id only in ranges that differ, all others are intact with the hash of the master.  In such a range a record is intact if
    the replica has one of its id and hash; else replica_hash is the least hash of its id there, or null if it is lost.  A record only in the
    replica has no offset and is not intact.  An added or lost record changes its own range and no later one.

    Null fields and empty ones differ; null ids are a record's id like any other; repeated records are each placed, and a replica that has one of them has
    all; very long records are a range of their own; other columns are ignored.  Empty tables give no rows, or all rows as lost."""
    own = layout(master, id_col, payload)
    bounds = own.groupBy("node").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id")).alias("least")).select("node", F.col("least.id").alias("id"))
    theirs = kept(in_ranges(hashed(replica, id_col, payload), kept(bounds, "fixity-bounds")), "fixity-replica")
    nothing = F.lit(None)
    if own.limit(1).count() == 0:  # no ranges: everything is extra
        extra = hashed(replica, id_col, payload).groupBy("id").agg(F.min("hash").alias("replica_hash"))
        here = own.select("id", "first", "past", "hash", nothing.cast("string").alias("replica_hash"), F.lit(False).alias("intact"))
    else:
        bad = compare(own, theirs)
        ours, there = own.join(bad, "node", "left_semi"), kept(theirs.join(bad, "node", "left_semi").select("id", "hash").distinct(), "fixity-suspects")
        same_id = lambda c: F.col("id").eqNullSafe(F.col(c))
        exact = there.select(F.col("id").alias("i"), F.col("hash").alias("h"), F.lit(True).alias("same"))
        least = there.groupBy("id").agg(F.min("hash").alias("least")).withColumnRenamed("id", "j")
        met = ours.join(exact, same_id("i") & (F.col("hash") == F.col("h")), "left").join(least, same_id("j"), "left")
        here = own.join(bad, "node", "left_anti").select("id", "first", "past", "hash", F.col("hash").alias("replica_hash"), F.lit(True).alias("intact")).unionByName(
            met.select("id", "first", "past", "hash", F.when(F.col("same"), F.col("hash")).otherwise(F.col("least")).alias("replica_hash"), F.coalesce("same", F.lit(False)).alias("intact")))
        extra = least.join(ours.select("id").distinct(), same_id("j"), "left_anti").select(F.col("j").alias("id"), F.col("least").alias("replica_hash"))
    added = extra.select("id", nothing.cast("long").alias("first"), nothing.cast("long").alias("past"), nothing.cast("string").alias("hash"), "replica_hash", F.lit(False).alias("intact"))
    return here.unionByName(added).withColumnRenamed("id", id_col)
