"""Differences between a contract and what was delivered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-9


def numbers_equal(actual, expected) -> Column:
    a, e = F.col(actual), F.col(expected)
    close = F.abs(a - e) <= F.greatest(F.lit(TOLERANCE), F.abs(e) * TOLERANCE)
    return (a.isNull() & e.isNull()) | F.coalesce(close, F.lit(False))


def texts_equal(actual, expected) -> Column:
    """Blank and null are the same text."""
    return F.coalesce(F.col(actual), F.lit("")) == F.coalesce(F.col(expected), F.lit(""))


def scoped_diff(before: DataFrame, after: DataFrame, key: str, allowed: DataFrame | None = None) -> DataFrame:
    """One row per id: added, missing, changed or unchanged, and whether the change
    lies outside the allowed ids.  Numbers compare with a relative tolerance."""
    columns = [c for c in before.columns if c != key]
    kinds = dict(before.dtypes)
    joined = before.select(key, F.struct(*columns).alias("b")).join(after.select(key, F.struct(*columns).alias("a")), key, "full")
    flat = joined.select(key, "a", "b", *[F.col(f"a.{c}").alias(f"a_{c}") for c in columns], *[F.col(f"b.{c}").alias(f"b_{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        numeric = kinds[c] in ("double", "float", "int", "bigint") or kinds[c].startswith("decimal")
        same = same & (numbers_equal if numeric else texts_equal)(f"a_{c}", f"b_{c}")
    change = (
        F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "missing").when(same, "unchanged").otherwise("changed")
    )
    out = flat.select(key, change.alias("change"))
    if allowed is None:
        return out.withColumn("outside", F.lit(False))
    ok = allowed.select(key).distinct().withColumn("_ok", F.lit(True))
    return out.join(ok, key, "left").select(
        key, "change", (F.col("_ok").isNull() & (F.col("change") != "unchanged")).alias("outside"))


def attribute_diff(before: DataFrame, after: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """Ids whose attributes, taken as one value, are not the same on both sides."""
    b = before.select(key, F.struct(*attributes).alias("b"))
    a = after.select(key, F.struct(*attributes).alias("a"))
    return b.join(a, key, "full").where(~F.col("a").eqNullSafe(F.col("b"))).select(
        key, F.when(F.col("a").isNull(), "object lost").when(F.col("b").isNull(), "object added").otherwise("attributes changed").alias("issue"))


def truncation_check(planned: DataFrame, written: DataFrame) -> DataFrame:
    """Per contract, whether the written grid (row_ix, col_ix, text) holds the
    planned one and no literal None."""
    shape = lambda df, p: df.groupBy("target_id").agg((F.max("row_ix") + 1).alias(f"{p}_rows"), (F.max("col_ix") + 1).alias(f"{p}_cols"))
    none = written.groupBy("target_id").agg(F.count_if(F.col("text") == "None").alias("none_texts"))
    out = shape(planned, "planned").join(shape(written, "written"), "target_id", "left").join(none, "target_id", "left")
    got = lambda c: F.coalesce(F.col(c), F.lit(0))
    issue = (
        F.when(got("written_rows") < F.col("planned_rows"), "rows truncated")
        .when(got("written_cols") < F.col("planned_cols"), "columns truncated").when(got("none_texts") > 0, "literal None")
    )
    return out.select("target_id", F.coalesce(issue, F.lit("ok")).alias("issue"))


def diff_report(diff: DataFrame) -> DataFrame:
    return diff.groupBy("change").agg(F.count("*").alias("n"), F.count_if("outside").alias("n_outside"))
