"""Contracts: how a source is read for them, their manifest, and their checks."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.choices import typed_cell
from ..functions.numbers import parse_number

_CELL = r"^[A-Za-z]{1,4}\d{1,7}(:[A-Za-z]{1,4}\d{1,7})?$"


def read_contract(mapping: DataFrame, regions: DataFrame) -> DataFrame:
    """What each mapping row reads: cell_range, range_mode and allow_growth, or the
    issue that stops it.  ``mapping`` has table_id, read_mode and reference."""
    per_table = regions.groupBy("table_id").agg(F.count("*").alias("n_regions"), F.min("region_name").alias("only_region"))
    named = regions.select("table_id", F.lower("region_name").alias("_r"), F.col("region_name").alias("named_region"))
    ref = F.replace(F.trim(F.coalesce("reference", F.lit(""))), F.lit("$"), F.lit(""))
    m = mapping.withColumn("reference", ref).withColumn("_r", F.lower(ref))
    j = m.join(per_table, "table_id", "left").join(named, ["table_id", "_r"], "left").withColumn("n_regions", F.coalesce("n_regions", F.lit(0)))
    given, is_cell = F.col("reference") != "", F.col("reference").rlike(_CELL)
    mode = F.col("read_mode")
    single = F.when(F.col("n_regions") == 1, F.col("only_region"))
    issue = (
        F.when((mode == "tabela_excel") & ~given & single.isNull(), "name of a region is missing")
        .when((mode == "tabela_excel") & given & F.col("named_region").isNull(), "region not found")
        .when(mode.isin("dinamico", "exato") & ~given, "range is missing")
        .when(mode.isin("dinamico", "exato") & ~is_cell, "reference is invalid")
        .when((mode == "auto") & given & F.col("named_region").isNull() & ~is_cell, "reference is invalid")
    )
    cell_range = (
        F.when(mode == "tabela_excel", F.coalesce("named_region", single)).when(mode.isin("dinamico", "exato"), F.col("reference"))
        .when(given, F.coalesce("named_region", "reference")).otherwise(F.coalesce(single, F.lit("")))
    )
    dynamic = (mode == "dinamico") | ((mode == "auto") & given & F.col("named_region").isNull())
    out = j.withColumn("issue", issue).withColumn("cell_range", F.when(issue.isNull(), cell_range)).withColumn(
        "range_mode", F.when(issue.isNull(), F.when(dynamic, "dynamic").otherwise("exact")))
    grows = (F.col("cell_range") != "") & ((F.col("range_mode") == "dynamic") | mode.isin("dinamico", "tabela_excel") | ((mode == "auto") & ~F.col("cell_range").rlike(_CELL)))
    return out.withColumn("allow_growth", F.coalesce(grows, F.lit(False))).drop("_r", "n_regions", "only_region", "named_region")


def contract_manifest(targets: DataFrame) -> DataFrame:
    """Rows and columns of each contract by its orientation, with their counts."""
    by_series = F.col("orientation") == "series_rows_categories_columns"
    rows = F.when(by_series, F.col("series")).otherwise(F.col("categories"))
    cols = F.when(by_series, F.col("categories")).otherwise(F.col("series"))
    return targets.withColumn("row_labels", rows).withColumn("col_labels", cols).withColumn("n_rows", F.size(rows)).withColumn("n_cols", F.size(cols))


def typed_matrix_issues(cells: DataFrame, headers: DataFrame, capacity: DataFrame) -> DataFrame:
    """(target_id, issue, n) of proposed matrices: ragged rows, numbers that are
    none, and more series than the contract can hold.  ``cells`` has row_ix,
    col_ix, raw and want ('number' or 'text'); ``headers`` has n_headers."""
    c = cells.withColumn("t", typed_cell("raw"))
    rows = c.groupBy("target_id", "row_ix").agg(F.count("*").alias("n"), F.count_if((F.col("want") == "number") & (F.col("t.type") != "number")).alias("bad"))
    per = rows.join(headers, "target_id").groupBy("target_id").agg(
        F.count_if(F.col("n") != F.col("n_headers")).alias("ragged row"), F.sum("bad").alias("invalid number"), F.max("n_headers").alias("_h"), F.count("*").alias("_rows"))
    over = per.join(capacity, "target_id", "left")
    used = F.when(F.col("orientation") == "series_rows_categories_columns", F.col("_rows")).otherwise(F.greatest(F.col("_h") - 1, F.lit(0)))
    over = over.withColumn("series beyond capacity", F.when((F.col("n_series") > 0) & (used > F.col("n_series")), used - F.col("n_series")).otherwise(0))
    return over.unpivot("target_id", ["ragged row", "invalid number", "series beyond capacity"], "issue", "n").where("n > 0")


def matrix_shape_ok(cells: DataFrame, expected: DataFrame) -> DataFrame:
    """Whether a proposed matrix is rectangular and of the expected shape."""
    rows = cells.groupBy("target_id", "row_ix").agg(F.count("*").alias("n"))
    shape = rows.groupBy("target_id").agg(F.count("*").alias("n_rows"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    ok = (F.col("lo") == F.col("hi")) & (F.col("n_rows") == F.col("want_rows")) & (F.col("hi") == F.col("want_cols"))
    return expected.join(shape, "target_id", "left").select("target_id", F.coalesce(ok, F.lit(False)).alias("ok"))


class Resolved(NamedTuple):
    """decisions: target_id, outcome, reading, percent.  axes: target_id, axis, ix, label.  values: target_id, row_ix, col_ix, text, num."""

    decisions: DataFrame
    axes: DataFrame
    values: DataFrame


def resolve_matrix(plans: DataFrame, axes: DataFrame, values: DataFrame, headers: DataFrame, cells: DataFrame) -> Resolved:
    """Plans with proposed matrices in place of theirs where a proposal can be read; the others keep what they have.

    ``plans``: target_id, orientation, object_type, status; ``axes``: target_id, axis ('category' or 'series'), ix, label; ``values``: target_id,
    row_ix, col_ix, num.  A proposal has ``headers`` (target_id, ix, text) and ``cells`` (target_id, row_ix, col_ix, text), the first cell of a row being
    its label.  The orientation says which axis the rows are.  The column axis is read from the headers: the filled ones if there is one for each
    column, else those after the corner, else the plan keeps its own axis.  Only charts in review are corrected, and only by rows of one length that
    is the column axis' length; ``outcome`` says what was in the way.  Numbers lose a percent sign, blanks are null, other texts stay as ``text``.
    Indexes may have gaps; null texts are blank."""
    text = F.trim(F.coalesce("text", F.lit("")))
    headers, cells = headers.withColumn("text", text), cells.withColumn("text", text)
    rows = cells.groupBy("target_id", "row_ix").agg(F.count("*").alias("n"), F.max(F.col("text").contains("%")).alias("p"))
    shape = rows.groupBy("target_id").agg(F.count("*").alias("n_rows"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("p").alias("percent"))
    heads = headers.groupBy("target_id").agg(F.count("*").alias("n_heads"), F.count_if(F.col("text") != "").alias("n_clean"))
    own = axes.groupBy("target_id", F.col("axis").alias("col_axis")).agg(F.count("*").alias("n_own"))
    by_series = F.col("orientation") == "series_rows_categories_columns"
    d = plans.withColumn("col_axis", F.when(by_series, "category").otherwise("series")).join(shape, "target_id", "left").join(
        heads, "target_id", "left").join(own, ["target_id", "col_axis"], "left").fillna(0, ["n_rows", "lo", "hi", "n_heads", "n_clean", "n_own"])
    width = F.col("hi") - 1
    reading = F.when(F.col("n_clean") == width, "filled").when(F.col("n_heads") == width + 1, "after corner").when(F.col("n_own") == width, "kept").when(
        F.col("n_clean") > 0, "filled").otherwise("kept")
    n_cols = F.when(F.col("reading") == "filled", F.col("n_clean")).when(F.col("reading") == "kept", F.col("n_own")).otherwise(F.col("n_heads") - 1)
    outcome = (
        F.when(F.coalesce("object_type", F.lit("")) != "chart", "not a chart").when(F.lower(F.coalesce("status", F.lit(""))) != "review", "not in review")
        .when(F.col("n_rows") == 0, "no rows").when((n_cols <= 0) | (F.col("lo") != F.col("hi")) | (width != n_cols), "shape differs").otherwise("corrected")
    )
    d = d.withColumn("reading", reading).withColumn("outcome", outcome)
    fixed = d.where("outcome = 'corrected'").select("target_id", "col_axis", "reading")
    row_axis = F.when(F.col("col_axis") == "category", "series").otherwise("category")

    # places without gaps
    place = lambda *keys: F.row_number().over(W.partitionBy("target_id", *keys[:-1]).orderBy(keys[-1])) - 1
    row_places = rows.select("target_id", "row_ix").withColumn("_row", place("row_ix"))
    new = cells.join(fixed, "target_id").join(row_places, ["target_id", "row_ix"]).withColumn("_col", place("row_ix", "col_ix"))
    chosen = headers.join(fixed.where("reading <> 'kept'"), "target_id").withColumn("_at", place("ix"))
    chosen = chosen.where(F.when(F.col("reading") == "filled", F.col("text") != "").otherwise(F.col("_at") > 0)).withColumn("_at", place("ix"))
    stays = axes.join(fixed, "target_id", "left").where(F.col("reading").isNull() | ((F.col("reading") == "kept") & (F.col("axis") == F.col("col_axis"))))
    all_axes = (
        new.where("_col = 0").select("target_id", row_axis.alias("axis"), F.col("_row").alias("ix"), F.col("text").alias("label"))
        .unionByName(chosen.select("target_id", F.col("col_axis").alias("axis"), F.col("_at").alias("ix"), F.col("text").alias("label")))
        .unionByName(stays.select("target_id", "axis", "ix", "label"))
    )
    number = parse_number(F.replace(F.col("text"), F.lit(" "), F.lit("")))
    proposed = new.where("_col > 0").withColumn("num", number).select(
        "target_id", F.col("_row").alias("row_ix"), (F.col("_col") - 1).alias("col_ix"), F.when(F.col("num").isNull(), F.nullif(F.col("text"), F.lit(""))).alias("text"), "num")
    kept = values.join(fixed, "target_id", "left_anti").select("target_id", "row_ix", "col_ix", F.lit(None).cast("string").alias("text"), "num")
    decisions = d.select("target_id", "outcome", F.when(F.col("outcome") == "corrected", F.col("reading")).alias("reading"), F.coalesce("percent", F.lit(False)).alias("percent"))
    return Resolved(decisions, all_axes, proposed.unionByName(kept))
