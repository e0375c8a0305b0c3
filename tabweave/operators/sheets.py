"""Sheets read into source tables.

A sheet goes through stages, each for the sheets that the one before left over: a header with data below it, names with values,
nothing that can be read, nothing at all.  Everything stays in long rows; a stage is a filter on the sheets still open.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import grid

KEY_VALUE, UNKNOWN, EMPTY = "key_value_rows", "unknown", "empty"
BY_CATEGORY = "categories_rows_series_columns"


@dataclass(frozen=True)
class SheetTables:
    """``tables``: (table_id, orientation, n_rows, n_cols, r0, c0, r1, c1), one row for each sheet; the range is that of its non-blank cells.
    ``labels``: (table_id, axis, ix, label, fmt), axis 'category' or 'series', with the dominant format of each series.
    ``values``: (table_id, row_ix, col_ix, text, num) of the filled positions below the header, or beside the names."""

    tables: DataFrame
    labels: DataFrame
    values: DataFrame


def _with_header(cells: DataFrame, headers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Kinds, labels and values of the sheets that have a header."""
    own = cells.join(headers.select("table_id"), "table_id", "left_semi")
    rows = grid.data_rows(own, headers, grid.label_column(own, headers))
    rows = cut_lineage(grid.infer_labels(rows, own, headers), "sheet-rows")
    kinds = cut_lineage(grid.orientation(own, headers, rows), "sheet-kinds")
    by_row = F.col("orientation") != BY_CATEGORY
    texts = grid.typed(own).join(headers.select("table_id", "header_row", "start_col", "end_col"), "table_id").where("col_ix between start_col and end_col")
    heads = headers.select("table_id", "start_col", F.explode(F.sequence("start_col", "end_col")).alias("col_ix")).join(
        texts.where("row_ix = header_row").select("table_id", "col_ix", "text"), ["table_id", "col_ix"], "left")
    heads = heads.join(kinds, "table_id").select(
        "table_id", F.when(by_row, "category").otherwise("series").alias("axis"), (F.col("col_ix") - F.col("start_col")).alias("ix"), F.coalesce("text", F.lit("")).alias("label"))
    items = rows.join(kinds, "table_id").select(
        "table_id", F.when(by_row, "series").otherwise("category").alias("axis"), F.col("item").alias("ix"), grid.axis_label("label", "item", "orientation").alias("label"))
    filled = texts.join(rows.select("table_id", "row_ix", "item"), ["table_id", "row_ix"]).select(
        "table_id", F.col("item").alias("row_ix"), (F.col("col_ix") - F.col("start_col")).alias("col_ix"), "text", F.col("number").alias("num"), "fmt")
    filled = cut_lineage(filled, "sheet-values")
    along = filled.join(kinds, "table_id")
    formats = [
        grid.dominant_format(along.where(which), ["table_id", ix], [at]).select("table_id", F.lit("series").alias("axis"), F.col(ix).alias("ix"), "fmt")
        for which, ix, at in ((by_row, "row_ix", "col_ix"), (~by_row, "col_ix", "row_ix"))]
    labels = heads.unionByName(items).join(formats[0].unionByName(formats[1]), ["table_id", "axis", "ix"], "left").withColumn("fmt", F.coalesce("fmt", F.lit("")))
    shapes = kinds.select("table_id", "orientation", F.col("n_rows").cast("int").alias("n_rows"))
    return shapes.join(headers.select("table_id", (F.col("end_col") - F.col("start_col") + 1).alias("n_cols")), "table_id"), labels, filled.drop("fmt")


def _names_with_values(cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same of sheets without a header that have names beside values."""
    pairs = grid.key_value(cells).withColumn("ix", F.row_number().over(W.partitionBy("table_id").orderBy("row_ix")) - 1)
    pairs = cut_lineage(pairs.select("table_id", "ix", "label", "value", "number"), "sheet-pairs")
    kinds = pairs.groupBy("table_id").agg(F.count("*").cast("int").alias("n_rows")).select("table_id", F.lit(KEY_VALUE).alias("orientation"), "n_rows", F.lit(1).alias("n_cols"))
    nothing = F.lit("").alias("fmt")
    labels = pairs.select("table_id", F.lit("category").alias("axis"), "ix", "label", nothing).unionByName(
        kinds.select("table_id", F.lit("series").alias("axis"), F.lit(0).alias("ix"), F.lit(grid.VALUE_NAME).alias("label"), nothing))
    values = pairs.where("value is not null").select("table_id", F.col("ix").alias("row_ix"), F.lit(0).alias("col_ix"), F.col("value").alias("text"), F.col("number").alias("num"))
    return kinds, labels, values


def read_sheets(cells: DataFrame, sheets: DataFrame | None = None) -> SheetTables:
    """Source tables of ``cells`` (table_id, row_ix, col_ix, raw, num, fmt).

    Blank borders are cut off.  A sheet with a header row becomes one of three orientations: a single row of periods, series in rows under periods, or
    categories in rows; rows without a name get a numbered stand-in.  A sheet without a header is read as names with values, else it is 'unknown';
    a sheet without any filled cell is 'empty'.  ``sheets`` names sheets that may have no cells at all."""
    cells = cut_lineage(cells.select("table_id", "row_ix", "col_ix", "raw", "num", "fmt"), "loose-cells")
    # texts and numbers are read once, for all stages
    trimmed = cut_lineage(grid.typed(grid.trim_grid(cells)).drop("raw", "num"), "sheet-cells")
    ranges = trimmed.select("table_id", "r0", "c0", "r1", "c1").distinct()
    own = trimmed.drop("r0", "c0", "r1", "c1")
    headers = cut_lineage(grid.header_row(own), "headers")
    stages = [_with_header(own, headers), _names_with_values(own.join(headers.select("table_id"), "table_id", "left_anti"))]
    kinds, labels, values = (a.unionByName(b) for a, b in zip(*stages, strict=True))
    known = cells.select("table_id").union(sheets.select("table_id")) if sheets is not None else cells.select("table_id")
    tables = known.distinct().join(ranges, "table_id", "left").join(kinds, "table_id", "left").select(
        "table_id", F.coalesce("orientation", F.when(F.col("r0").isNull(), EMPTY).otherwise(UNKNOWN)).alias("orientation"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_cols", F.lit(0)).alias("n_cols"), "r0", "c0", "r1", "c1")
    return SheetTables(tables, labels, values)


def as_sources(read: SheetTables, heads: DataFrame) -> DataFrame:
    """``heads`` (table_id and whatever describes a source) with orientation and axes as matching wants them; sheets without axes are left out."""
    axis = lambda name: F.array_sort(F.collect_list(F.when(F.col("axis") == name, F.struct("ix", "label", "fmt"))))
    gathered = read.labels.groupBy("table_id").agg(axis("category").alias("c"), axis("series").alias("s"))
    return heads.join(read.tables.select("table_id", "orientation"), "table_id").join(gathered, "table_id").select(
        *heads.columns, "orientation", F.col("c.label").alias("categories"), F.col("s.label").alias("series"), F.col("s.fmt").alias("series_formats"))
