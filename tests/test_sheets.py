"""Sheets read into source tables, and plans made from raw cells."""

import pytest
from pyspark.sql import functions as F
from sheets import grid_cells

from tabweave.operators import sheets as reader
from tabweave.plans.matching import match_plans

SHEETS = {
    "periods": [["Fleet report"], [None], [None, "2011", "2012", "2013"], ["north", 3, 4, 5], ["", 6, 7, 8], ["south", 9, None, 2]],
    "turned": [[None, "north", "south", ""], ["2011", 3, 9, 1], ["2012", 4, 8, 1], [None, 5, 7, 1]],
    "single": [[None, "Jan/24", "Fev/24"], [None, 5, 6]],
    "shares": [[None, "2011", "2012"], ["a", .5, .25], ["b", .75, 1], ["", 40, 41]],
    "names": [["fleet", 9], ["trucks", 4], ["carts", None], ["12", 5]],
    "unknown": [["only a title"]], "empty": [[None, " "], ["", None]],
}


@pytest.fixture(scope="module")
def read(spark):
    known = spark.createDataFrame([("missing",)], "table_id string")
    return reader.read_sheets(grid_cells(spark, SHEETS), known)


def axes(read):
    out = {}
    for r in sorted(read.labels.collect(), key=lambda r: r.ix):
        out.setdefault((r.table_id, r.axis), []).append(r.label)
    return out


def test_every_outcome(read):
    assert {r.table_id: r.orientation for r in read.tables.collect()} == {
        "periods": "series_rows_categories_columns", "turned": "categories_rows_series_columns", "single": "single_series_row_categories_columns",
        "shares": "series_rows_categories_columns", "names": "key_value_rows", "unknown": "unknown", "empty": "empty", "missing": "empty"}
    box = {r.table_id: (r.r0, r.c0, r.r1, r.c1, r.n_rows, r.n_cols) for r in read.tables.collect()}
    assert box["periods"] == (0, 0, 5, 3, 3, 3) and box["unknown"] == (0, 0, 0, 0, 0, 0) and box["empty"][0] is None


def test_axes_and_stand_ins(read):
    got = axes(read)
    assert got["periods", "series"] == ["north", "Serie 2", "south"] and got["periods", "category"] == ["2011", "2012", "2013"]
    assert got["turned", "category"] == ["2011", "2012", "Linha 3"] and got["turned", "series"] == ["north", "south"]
    assert got["single", "series"] == ["Valor"] and got["single", "category"] == ["Jan/24", "Fev/24"]
    assert got["shares", "series"] == ["a", "b", "NPS"]
    assert got["names", "category"] == ["fleet", "trucks", "carts"] and got["names", "series"] == ["Valor"]
    assert not any(t in ("unknown", "empty", "missing") for t, _ in got)


def test_values_keep_their_places(read):
    got = {(r.table_id, r.row_ix, r.col_ix): r.num for r in read.values.collect()}
    assert got["periods", 1, 2] == 8 and ("periods", 2, 1) not in got and got["turned", 2, 1] == 7
    assert got["names", 0, 0] == 9 and ("names", 2, 0) not in got and got["single", 0, 1] == 6


def test_nothing_to_read(spark):
    nothing = grid_cells(spark, {"x": [["a"]]}).where("false")
    out = reader.read_sheets(nothing)
    assert [df.count() for df in (out.tables, out.labels, out.values)] == [0, 0, 0]


def test_plans_from_raw_cells(spark, read):
    """Contracts filled from sheets that nobody has described."""
    heads = read.tables.select("table_id").withColumns({
        "block_id": F.lit(1), "table_ix": F.xxhash64("table_id"), "file_name": F.concat("table_id", F.lit(".xlsx")), "source_id": F.lit(""), "title": F.lit(""), "graph_id": F.lit("")})
    tables = reader.as_sources(read, heads)
    targets = spark.createDataFrame(
        [("A", 1, 0, "chart", "x", 0, "series_rows_categories_columns", ["2012", "2011"], ["South", "north"], ""),
         ("B", 1, 1, "chart", "y", 0, "categories_rows_series_columns", ["trucks", "fleet"], ["Valor"], "")],
        "target_id string, block_id int, target_ix bigint, object_type string, shape_name string, table_width int, orientation string, categories array<string>, series array<string>, nearby_text string")
    found = match_plans(targets, tables.where("table_id in ('periods', 'names')"), read.values)
    assert {(r.target_id, r.table_id) for r in found.plans.collect()} == {("A", "periods"), ("B", "names")}
    cells = {(r.target_id, r.row_label, r.col_label): r.value for r in found.cells.collect()}
    assert cells["A", "north", "2011"] == 3 and cells["A", "south", "2012"] is None and cells["B", "trucks", "Valor"] == 4
