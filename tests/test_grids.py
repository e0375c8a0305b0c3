"""Sheets read from cells, and matrices aligned to contracts."""

from pyspark.sql import functions as F
from sheets import grid_cells

from tabweave.operators import alignment, grid


def test_table_blocks(spark):
    sheets = {
        "whole": [["depot", "tons", "trips"], ["east", 7, 3], ["west", 9, 4]], "blank": [[None], [" "], [None]],
        "three": [["p", "q"], [5, 6], [None], ["r", "s"], [7, 8], [None], [None], ["t", "u"], ["v", 9]],
        "gap_column": [["depot", None, None, 4.5], ["east", None, None, 6.5]],
        "heading": [["Fleet"], [None], ["depot", "tons"], ["east", 7]], "narrow": [["x"], ["y"], ["z"]], "single_rows": [["a", 1], [None], ["b", 2]],
    }
    got = {r["table_id"]: r["table_blocks"] for r in grid.table_blocks(grid_cells(spark, sheets)).collect()}
    assert got == {"whole": 1, "blank": 0, "three": 3, "gap_column": 1, "heading": 1, "narrow": 0, "single_rows": 0}


def read(spark, sheets):
    cells = grid_cells(spark, sheets)
    headers = grid.header_row(cells)
    labels = grid.label_column(cells, headers)
    rows = grid.data_rows(cells, headers, labels)
    return cells, headers, rows, {r["table_id"]: r["orientation"] for r in grid.orientation(cells, headers, rows).collect()}


def test_orientation(spark):
    _, _, rows, kinds = read(spark, {
        "single": [[None, "2011", "2012", "2013"], ["tons", 8, 6, 7]], "series": [["kind", "2011", "2012"], ["a", 31, 12], ["b", 14, 25]],
        "categories": [["depot", "tons", "trips"], ["east", 31, 12], ["west", 14, 25]]})
    assert kinds == {"single": "single_series_row_categories_columns", "series": "series_rows_categories_columns", "categories": "categories_rows_series_columns"}
    assert [r["label"] for r in rows.where("table_id = 'series'").orderBy("item").collect()] == ["a", "b"]


def test_ranges_grow_with_the_data(spark):
    sheet = [["gauge", "2011", "2012", "2013", "2014", "note"], ["rain", 3, 1, 4, 1, 0], ["wind", 5, 9, 2, 6, 0]]
    cells = grid_cells(spark, {"free": sheet, "named": sheet})
    seeds = spark.createDataFrame([("free", 0, 0, 1, 3), ("named", 0, 0, 1, 1)], "table_id string, r0 int, c0 int, r1 int, c1 int")
    regions = spark.createDataFrame([("named", 0, 0, 2, 3)], seeds.schema)
    got = {r["table_id"]: (r["r0"], r["c0"], r["r1"], r["c1"]) for r in grid.grow_range(cells, seeds, regions).collect()}
    assert got == {"free": (0, 0, 2, 4), "named": (0, 0, 2, 3)}


PAIR = ("target_id string, table_id string, orientation string, categories array<string>, series array<string>, source_orientation string, "
        "source_categories array<string>, source_series array<string>, allow_growth boolean")


def filled(spark, orientation, categories, series, source, matrix, growth=False):
    """mode, row labels, column labels and matrix of one aligned contract."""
    kind, s_categories, s_series = source
    pair = spark.createDataFrame([("t", "s", orientation, categories, series, kind, s_categories, s_series, growth)], PAIR)
    values = spark.createDataFrame([("s", i, j, float(v)) for i, row in enumerate(matrix) for j, v in enumerate(row)], "table_id string, row_ix int, col_ix int, num double")
    aligned = alignment.align(pair)
    cells = alignment.dense_fill(aligned, values).orderBy("row_ix", "col_ix").collect()
    rows = list(dict.fromkeys((c["row_ix"], c["row_label"]) for c in cells))
    cols = list(dict.fromkeys((c["col_ix"], c["col_label"]) for c in cells))
    grid_ = [[c["value"] for c in cells if c["row_ix"] == i] for i, _ in rows]
    return aligned.modes.first()["mode"], [v for _, v in rows], [v for _, v in cols], grid_


BY_CATEGORY, BY_SERIES = "categories_rows_series_columns", "series_rows_categories_columns"


def test_crossed_axes_are_transposed(spark):
    mode, _, _, got = filled(spark, BY_SERIES, ["east", "west", "north"], ["oak", "elm", "ash"],
                             (BY_CATEGORY, ["east", "west", "north"], ["oak", "elm", "ash"]), [[1, 2, 3], [4, 5, 6], [7, 8, 9]])
    assert (mode, got) == ("cross", [[1, 4, 7], [2, 5, 8], [3, 6, 9]])


def test_equal_axes_stay(spark):
    mode, _, _, got = filled(spark, BY_SERIES, ["east", "west", "north"], ["oak", "elm", "ash"],
                             (BY_SERIES, ["east", "west", "north"], ["oak", "elm", "ash"]), [[1, 4, 7], [2, 5, 8], [3, 6, 9]])
    assert (mode, got) == ("same", [[1, 4, 7], [2, 5, 8], [3, 6, 9]])


def test_plus_sign_is_part_of_a_label(spark):
    sizes = ["small", "large", "large +"]
    matrix = [[3, 1], [4, 1], [5, 9], [12, 11]]
    _, rows, _, got = filled(spark, BY_SERIES, ["fleet", "depot 2"], sizes, (BY_CATEGORY, [*sizes, "all"], ["FLEET", "DEPOT 2"]), matrix)
    assert rows == sizes and got == [[3, 1], [4, 1], [5, 9]]


def test_source_order_and_growth(spark):
    _, rows, _, got = filled(spark, BY_CATEGORY, ["red", "green", "blue", "grey"], ["tons"],
                             (BY_CATEGORY, ["blue", "grey", "red", "green"], ["tons"]), [[8], [9], [6], [7]])
    assert rows == ["blue", "grey", "red", "green"] and got == [[8], [9], [6], [7]]
    _, rows, _, got = filled(spark, BY_CATEGORY, ["2011", "2012"], ["rain"], (BY_CATEGORY, ["2011", "2012", "2013"], ["rain"]), [[1], [2], [3]], growth=True)
    assert rows == ["2011", "2012", "2013"] and got == [[1], [2], [3]]


def test_blank_labels_take_unused_candidates(spark):
    rows = lambda *ls: spark.createDataFrame([(g, i, v) for g in (1, 2) for i, v in enumerate(ls) if g == 1 or v.strip()], "g int, ix int, label string")
    out = alignment.fill_blank_labels(rows("west", "", " "), rows("east", "nps", "west", "east"), ["g"])
    assert sorted(map(tuple, out.collect())) == [(1, 0, "west"), (1, 1, "nps"), (1, 2, "east"), (2, 0, "west")]


def test_formats(spark):
    labels, formats = ["a", "b", "c", "NPS"], ["0%", "0%", "0%", "#,##0.0"]
    rows = [(v, i, 4, labels, formats, "", [], [], "", 0.5, m) for i, (v, m) in enumerate(zip(labels, ["number", "auto", "auto", "percent"]))]
    df = spark.createDataFrame(rows, "label string, ix int, n_series int, target_labels array<string>, target_formats array<string>, value_format string, "
                                     "source_labels array<string>, source_formats array<string>, plan_format string, max_abs double, mode string")
    got = alignment.format_cascade(df).orderBy("ix").select("automatic", "format").collect()
    assert [r["automatic"] for r in got] == formats and [r["format"] for r in got] == ["0.0", "0%", "0%", "0%"]


def test_key_value_rows(spark):
    cells = grid_cells(spark, {"kv": [["fleet", 9], ["trucks", 4], ["carts", 5]]})
    got = {r["label"]: r["number"] for r in grid.key_value(cells).collect()}
    assert got == {"fleet": 9.0, "trucks": 4.0, "carts": 5.0}


def test_metadata(spark):
    cells = grid_cells(spark, {"m": [["x", "y"], *[["n", 1]] * 25, ["Graph ID: g-7", None], ["PPT TAG", "t/2"]]})
    assert {(r["key"], r["value"]) for r in grid.metadata_pairs(cells).collect()} == {("graph_id", "g-7"), ("ppt_tag", "t/2")}
    assert cells.where(F.col("raw") == "x").count() == 1
