"""Proposed matrices against a plain reading of them."""

import random

from tabweave.operators import contracts

NUMBERS = {"": None, "1,5%": 1.5, "1.234,25": 1234.25, "- 3": -3.0, "7": 7.0}


def read_plainly(plan, heads, rows):
    """The axes and values of a proposal, or what is in its way."""
    by_series, kind, status, own = plan
    if kind != "chart":
        return "not a chart"
    if status != "review":
        return "not in review"
    if not rows:
        return "no rows"
    width = max(len(r) for r in rows) - 1
    filled = [h for h in heads if h]
    axis = own[0 if by_series else 1]
    if len(filled) == width:
        cols = filled
    elif len(heads) == width + 1:
        cols = heads[1:]
    elif len(axis) == width:
        cols = axis
    else:
        cols = filled or axis
    if not cols or any(len(r) - 1 != len(cols) for r in rows):
        return "shape differs"
    return cols, [r[0] for r in rows], [[(None, NUMBERS[v]) if v in NUMBERS else (v, None) for v in r[1:]] for r in rows]


def test_proposed_matrices(spark):
    rng = random.Random(5)
    plans, axes, values, headers, cells, want = [], [], [], [], [], {}
    for i in range(120):
        t = f"t{i}"
        by_series, kind, status = rng.random() < .5, rng.choice(["chart"] * 6 + ["table"]), rng.choice(["review"] * 6 + ["ok", None])
        own = [[f"{a}{j}" for j in range(rng.randint(0, 3))] for a in "cs"]
        heads = [rng.choice(["", "h", "x y"]) for _ in range(rng.randint(0, 4))]
        width = rng.randint(0, 3)
        rows = [[rng.choice(["r", "q", ""])] + [rng.choice([*NUMBERS, "n/a"]) for _ in range(width - (rng.random() < .1 and width > 0))] for _ in range(rng.randint(0, 3))]
        plans.append((t, "series_rows_categories_columns" if by_series else "categories_rows_series_columns", kind, status))
        axes += [(t, a, j, v) for a, labels in zip(("category", "series"), own) for j, v in enumerate(labels)]
        values.append((t, 0, 0, 9.5))
        headers += [(t, 5 * j, f" {h}" if h else None) for j, h in enumerate(heads)]
        cells += [(t, 7 * a, 2 * b, v) for a, r in enumerate(rows) for b, v in enumerate(r)]
        want[t] = read_plainly((by_series, kind, status, own), heads, rows), by_series, own
    make = spark.createDataFrame
    out = contracts.resolve_matrix(
        make(plans, "target_id string, orientation string, object_type string, status string"), make(axes, "target_id string, axis string, ix int, label string"),
        make(values, "target_id string, row_ix int, col_ix int, num double"), make(headers, "target_id string, ix int, text string"),
        make(cells, "target_id string, row_ix int, col_ix int, text string"))
    decided = {r.target_id: r.outcome for r in out.decisions.collect()}
    got_axes, got_values = {}, {}
    for r in out.axes.collect():
        got_axes.setdefault((r.target_id, r.axis), {})[r.ix] = r.label
    for r in out.values.collect():
        got_values.setdefault(r.target_id, {})[r.row_ix, r.col_ix] = (r.text, r.num)
    for t, (result, by_series, own) in want.items():
        if isinstance(result, str):
            assert decided[t] == result
            expected, matrix = own, [[(None, 9.5)]]
        else:
            assert decided[t] == "corrected"
            cols, rows, matrix = result
            expected = (cols, rows) if by_series else (rows, cols)
        for axis, labels in zip(("category", "series"), expected):
            assert got_axes.get((t, axis), {}) == dict(enumerate(labels))
        assert got_values.get(t, {}) == {(a, b): v for a, r in enumerate(matrix) for b, v in enumerate(r)}
    assert {"corrected", "shape differs", "no rows", "not a chart", "not in review"} <= set(decided.values())
