"""Cells of small sheets."""


def grid_cells(spark, sheets: dict[str, list[list]]):
    """Cells of small sheets given as rows."""
    rows = [
        (t, r, c, v if isinstance(v, str) else None, None if isinstance(v, str) or v is None else float(v), "General")
        for t, sheet in sheets.items() for r, row in enumerate(sheet) for c, v in enumerate(row)
    ]
    return spark.createDataFrame(rows, "table_id string, row_ix int, col_ix int, raw string, num double, fmt string")
