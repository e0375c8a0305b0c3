"""Cell tables: reading any columnar table as cells, source ids and pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import _col, base_name, norm_label

SHEET_MARK = "#"
BASE_ROW = "RESPONDENTES"


def to_cells(df: DataFrame, table_id, row_ix, columns: list[str], fmt: str = "General") -> DataFrame:
    """One row per cell of ``columns``: numbers go to ``num``, the rest to ``raw``.
    A projection and a generator: no shuffle, and unused columns are not read."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    cells = [
        F.struct(
            (F.lit(None).cast("string") if c in numeric else F.col(c).cast("string")).alias("raw"),
            (F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")).alias("num"),
        )
        for c in columns
    ]
    return df.select(
        _col(table_id).alias("table_id"), _col(row_ix).alias("row_ix"), F.posexplode(F.array(*cells)).alias("col_ix", "cell")
    ).select("table_id", "row_ix", "col_ix", "cell.raw", "cell.num", F.lit(fmt).alias("fmt"))


def source_id_of(file_name, sheet_name) -> Column:
    return F.concat_ws(SHEET_MARK, _col(file_name), F.nullif(_col(sheet_name), F.lit("")))


def file_of(table_id) -> Column:
    return F.split_part(_col(table_id), F.lit(SHEET_MARK), F.lit(1))


def sheet_of(table_id) -> Column:
    return F.when(_col(table_id).contains(SHEET_MARK), F.regexp_extract(_col(table_id), "#(.*)$", 1)).otherwise(F.lit(""))


def prune_sources(cells: DataFrame, wanted: DataFrame, key: str = "table_id") -> DataFrame:
    """Cells of the wanted tables only.  On a table partitioned by ``key`` the semi
    join prunes partitions; otherwise it filters before any other work."""
    return cells.join(wanted.select(key).distinct(), key, "left_semi")


def split_base_row(rows: DataFrame, label="label") -> tuple[DataFrame, DataFrame]:
    """Labelled rows without the respondent base row, and the base rows alone."""
    is_base = norm_label(label, plus=False) == BASE_ROW
    labelled = rows.where(F.trim(F.coalesce(_col(label), F.lit(""))) != "")
    return labelled.where(~is_base), labelled.where(is_base)


def same_base_name(left, right) -> Column:
    return F.lower(base_name(left)) == F.lower(base_name(right))
