"""Validating a prepared mapping against contracts, files and sheets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_name
from ..operators.contracts import read_contract
from ..session import cut_lineage


def validate_package(mapping: DataFrame, targets: DataFrame, tables: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(issues, resolved) of loaded mapping rows.

    Issues are (level, target_id, issue); a package may be published only when none
    is an ERROR.  Each check is a join or an anti join over inputs written once, so
    no check reads the mapping, the sheets or the regions again."""
    known = cut_lineage(targets.select("target_id").distinct(), "known")
    mapping = cut_lineage(mapping, "mapping")
    active = mapping.where("active = 1")
    mine = active.join(known, "target_id", "left_semi").withColumn("file_key", F.lower(base_name("file_name")))
    sheets = cut_lineage(tables.withColumn("file_key", F.lower(base_name("file_name"))), "sheets")
    per_file = sheets.groupBy("file_key").agg(F.count("*").alias("n_sheets"), F.min("sheet_name").alias("only_sheet"))
    issue = lambda df, level, text: df.select(F.lit(level).alias("level"), "target_id", F.lit(text).alias("issue"))
    nobody = lambda df: df.select(F.lit("").alias("target_id"))

    unnamed = mine.where("file_key = ''")
    filed = cut_lineage(mine.where("file_key <> ''").join(per_file, "file_key", "left"), "filed")
    absent = filed.where("n_sheets is null")
    present = filed.where("n_sheets is not null").withColumn(
        "sheet_name", F.when(F.col("sheet_name") != "", F.col("sheet_name")).when(F.col("n_sheets") == 1, F.col("only_sheet")).otherwise(""))
    unclear = present.where("sheet_name = ''")
    located = present.where("sheet_name <> ''").join(sheets.select("file_key", "sheet_name", "table_id", "readable"), ["file_key", "sheet_name"], "left")
    located = cut_lineage(located, "located")
    no_sheet = located.where("table_id is null")
    read = cut_lineage(read_contract(located.where("table_id is not null"), regions), "read")
    unread = read.where("issue is not null").select(F.lit("ERROR").alias("level"), "target_id", "issue")
    empty = read.where("issue is null and readable = 0")

    names = sheets.select("file_key", "file_name").distinct().groupBy("file_key").agg(F.count("*").alias("n")).where("n > 1")
    unused = per_file.select("file_key").join(filed.select("file_key").distinct(), "file_key", "left_anti")
    unknown = mapping.select("target_id").distinct().join(known, "target_id", "left_anti")
    missing = known.join(mapping.select("target_id").distinct(), "target_id", "left_anti").agg(F.count("*").alias("n")).where("n > 0")
    idle = active.agg(F.count("*").alias("n")).where("n = 0")
    issues = [
        issue(nobody(names), "ERROR", "duplicate file name"), issue(unnamed, "ERROR", "file is missing in the row"), issue(absent, "ERROR", "file not found"),
        issue(unclear, "ERROR", "sheet is unclear"), issue(no_sheet, "ERROR", "sheet not found"), unread, issue(empty, "ERROR", "no data"),
        issue(unknown, "WARNING", "unknown id"), issue(nobody(missing), "WARNING", "contracts without a row"), issue(nobody(unused), "WARNING", "file not used"),
        issue(nobody(idle), "ERROR", "nothing is active"),
    ]
    resolved = read.where("issue is null and readable <> 0").select("target_id", "table_id", "cell_range", "range_mode", "allow_growth")
    return reduce(lambda a, b: a.unionByName(b), issues), resolved
