"""Prepared mapping rows: coercion and strict checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.choices import ORIENTATIONS, READ_MODES, VALUE_FORMATS, normalize_choice
from ..functions.numbers import active_flag
from ..functions.text import base_name

_CHOICES = {"read_mode": READ_MODES, "orientation": ORIENTATIONS, "value_format": VALUE_FORMATS}


def load_mapping(raw: DataFrame) -> DataFrame:
    """Mapping rows with an id, typed: flag, file and sheet, and choices with
    their validity."""
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    file_ref = F.replace(text("file_name"), F.lit("\\"), F.lit("/"))
    named = F.split_part(file_ref, F.lit("#"), F.lit(1))
    embedded = F.trim(F.when(file_ref.contains("#"), F.regexp_extract(file_ref, "#(.*)$", 1)).otherwise(""))
    out = raw.where(text("target_id") != "").select(
        text("target_id").alias("target_id"),
        active_flag("active").alias("active"),
        base_name(named).alias("file_name"),
        F.when(text("sheet_name") != "", text("sheet_name")).otherwise(embedded).alias("sheet_name"),
        F.replace(text("reference"), F.lit("$"), F.lit("")).alias("reference"),
        *[normalize_choice(c, allowed).alias(c) for c, allowed in _CHOICES.items()],
    )
    return out.select(
        "target_id", "active", "file_name", "sheet_name", "reference",
        *[F.col(c)["value"].alias(c) for c in _CHOICES],
        *[F.col(c)["valid"].alias(f"{c}_valid") for c in _CHOICES],
    )


def mapping_checks(mapping: DataFrame, required: tuple[str, ...] = ("target_id", "active")) -> DataFrame:
    """Issues of loaded mapping rows: (target_id, issue, n).  One aggregate over
    the target id finds the duplicates; the other checks ride along."""
    missing = [c for c in required if c not in mapping.columns]
    if missing:
        raise ValueError(f"mapping lacks columns: {', '.join(missing)}")
    bad = lambda c: F.count_if(~F.col(c))
    counts = mapping.groupBy("target_id").agg(
        F.count("*").alias("duplicate_id"),
        F.count_if(F.col("active").isNull()).alias("bad_active"),
        *[bad(f"{c}_valid").alias(f"bad_{c}") for c in _CHOICES],
    ).withColumn("duplicate_id", F.when(F.col("duplicate_id") > 1, F.col("duplicate_id")).otherwise(0))
    names = ["duplicate_id", "bad_active", *[f"bad_{c}" for c in _CHOICES]]
    return counts.unpivot("target_id", names, "issue", "n").where("n > 0")
