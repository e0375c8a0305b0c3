"""Aligning a source table with the axes of a contract.

Axes are long: one row for each label, with its contract, axis and place.  Labels find their choices contract by contract
(``labels.map_labels``); order, growth and places are joins and windows over these rows, and values stay in long cells that are
joined to the aligned axes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import is_meaningful_format
from ..functions.text import norm_label, series_key
from ..session import cut_lineage
from .labels import map_labels

SERIES_ROWS = "series_rows_categories_columns"
_SOURCE_SERIES_ROWS = (SERIES_ROWS, "single_series_row_categories_columns")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normed(labels) -> Column:
    return F.transform(_c(labels), lambda v: norm_label(v))


def source_axes(df: DataFrame) -> DataFrame:
    """source_rows and source_cols of each table by its orientation."""
    by_series = F.col("source_orientation").isin(*_SOURCE_SERIES_ROWS)
    return df.withColumn("source_rows", F.when(by_series, F.col("source_series")).otherwise(F.col("source_categories"))).withColumn(
        "source_cols", F.when(by_series, F.col("source_categories")).otherwise(F.col("source_series")))


@dataclass(frozen=True)
class Aligned:
    """``modes``: (target_id, table_id, mode, allow_growth) of each contract.  ``maps``: (target_id, axis, ix, label, choice), the source label that
    each label of the contract takes.  ``axes``: (target_id, axis, ix, label, shown, at), the final axes in order, the text each
    label is shown as and its place on the source's axis, null where the source has none."""

    modes: DataFrame
    maps: DataFrame
    axes: DataFrame


def fill_blank_labels(labels: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """``labels`` (keys, ix, label) with blank ones replaced by unused ``candidates`` (keys, ix, label) in order, an NPS one first.  The k-th blank takes
    the k-th candidate with a text of its own; groups without blanks pass through untouched."""
    key = norm_label("label")
    at = W.partitionBy(*keys).orderBy("ix")
    blanks = labels.where(key == "")
    pool = candidates.join(blanks.select(*keys).distinct(), keys, "left_semi").select(*keys, "ix", "label", key.alias("n")).where("n <> ''")
    pool = pool.join(labels.select(*keys, key.alias("n")).where("n <> ''"), [*keys, "n"], "left_anti")
    pool = pool.groupBy(*keys, "n").agg(F.min(F.struct("ix", "label")).alias("c"))
    order = W.partitionBy(*keys).orderBy((F.col("n") != "NPS").cast("int"), "c.ix")
    pool = pool.select(*keys, F.row_number().over(order).alias("nth"), F.col("c.label").alias("taken"))
    filled = blanks.withColumn("nth", F.row_number().over(at)).join(pool, [*keys, "nth"], "left")
    return labels.where(key != "").unionByName(filled.withColumn("label", F.coalesce("taken", "label")).select(*labels.columns))


def pair_labels(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contracts' and sources' labels (target_id, kind, ix, label) of pairs whose axes are arrays; kind is 'c' or 's'."""
    side = lambda c, s: pairs.select("target_id", F.lit("c").alias("kind"), F.posexplode(c).alias("ix", "label")).unionByName(
        pairs.select("target_id", F.lit("s").alias("kind"), F.posexplode(s).alias("ix", "label")))
    return side("categories", "series"), side("source_categories", "source_series")


def both_axes(pairs: DataFrame, wanted: DataFrame, source: DataFrame) -> DataFrame:
    """(target_id, side, axis, ix, label) of contracts and their sources.  Blank labels of a contract take unused ones of its source, the same axis
    first, and an axis it does not name is the source's own."""
    other = source.withColumn("of", F.when(F.col("kind") == "c", "s").otherwise("c"))
    own_first = other.select("target_id", "kind", F.struct(F.lit(0), "ix").alias("ix"), "label").unionByName(
        other.select("target_id", F.col("of").alias("kind"), F.struct(F.lit(1), "ix").alias("ix"), "label"))
    wanted = fill_blank_labels(wanted, own_first, ["target_id", "kind"])
    by_series = pairs.select(
        "target_id", (F.col("orientation") == SERIES_ROWS).alias("t"), F.col("source_orientation").isin(*_SOURCE_SERIES_ROWS).alias("s"))
    axis = lambda flag: F.when(F.col(flag) == (F.col("kind") == "s"), "row").otherwise("col")
    sources = source.join(by_series, "target_id").select("target_id", F.lit("s").alias("side"), axis("s").alias("axis"), "ix", "label")
    targets = wanted.join(by_series, "target_id").select("target_id", F.lit("t").alias("side"), axis("t").alias("axis"), "ix", "label")
    missing = sources.join(targets.select("target_id", "axis").distinct(), ["target_id", "axis"], "left_anti").withColumn("side", F.lit("t"))
    return targets.unionByName(missing).unionByName(sources)


def _placed(labels: DataFrame) -> DataFrame:
    """First and last place of each text on an axis: (target_id, axis, key, first, last)."""
    return labels.groupBy("target_id", "axis", norm_label("label").alias("key")).agg(F.min("ix").alias("first"), F.max("ix").alias("last"))


def source_order(maps: DataFrame, placed: DataFrame) -> DataFrame:
    """(target_id, axis, ix, label) in the order of the source labels they map to, unmapped ones last.  A label that occurs twice follows its last entry."""
    key = norm_label(F.coalesce(F.nullif("choice", F.lit("")), F.col("label")))
    last = maps.groupBy("target_id", "axis", "label").agg(F.max_by("choice", "ix").alias("choice")).withColumn("key", key)
    at = last.join(placed, ["target_id", "axis", "key"], "left").select("target_id", "axis", "label", F.col("last").alias("at"))
    order = W.partitionBy("target_id", "axis").orderBy(F.col("at").asc_nulls_last(), "ix")
    return maps.select("target_id", "axis", "ix", "label").join(at, ["target_id", "axis", "label"]).select(
        "target_id", "axis", (F.row_number().over(order) - 1).alias("ix"), "label")


def grow_axis(ordered: DataFrame, maps: DataFrame, source: DataFrame) -> DataFrame:
    """Source labels in order, each under the contract's own name when it has one, then the contract's remaining labels; each text once."""
    named = maps.select("target_id", "axis", "ix", norm_label("choice").alias("key"), F.col("label").alias("own")).where("key <> ''")
    named = named.groupBy("target_id", "axis", "key").agg(F.max_by("own", "ix").alias("own"))
    first = source.withColumn("key", norm_label("label")).join(named, ["target_id", "axis", "key"], "left").select(
        "target_id", "axis", F.lit(0).alias("part"), "ix", F.coalesce("own", "label").alias("label"))
    every = first.unionByName(ordered.select("target_id", "axis", F.lit(1).alias("part"), "ix", "label"))
    once = every.groupBy("target_id", "axis", norm_label("label").alias("key")).agg(F.min(F.struct("part", "ix", "label")).alias("v")).where("key <> ''")
    order = W.partitionBy("target_id", "axis").orderBy("v.part", "v.ix")
    return once.select("target_id", "axis", (F.row_number().over(order) - 1).alias("ix"), F.col("v.label").alias("label"))


def align_labels(pairs: DataFrame, labels: DataFrame, forced: str | None = None) -> Aligned:
    """Aligned axes of ``pairs`` (target_id, table_id, orientation, allow_growth) from the ``labels`` of both sides (see ``both_axes``)."""
    solved = cut_lineage(map_labels(labels, forced), "label-map")
    modes = pairs.select("target_id", "table_id", "orientation", F.coalesce("allow_growth", F.lit(False)).alias("allow_growth")).join(
        solved.where("axis is null").select("target_id", "mode"), "target_id", "left").withColumn("mode", F.coalesce("mode", F.lit("same")))
    modes = cut_lineage(modes, "modes")
    maps = solved.where("axis is not null").select("target_id", "axis", "ix", "label", "choice")
    turned = F.when(F.col("mode") == "cross", F.when(F.col("axis") == "row", "col").otherwise("row")).otherwise(F.col("axis"))
    source = cut_lineage(labels.where("side = 's'").join(modes.select("target_id", "mode"), "target_id").select("target_id", turned.alias("axis"), "ix", "label"), "source-axes")
    placed = _placed(source)
    ordered = source_order(maps, placed)
    grows = modes.where("allow_growth").select("target_id", F.when(F.col("orientation") == SERIES_ROWS, "col").otherwise("row").alias("axis"))
    both = ["target_id", "axis"]
    grown = grow_axis(ordered.join(grows, both, "left_semi"), maps.join(grows, both, "left_semi"), source.join(grows, both, "left_semi"))
    final = ordered.join(grows, both, "left_anti").unionByName(grown)
    last = maps.groupBy(*both, "label").agg(F.max_by("choice", "ix").alias("choice"), F.lit(True).alias("known"))
    named = final.join(last, [*both, "label"], "left").withColumn("key", norm_label(F.when(F.col("known"), F.col("choice")).otherwise(F.col("label"))))
    axes = named.join(placed.select(*both, "key", F.col("first").alias("at")), [*both, "key"], "left").select(
        *both, "ix", "label", F.coalesce(F.nullif("choice", F.lit("")), "label").alias("shown"), "at")
    return Aligned(modes.select("target_id", "table_id", "mode", "allow_growth"), maps, cut_lineage(axes, "axes"))


def align(pairs: DataFrame, forced: str | None = None) -> Aligned:
    """Aligned axes of pairs that hold one row per contract with orientation, categories, series and source_orientation,
    source_categories, source_series, allow_growth."""
    wanted, source = pair_labels(pairs)
    return align_labels(pairs, cut_lineage(both_axes(pairs, wanted, source), "pair-labels"), forced)


def dense_fill(aligned: Aligned, values: DataFrame) -> DataFrame:
    """Every cell of the aligned matrices: (target_id, table_id, row_ix, col_ix, row_label, col_label, value).  Cells come from each contract's own axes; values are looked
    up by one join on the source position."""
    side = lambda axis: aligned.axes.where(F.col("axis") == axis).select(
        "target_id", F.col("ix").alias(f"{axis}_ix"), F.col("shown").alias(f"{axis}_label"), F.col("at").alias(f"{axis}_at"))
    grid = aligned.modes.join(side("row"), "target_id").join(side("col"), "target_id")
    cross = F.col("mode") == "cross"
    turned = lambda a, b: F.when(cross, F.col(b)).otherwise(F.col(a))
    placed = grid.select("target_id", "table_id", "row_ix", "col_ix", "row_label", "col_label", turned("row_at", "col_at").alias("s_row"), turned("col_at", "row_at").alias("s_col"))
    v = values.select("table_id", F.col("row_ix").alias("s_row"), F.col("col_ix").alias("s_col"), F.col("num").alias("value"))
    return placed.join(v, ["table_id", "s_row", "s_col"], "left").select("target_id", "table_id", "row_ix", "col_ix", "row_label", "col_label", "value")


def fill_warnings(cells: DataFrame) -> DataFrame:
    """Contracts whose matrix has a value the source does not hold."""
    return cells.groupBy("target_id").agg(F.count_if(F.col("value").isNull()).alias("missing")).where("missing > 0")


# --- tables ----------------------------------------------------------------------------------


def adaptive_table(pairs: DataFrame) -> DataFrame:
    """Whether a table contract has a header row and a label column.

    Needs first_row, first_col (arrays of texts), later_filled, width and the
    source's headers, row_labels and data width."""
    keep = lambda c: F.filter(normed(c), lambda v: v != "")
    first, heads, labels = keep("first_row"), F.array_distinct(keep("headers")), keep("row_labels")
    matches = F.size(F.filter(first, lambda v: F.array_contains(heads, v)))
    comparable = F.least(F.size(first), F.size(heads))
    overlap = (F.size(first) > 0) & (F.size(heads) > 0) & (matches >= F.greatest(F.lit(1), F.floor((comparable + 1) / 2)))
    header = (F.size("headers") > 0) & (overlap | ((F.col("n_target_rows") >= 2) & (F.size(first) > 0) & ~F.col("later_filled")))
    df = pairs.withColumn("has_header", header)
    column = keep(F.when(F.col("has_header"), F.slice("first_col", 2, 1 << 30)).otherwise(F.col("first_col")))
    named = F.exists(column, lambda v: F.array_contains(labels, v))
    return df.withColumn("has_labels", (F.size("row_labels") > 1) | (F.col("width") == F.size("headers") + 1) | named)


def key_value_fill(template: DataFrame, source: DataFrame, best: DataFrame) -> DataFrame:
    """Rows of a key-value table: template rows no source label resembles first,
    then the source rows, both in order.  ``best`` holds (target_id, ix, score,
    shares_word) of each template row's best source label."""
    alone = template.join(best, ["target_id", "ix"], "left").where(
        (F.coalesce("score", F.lit(0.0)) < 0.68) & ~F.coalesce("shares_word", F.lit(False)))
    rows = alone.select("target_id", F.lit(0).alias("part"), "ix", "label", "value").unionByName(
        source.select("target_id", F.lit(1).alias("part"), "ix", "label", F.coalesce("value", F.lit("")).alias("value")))
    return rows


# --- formats ---------------------------------------------------------------------------------

# The formats a mode falls back to, and words that hint a share.
PERCENT_FORMAT, DECIMAL_FORMAT = "0%", "0.0"
PERCENT_WORDS = ("percent", "share", "taxa", "proporcao")


def uniform_format(formats) -> Column:
    """The first meaningful format when all of them mean the same; else ''."""
    good = F.filter(F.transform(_c(formats), lambda f: F.trim(f)), lambda f: is_meaningful_format(f))
    same = F.array_distinct(F.transform(good, lambda f: F.when(f.contains("%"), "percent").otherwise(F.regexp_replace(f, "[^0#?.,]", ""))))
    return F.when(F.size(same) == 1, F.get(good, F.lit(0))).otherwise("")


def _by_label(label, index, labels, formats, same_size) -> Column:
    keys = F.transform(_c(labels), lambda v: series_key(v))
    at = F.when(series_key(label) != "", F.nullif(F.array_position(keys, series_key(label)), F.lit(0)))
    named = F.get(_c(formats), at.cast("int") - 1)
    return F.coalesce(named, F.when(same_size, F.get(_c(formats), _c(index))), F.lit(""))


def format_cascade(series: DataFrame) -> DataFrame:
    """Format of each planned series: the contract's by label, the contract's own,
    the source's by label, a uniform source format, the plan's; else inferred; then
    the chosen mode (percent, number, auto).

    One row per series: label, ix, n_series, target_labels, target_formats,
    value_format, source_labels, source_formats, plan_format, max_abs, mode."""
    own = F.when(F.exists("target_formats", lambda f: is_meaningful_format(f)), "").otherwise(F.coalesce("value_format", F.lit("")))
    steps = [
        _by_label(F.col("label"), "ix", "target_labels", "target_formats", F.size("target_labels") == F.col("n_series")), own,
        _by_label(F.col("label"), "ix", "source_labels", "source_formats", F.size("source_labels") == F.col("n_series")),
        uniform_format("source_formats"), F.when(F.col("plan_format") != "thousands_pt_br", F.col("plan_format")),
    ]
    hint = F.lit(False)
    for word in PERCENT_WORDS:
        hint = hint | series_key("label").contains(word)
    inferred = F.when(hint & (F.col("max_abs") <= 1), PERCENT_FORMAT).otherwise(DECIMAL_FORMAT)
    found = F.filter(F.array(*steps), lambda f: f.isNotNull() & is_meaningful_format(f))
    automatic = F.coalesce(F.get(found, F.lit(0)), inferred)
    share = F.col("automatic").contains("%")
    chosen = (
        F.when((F.col("mode") == "percent") & ~share, PERCENT_FORMAT).when((F.col("mode") == "number") & share, DECIMAL_FORMAT).otherwise(F.col("automatic"))
    )
    return series.withColumn("automatic", automatic).withColumn("format", chosen).withColumn("shown_as", F.when(F.col("format").contains("%"), "Percentual").otherwise("Número"))
