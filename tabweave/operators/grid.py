"""Reading loosely formatted sheets kept as cells.

Every operator works on long cells (table_id, row_ix, col_ix, raw, num, fmt) and
groups by table first, so sheets are read side by side.  Windows run over rows or
columns of one sheet after its cells have been aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import is_period
from ..functions.numbers import parse_number
from ..functions.text import cell_text, norm_label
from .joins import first_by

# How many rows below a header are scored, and the share of periods that makes an axis.
LOOK_AHEAD, PERIOD_SHARE = 4, 0.45
METADATA_ALIASES = {
    "GRAPH ID": "graph_id", "GRAPHID": "graph_id", "ID GRAFICO": "graph_id", "PPT TAG": "ppt_tag", "TAG PPT": "ppt_tag",
    "VARIAVEL": "variable", "VAR ANALISE": "variable",
}
PLAIN_LABELS = ("TOTAL", "SERIE", "SERIES", "CATEGORIA", "CATEGORIAS", "VALOR")
NPS_SHARE = 0.65
# What a series of values, a series and a row are called that have no name.
VALUE_NAME, SERIES_NAME, ROW_NAME = "Valor", "Serie", "Linha"


def typed(cells: DataFrame) -> DataFrame:
    """Non-blank cells with their text, number and normalized text; cells that have them stay as they are."""
    if {"text", "number", "norm"} <= set(cells.columns):
        return cells
    text = cell_text("raw", "num")
    out = cells.withColumn("text", F.when(F.col("num").isNotNull() & (F.coalesce(F.col("raw"), F.lit("")) == "") & (text == ""), F.col("num").cast("string")).otherwise(text))
    return out.where("text <> ''").withColumn("number", F.coalesce("num", parse_number("text"))).withColumn("norm", norm_label("text", plus=False))


def trim_grid(cells: DataFrame) -> DataFrame:
    """Cells shifted to the bounding box of the non-blank ones, with that box."""
    filled = cells.where(F.col("num").isNotNull() | (F.trim(F.coalesce("raw", F.lit(""))) != ""))
    box = filled.groupBy("table_id").agg(
        F.min("row_ix").alias("r0"), F.min("col_ix").alias("c0"), F.max("row_ix").alias("r1"), F.max("col_ix").alias("c1"))
    inside = F.col("row_ix").between(F.col("r0"), F.col("r1")) & F.col("col_ix").between(F.col("c0"), F.col("c1"))
    return cells.join(box, "table_id").where(inside).withColumn("row_ix", F.col("row_ix") - F.col("r0")).withColumn("col_ix", F.col("col_ix") - F.col("c0"))


def table_blocks(cells: DataFrame, key: str = "table_id") -> DataFrame:
    """Blocks of rows divided by blank rows, counted when they have at least two
    rows and two occupied columns.  A block starts at a row whose predecessor is
    blank; cells find their block by the running count of starts."""
    filled = cells.where(F.col("num").isNotNull() | (F.trim(F.coalesce("raw", F.lit(""))) != ""))
    rows = filled.groupBy(key, "row_ix").agg(F.min("col_ix").alias("lo"), F.max("col_ix").alias("hi"))
    w = W.partitionBy(key).orderBy("row_ix")
    start = (F.col("row_ix") - F.lag("row_ix").over(w)).isNull() | (F.col("row_ix") - F.lag("row_ix").over(w) > 1)
    runs = rows.withColumn("run", F.sum(start.cast("int")).over(w)).groupBy(key, "run").agg(
        F.count("*").alias("n_rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # two different occupied columns exist exactly when the extent is more than one wide
    good = (F.col("n_rows") >= 2) & (F.col("hi") > F.col("lo"))
    counted = runs.groupBy(key).agg(F.count_if(good).cast("int").alias("table_blocks"))
    return cells.select(key).distinct().join(counted, key, "left").select(key, F.coalesce("table_blocks", F.lit(0)).alias("table_blocks"))


def header_row(cells: DataFrame) -> DataFrame:
    """(table_id, header_row, start_col, end_col, score) of the best header of the
    whole sheet: many header cells, data in the next four rows of its columns, few
    numbers in it."""
    t = typed(cells)
    is_header = is_period("norm") | F.col("number").isNull()
    rows = t.groupBy("table_id", "row_ix").agg(
        F.count_if(is_header).alias("n_header"), F.min(F.when(is_header, F.col("col_ix"))).alias("first"), F.max(F.when(is_header, F.col("col_ix"))).alias("end_col"),
        F.min(F.when(is_header & (F.col("col_ix") > 0), F.col("col_ix"))).alias("second"), F.max((F.col("col_ix") == 0) & is_period("norm")).alias("period_first"))
    shifted = (F.col("first") == 0) & ~F.col("period_first")
    heads = rows.where("n_header >= 2").select(
        "table_id", F.col("row_ix").alias("header_row"), "n_header", F.when(shifted, F.col("second")).otherwise(F.col("first")).alias("start_col"), "end_col")
    # each header looks at its own row and the next ones
    ahead = heads.withColumn("ahead", F.explode(F.sequence(F.lit(0), F.lit(LOOK_AHEAD)))).withColumn("row_ix", F.col("header_row") + F.col("ahead"))
    points = F.when(F.col("ahead") > 0, F.when(F.col("is_number"), 2).otherwise(0) + 1).otherwise(F.when(F.col("is_number"), -3).otherwise(0))
    scored = (
        ahead.join(t.select("table_id", "row_ix", "col_ix", F.col("number").isNotNull().alias("is_number")), ["table_id", "row_ix"]).withColumn("p", points)
        .where("col_ix between start_col and end_col")
        .groupBy("table_id", "header_row", "n_header", "start_col", "end_col").agg(F.sum("p").alias("p"))
        .withColumn("score", F.col("n_header") + F.col("p")).where("score > -1")
    )
    best = scored.groupBy("table_id").agg(F.max(F.struct("score", -F.col("header_row"), "start_col", "end_col")).alias("b"))
    return best.select("table_id", (-F.col("b.col2")).alias("header_row"), F.col("b.start_col").alias("start_col"), F.col("b.end_col").alias("end_col"), F.col("b.score").alias("score"))


def label_column(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """The column left of the header with the most text labels; the first on ties,
    the neighbour of the header when there is none."""
    left = typed(cells).join(headers.select("table_id", "header_row", "start_col"), "table_id").where("col_ix < start_col and row_ix > header_row and number is null")
    counts = left.groupBy("table_id", "col_ix").agg(F.count("*").alias("n"))
    best = counts.groupBy("table_id").agg(F.max(F.struct("n", -F.col("col_ix"))).alias("b"))
    return headers.join(best, "table_id", "left").select(
        "table_id", F.coalesce(-F.col("b.col2"), F.when(F.col("start_col") > 0, F.col("start_col") - 1)).cast("int").alias("label_col"))


def data_rows(cells: DataFrame, headers: DataFrame, labels: DataFrame) -> DataFrame:
    """(table_id, row_ix, item, label): rows below the header with a value in its
    columns, numbered, and their label or ''."""
    t = typed(cells).join(headers, "table_id").where("row_ix > header_row").join(labels, "table_id")
    inside = F.col("col_ix").between(F.col("start_col"), F.col("end_col"))
    rows = t.groupBy("table_id", "row_ix").agg(
        F.max(inside).alias("has"), F.coalesce(F.max(F.when(F.col("col_ix") == F.col("label_col"), F.col("text"))), F.lit("")).alias("label"))
    w = W.partitionBy("table_id").orderBy("row_ix")
    return rows.where("has").withColumn("item", F.row_number().over(w) - 1).drop("has")


def infer_labels(rows: DataFrame, cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Fill a missing label with NPS when the values so far are mostly shares and
    this row's are mostly not."""
    inside = typed(cells).where("number is not null").join(headers, "table_id").where("row_ix > header_row and col_ix between start_col and end_col")
    stats = inside.groupBy("table_id", "row_ix").agg(
        F.count("*").alias("n"), F.count_if(F.abs("number") <= 1).alias("inside"), F.count_if(F.abs("number") > 1).alias("outside"))
    before = W.partitionBy("table_id").orderBy("row_ix").rowsBetween(W.unboundedPreceding, -1)
    joined = rows.join(stats, ["table_id", "row_ix"], "left").fillna(0, ["n", "inside", "outside"])
    joined = joined.withColumn("_n", F.sum("n").over(before)).withColumn("_in", F.sum("inside").over(before))
    fits = (F.col("label") == "") & (F.col("n") > 0) & (F.col("_n") > 0) & (F.col("_in") >= F.col("_n") * NPS_SHARE) & (F.col("outside") >= F.col("n") * NPS_SHARE)
    return joined.withColumn("label", F.when(F.coalesce(fits, F.lit(False)), "NPS").otherwise(F.col("label"))).select(*rows.columns)


def orientation(cells: DataFrame, headers: DataFrame, rows: DataFrame) -> DataFrame:
    """Orientation of each table from how periodic its header and its labels are."""
    head = typed(cells).join(headers, "table_id").where("row_ix = header_row and col_ix between start_col and end_col").groupBy("table_id").agg(
        F.avg(is_period("norm").cast("double")).alias("head"), F.count("*").alias("n_headers"))
    label = F.when(F.col("label") != "", is_period(norm_label("label", plus=False)).cast("double"))
    side = rows.groupBy("table_id").agg(F.count("*").alias("n_rows"), F.coalesce(F.avg(label), F.lit(0.0)).alias("side"))
    periodic = F.col("head") >= PERIOD_SHARE
    kind = (
        F.when(periodic & (F.coalesce("n_rows", F.lit(0)) == 1), "single_series_row_categories_columns")
        .when(periodic & ~(F.coalesce("side", F.lit(0.0)) >= PERIOD_SHARE), "series_rows_categories_columns").otherwise("categories_rows_series_columns")
    )
    return head.join(side, "table_id", "left").select("table_id", kind.alias("orientation"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "n_headers")


def axis_label(label, item, kind) -> Column:
    """A label, or the numbered stand-in of its orientation."""
    stand_in = (
        F.when(F.col(kind) == "single_series_row_categories_columns", VALUE_NAME)
        .when(F.col(kind) == "series_rows_categories_columns", F.concat(F.lit(f"{SERIES_NAME} "), (F.col(item) + 1).cast("string")))
        .otherwise(F.concat(F.lit(f"{ROW_NAME} "), (F.col(item) + 1).cast("string")))
    )
    return F.when(F.col(label) != "", F.col(label)).otherwise(stand_in)


def key_value(cells: DataFrame) -> DataFrame:
    """The adjacent column pair that reads best as label and value: (table_id,
    row_ix, label, value, number)."""
    t = typed(cells).select("table_id", "row_ix", "col_ix", "text", "number")
    labels = t.where("number is null").select("table_id", "row_ix", F.col("col_ix").alias("label_col"), F.col("text").alias("label"))
    values = t.select("table_id", "row_ix", (F.col("col_ix") - 1).alias("label_col"), F.col("text").alias("value"), "number")
    pairs = labels.join(values, ["table_id", "row_ix", "label_col"], "left")
    score = pairs.groupBy("table_id", "label_col").agg(F.count("*").alias("n"), F.count("value").alias("v")).where("n >= 2 and v >= 1")
    best = score.groupBy("table_id").agg(F.max(F.struct((F.col("n") + F.col("v")).alias("s"), -F.col("label_col"))).alias("b")).select("table_id", (-F.col("b.col2")).alias("label_col"))
    return pairs.join(best, ["table_id", "label_col"]).drop("label_col")


def metadata_pairs(cells: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(table_id, key, value) written as 'KEY: value' or as neighbouring cells
    anywhere in the sheet; the last one wins."""
    aliases = aliases or METADATA_ALIASES
    t = typed(cells).select("table_id", "row_ix", "col_ix", "text")
    right = t.select("table_id", "row_ix", (F.col("col_ix") - 1).alias("col_ix"), F.col("text").alias("next"))
    colon = F.col("text").contains(":")
    key_text = F.when(colon, F.trim(F.regexp_extract("text", "^([^:]*):", 1))).otherwise(F.col("text"))
    value = F.when(colon, F.trim(F.regexp_extract("text", "^[^:]*:(.*)$", 1))).otherwise(F.coalesce("next", F.lit("")))
    lookup = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    pairs = t.join(right, ["table_id", "row_ix", "col_ix"], "left").select(
        "table_id", "row_ix", "col_ix", lookup[norm_label(key_text, plus=False)].alias("key"), value.alias("value")).where("key is not null and value <> ''")
    return pairs.groupBy("table_id", "key").agg(F.max_by("value", F.struct("row_ix", "col_ix")).alias("value"))


def is_context_label(normalized) -> Column:
    n = F.col(normalized) if isinstance(normalized, str) else normalized
    return (F.length(n) >= 4) & ~n.isin(*PLAIN_LABELS) & parse_number(n).isNull()


def context_title(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """The first row above the header that holds one text only, and the first
    leading group label below it."""
    t = typed(cells).join(headers, "table_id")
    alone = t.where("row_ix < header_row").groupBy("table_id", "row_ix").agg(F.count("*").alias("n"), F.min("text").alias("text"), F.min("norm").alias("norm")).where("n = 1")
    title = alone.where(is_context_label("norm")).groupBy("table_id").agg(F.min_by("text", "row_ix").alias("title"))
    longest = t.where("row_ix > header_row and col_ix < start_col").groupBy("table_id", "row_ix").agg(F.max(F.struct(F.length("text").alias("l"), -F.col("col_ix"), "text", "norm")).alias("b"))
    group = longest.where(is_context_label(F.col("b.norm"))).groupBy("table_id").agg(F.min_by("b.text", "row_ix").alias("group_label"))
    return headers.select("table_id").join(title, "table_id", "left").join(group, "table_id", "left")


def dominant_format(cells: DataFrame, keys: list[str], position: list[str]) -> DataFrame:
    """The most frequent meaningful format per key; the earliest on ties."""
    f = F.trim(F.coalesce("fmt", F.lit("")))
    good = cells.withColumn("fmt", f).where(~F.lower("fmt").isin("", "general"))
    counts = good.groupBy(*keys, "fmt").agg(F.count("*").alias("n"), F.min(F.struct(*position)).alias("p"))
    return first_by(counts, keys, F.desc("n"), "p").select(*keys, "fmt")


def range_slice(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Cells inside the range (r0, c0, r1, c1) of their table."""
    return cells.join(ranges, "table_id").where("row_ix between r0 and r1 and col_ix between c0 and c1").select(*cells.columns)


def grow_range(cells: DataFrame, seeds: DataFrame, regions: DataFrame) -> DataFrame:
    """Seed ranges grown to the current data: (table_id, r0, c0, r1, c1).

    A named region that meets the seed sets the end.  Otherwise columns are added
    while the header goes on with periods, then rows while they are filled (and
    labelled, when the seed's first column holds labels).  A period header fills its
    column, so columns never wait for rows and one pass each is enough."""
    t = typed(cells).select("table_id", "row_ix", "col_ix", F.col("num").isNull().alias("is_text"), "number", is_period("norm").alias("period"))
    meets = seeds.alias("s").join(regions.select("table_id", *[F.col(c).alias(f"g_{c}") for c in ("r0", "c0", "r1", "c1")]).alias("g"), "table_id").where(
        "r0 <= g_r1 and g_r0 <= r1 and c0 <= g_c1 and g_c0 <= c1")
    fixed = meets.groupBy("table_id", "r0", "c0", "r1", "c1").agg(F.min(F.struct("g_r0", "g_c0", "g_r1", "g_c1")).alias("g")).select(
        "table_id", "r0", "c0", F.greatest("r1", "g.g_r1").alias("r1"), F.greatest("c1", "g.g_c1").alias("c1"))
    free = seeds.join(fixed.select("table_id"), "table_id", "left_anti")
    seeded = t.join(free, "table_id")
    facts = seeded.groupBy("table_id").agg(
        F.max((F.col("row_ix") == F.col("r0")) & F.col("col_ix").between(F.col("c0"), F.col("c1")) & F.col("period")).alias("periodic"),
        F.count_if((F.col("col_ix") == F.col("c0")) & (F.col("row_ix") > F.col("r0")) & (F.col("row_ix") <= F.col("r1"))).alias("side"),
        F.count_if((F.col("col_ix") == F.col("c0")) & (F.col("row_ix") > F.col("r0")) & (F.col("row_ix") <= F.col("r1")) & F.col("is_text") & F.col("number").isNull()).alias("labels"))
    state = free.join(facts, "table_id", "left").select(
        *free.columns, F.coalesce("periodic", F.lit(False)).alias("periodic"), F.coalesce((F.col("side") > 0) & (F.col("labels") >= F.col("side") * 0.5), F.lit(False)).alias("labelled"))

    # columns right of the range whose header is a period, contiguous from its edge
    heads = t.join(state, "table_id").where("periodic and row_ix = r0 and col_ix > c1 and period")
    wide = heads.groupBy("table_id", "c1").agg(F.array_sort(F.collect_set("col_ix")).alias("xs"))
    wider = state.join(wide.select("table_id", _run_end("xs", "c1").alias("n_c1")), "table_id", "left").withColumn("c1", F.coalesce("n_c1", "c1")).drop("n_c1")
    # rows below, contiguous from its edge
    below = t.join(wider, "table_id").where("row_ix > r1 and col_ix between c0 and c1").groupBy("table_id", "r1", "row_ix").agg(
        F.max(~F.col("labelled") | (F.col("col_ix") == F.col("c0"))).alias("ok")).where("ok")
    w = W.partitionBy("table_id").orderBy("row_ix")
    tall = below.withColumn("gap", F.col("row_ix") - F.col("r1") - F.row_number().over(w)).where("gap = 0").groupBy("table_id").agg(F.max("row_ix").alias("n_r1"))
    grown = wider.join(tall, "table_id", "left").withColumn("r1", F.coalesce("n_r1", "r1"))
    return fixed.unionByName(grown.select("table_id", "r0", "c0", "r1", "c1"))


def _run_end(xs, edge) -> Column:
    """Last of the sorted numbers that continue ``edge`` without a gap."""
    run = F.filter(F.transform(xs, lambda x, i: F.struct(x.alias("x"), (x - i - 1).alias("base"))), lambda s: s["base"] == F.col(edge))
    return F.coalesce(F.array_max(F.transform(run, lambda s: s["x"])), F.col(edge))


def compact_dump(cells: DataFrame, limit: int = 800) -> DataFrame:
    """(table_id, row_ix, line) of the first cells in reading order as JSON lists,
    and how many cells were left out.  The cap is the feature: it bounds the dump."""
    w = W.partitionBy("table_id").orderBy("row_ix", "col_ix")
    total = cells.groupBy("table_id").agg(F.count("*").alias("total"))
    head = cells.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)
    item = F.struct("col_ix", F.coalesce(F.col("raw"), F.col("num").cast("string")).alias("v"), F.when(~F.lower("fmt").isin("", "general"), F.col("fmt")).alias("fmt"))
    lines = head.groupBy("table_id", "row_ix").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("line"), F.count("*").alias("n_cells"))
    return lines.join(total, "table_id").select("table_id", "row_ix", "line", "n_cells", F.greatest(F.col("total") - limit, F.lit(0)).alias("omitted"))


# --- reshaping ----------------------------------------------------------------------------


def unpivot_matrix(wide: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return wide.unpivot(keys, columns, "label", "value").where("value is not null")


def transpose_cells(cells: DataFrame) -> DataFrame:
    return cells.withColumn("_r", F.col("col_ix")).withColumn("col_ix", F.col("row_ix")).withColumn("row_ix", F.col("_r")).drop("_r")


def pad_grid(cells: DataFrame, shapes: DataFrame) -> DataFrame:
    """The full grid of each table in ``shapes`` (n_rows, n_cols), blanks as null."""
    grid = shapes.withColumn("row_ix", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1))).withColumn("col_ix", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)))
    return grid.select("table_id", "row_ix", "col_ix").join(cells, ["table_id", "row_ix", "col_ix"], "left")


# What a recipe may do.
RECIPES = ("keep", "transpose", "drop_and_keep", "drop_and_transpose", "unknown")


def apply_recipe(cells: DataFrame, recipes: DataFrame) -> DataFrame:
    """Drop leading rows and columns and transpose as each table's recipe says;
    an operation outside the vocabulary leaves the table as it is."""
    known = F.when(F.col("operation").isin(*RECIPES), F.col("operation")).otherwise("unknown")
    r = recipes.select("table_id", known.alias("op"), F.greatest(F.coalesce("drop_rows", F.lit(0)), F.lit(0)).alias("dr"), F.greatest(F.coalesce("drop_cols", F.lit(0)), F.lit(0)).alias("dc"))
    drops = F.col("op").startswith("drop")
    j = cells.join(r, "table_id").withColumn("dr", F.when(drops, F.col("dr")).otherwise(0)).withColumn("dc", F.when(drops, F.col("dc")).otherwise(0))
    j = j.where("row_ix >= dr and col_ix >= dc").withColumn("_r", F.col("row_ix") - F.col("dr")).withColumn("_c", F.col("col_ix") - F.col("dc"))
    turn = F.col("op").endswith("transpose")
    return j.withColumn("row_ix", F.when(turn, F.col("_c")).otherwise(F.col("_r")).cast("int")).withColumn("col_ix", F.when(turn, F.col("_r")).otherwise(F.col("_c")).cast("int")).select(*cells.columns)


def thousands_flag(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Tables whose numbers are mostly whole and at least a thousand."""
    big = ((F.abs("num") >= 1000) & (F.col("num") == F.floor("num"))).cast("double")
    return cells.where("num is not null").groupBy(*keys).agg((F.avg(big) >= 0.8).alias("thousands"))
