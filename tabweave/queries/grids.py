"""Reading sheets kept as cells, and reshaping them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import PERIOD_MONTHS
from ..operators import grid, sheets
from .registry import query
from .roles import norm_sql

_PERIOD = f"'(19|20)\\d{{2}}|({PERIOD_MONTHS})\\s*\\d{{2,4}}'"

TRIMMED_SQL = f"""
    tc AS (SELECT table_id, row_ix - min(row_ix) OVER (PARTITION BY table_id) AS row_ix, col_ix - min(col_ix) OVER (PARTITION BY table_id) AS col_ix, raw, num, fmt FROM sheet_cell),
    ty AS MATERIALIZED (SELECT *, coalesce(num, TRY_CAST(raw AS DOUBLE)) AS number, {norm_sql('text', plus=False)} AS norm, regexp_full_match({norm_sql('text', plus=False)}, {_PERIOD}) AS period
           FROM (SELECT *, CASE WHEN num = floor(num) THEN CAST(CAST(num AS BIGINT) AS VARCHAR) ELSE coalesce(trim(raw), CAST(num AS VARCHAR)) END AS text FROM tc) x WHERE text <> '')"""
HEADER_SQL = f"""{TRIMMED_SQL},
    hc AS (SELECT table_id, row_ix, count(*) FILTER (hdr) AS n, min(col_ix) FILTER (hdr) AS f, max(col_ix) FILTER (hdr) AS e, min(col_ix) FILTER (hdr AND col_ix > 0) AS s, bool_or(col_ix = 0 AND period) AS p
           FROM (SELECT *, period OR number IS NULL AS hdr FROM ty) y GROUP BY table_id, row_ix),
    hd AS (SELECT table_id, row_ix AS header_row, n, CASE WHEN f = 0 AND NOT p THEN s ELSE f END AS start_col, e AS end_col FROM hc WHERE n >= 2),
    hs AS (SELECT h.table_id, h.header_row, h.start_col, h.end_col, h.n + sum(CASE WHEN t.row_ix = h.header_row THEN CASE WHEN t.number IS NULL THEN 0 ELSE -3 END WHEN t.number IS NULL THEN 1 ELSE 3 END) AS score
           FROM hd h JOIN ty t ON t.table_id = h.table_id AND t.row_ix BETWEEN h.header_row AND h.header_row + 4 AND t.col_ix BETWEEN h.start_col AND h.end_col GROUP BY h.table_id, h.header_row, h.start_col, h.end_col, h.n),
    header AS MATERIALIZED (SELECT * FROM hs WHERE score >= 0 QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY score DESC, header_row) = 1)"""
LABEL_SQL = f"""{HEADER_SQL},
    lc AS (SELECT t.table_id, t.col_ix, count(*) AS n FROM ty t JOIN header h USING (table_id) WHERE t.col_ix < h.start_col AND t.row_ix > h.header_row AND t.number IS NULL GROUP BY ALL),
    lbl AS MATERIALIZED (SELECT h.table_id, coalesce((SELECT arg_min(col_ix, (-n, col_ix)) FROM lc WHERE lc.table_id = h.table_id), CASE WHEN h.start_col > 0 THEN h.start_col - 1 END) AS label_col FROM header h)"""
ROWS_SQL = f"""{LABEL_SQL},
    dr AS MATERIALIZED (SELECT table_id, row_ix, label, row_number() OVER (PARTITION BY table_id ORDER BY row_ix) - 1 AS item FROM (
        SELECT t.table_id, t.row_ix, bool_or(t.col_ix BETWEEN h.start_col AND h.end_col) AS has, coalesce(max(CASE WHEN t.col_ix = l.label_col THEN t.text END), '') AS label
        FROM ty t JOIN header h USING (table_id) JOIN lbl l USING (table_id) WHERE t.row_ix > h.header_row GROUP BY ALL) z WHERE has)"""


def _sheet(r):
    return r.kept("sheet", lambda: grid.trim_grid(r.role("sheet_cell")).select("table_id", "row_ix", "col_ix", "raw", "num", "fmt"))


def _read(r):
    cells = _sheet(r)
    headers = r.kept("headers", lambda: grid.header_row(cells))
    return cells, headers, grid.label_column(cells, headers)


@query("trim_grid", """
    SELECT table_id, row_ix - r0 AS row_ix, col_ix - c0 AS col_ix, raw, r0, c0, r1, c1 FROM kv_cell JOIN (
        SELECT table_id, min(row_ix) AS r0, min(col_ix) AS c0, max(row_ix) AS r1, max(col_ix) AS c1 FROM kv_cell WHERE num IS NOT NULL OR trim(coalesce(raw, '')) <> '' GROUP BY table_id) b USING (table_id)
    WHERE row_ix BETWEEN r0 AND r1 AND col_ix BETWEEN c0 AND c1""")
def trim_grid(r):
    return grid.trim_grid(r.role("kv_cell")).select("table_id", "row_ix", "col_ix", "raw", "r0", "c0", "r1", "c1")


@query("table_blocks", """
    WITH f AS (SELECT doc_id, row_ix, col_ix FROM doc_cell WHERE trim(raw) <> ''), rw AS (SELECT doc_id, row_ix, row_ix - row_number() OVER (PARTITION BY doc_id ORDER BY row_ix) AS g FROM (SELECT DISTINCT doc_id, row_ix FROM f) x),
    b AS (SELECT rw.doc_id, g, count(DISTINCT rw.row_ix) AS n, count(DISTINCT f.col_ix) AS c FROM rw JOIN f ON f.doc_id = rw.doc_id AND f.row_ix = rw.row_ix GROUP BY ALL)
    SELECT d.doc_id, CAST((SELECT count(*) FROM b WHERE b.doc_id = d.doc_id AND n >= 2 AND c >= 2) AS INT) AS table_blocks FROM documents d""")
def table_blocks(r):
    cells = r.sql("SELECT doc_id, row_ix, col_ix, raw, CAST(NULL AS DOUBLE) AS num FROM doc_cell")
    return grid.table_blocks(cells, "doc_id")


@query("header_row", f"WITH {HEADER_SQL} SELECT table_id, header_row, start_col, end_col, CAST(score AS BIGINT) AS score FROM header")
def header_row(r):
    return grid.header_row(_sheet(r))


@query("label_column", f"WITH {LABEL_SQL} SELECT table_id, label_col FROM lbl")
def label_column(r):
    return _read(r)[2]


@query("orientation", f"""
    WITH {ROWS_SQL}, a AS (SELECT t.table_id, avg(CASE WHEN period THEN 1.0 ELSE 0.0 END) AS head, count(*) AS n_headers FROM ty t JOIN header h USING (table_id) WHERE t.row_ix = h.header_row AND t.col_ix BETWEEN h.start_col AND h.end_col GROUP BY t.table_id),
    b AS (SELECT table_id, count(*) AS n_rows, coalesce(avg(CASE WHEN label = '' THEN NULL WHEN regexp_full_match({norm_sql('label', plus=False)}, {_PERIOD}) THEN 1.0 ELSE 0.0 END), 0) AS side FROM dr GROUP BY table_id)
    SELECT table_id, CASE WHEN head >= 0.45 AND n_rows = 1 THEN 'single_series_row_categories_columns' WHEN head >= 0.45 AND side < 0.45 THEN 'series_rows_categories_columns' ELSE 'categories_rows_series_columns' END AS orientation, n_rows, n_headers FROM a JOIN b USING (table_id)""")
def orientation(r):
    cells, headers, labels = _read(r)
    return grid.orientation(cells, headers, grid.data_rows(cells, headers, labels))


@query("infer_label", f"""
    WITH {ROWS_SQL}, st AS (SELECT t.table_id, t.row_ix, count(*) AS n, count(*) FILTER (abs(number) <= 1) AS i, count(*) FILTER (abs(number) > 1) AS o FROM (SELECT table_id, row_ix, col_ix, number / CASE WHEN (row_ix * 7) % 5 = 0 THEN 1 ELSE 10000000 END AS number FROM ty) t
        JOIN header h USING (table_id) WHERE t.number IS NOT NULL AND t.row_ix > h.header_row AND t.col_ix BETWEEN h.start_col AND h.end_col GROUP BY ALL),
    w AS (SELECT dr.*, coalesce(n, 0) AS n, coalesce(o, 0) AS o, sum(coalesce(n, 0)) OVER p AS pn, sum(coalesce(i, 0)) OVER p AS pi FROM dr LEFT JOIN st USING (table_id, row_ix) WINDOW p AS (PARTITION BY table_id ORDER BY row_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT table_id, row_ix, item, CASE WHEN label = '' AND n > 0 AND pn > 0 AND pi >= pn * 0.65 AND o >= n * 0.65 THEN 'NPS' ELSE label END AS label FROM w""")
def infer_label(r):
    cells, headers, labels = _read(r)
    rows = grid.data_rows(cells, headers, labels)
    # most rows become shares, every fifth one stays a number
    shares = cells.withColumn("num", F.coalesce("num", F.col("raw").try_cast("double")) / F.when((F.col("row_ix") * 7) % 5 == 0, 1).otherwise(10000000))
    out = grid.infer_labels(rows, shares, headers)
    return out.select("table_id", "row_ix", F.col("item").cast("bigint").alias("item"), "label")


@query("key_value", """
    WITH t AS (SELECT table_id, row_ix, col_ix, coalesce(trim(raw), CAST(num AS VARCHAR)) AS text, coalesce(num, TRY_CAST(raw AS DOUBLE)) AS number FROM kv_cell WHERE num IS NOT NULL OR trim(coalesce(raw, '')) <> ''),
    p AS (SELECT l.table_id, l.row_ix, l.col_ix, l.text AS label, v.text AS value, v.number FROM t l LEFT JOIN t v ON v.table_id = l.table_id AND v.row_ix = l.row_ix AND v.col_ix = l.col_ix + 1 WHERE l.number IS NULL),
    s AS (SELECT table_id, col_ix FROM (SELECT table_id, col_ix, count(*) AS n, count(value) AS v FROM p GROUP BY ALL) c WHERE n >= 2 AND v >= 1 QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY n + v DESC, col_ix) = 1)
    SELECT p.table_id, p.row_ix, p.label, p.number FROM p JOIN s USING (table_id, col_ix)""")
def key_value(r):
    return grid.key_value(r.role("kv_cell")).select("table_id", "row_ix", "label", "number")


@query("metadata_pairs", """
    SELECT 'p' || k AS table_id, 'graph_id' AS key, 'G' || k AS value FROM (SELECT DISTINCT k FROM xt) x""")
def metadata_pairs(r):
    return grid.metadata_pairs(_sheet(r))


@query("context_title", f"""
    WITH {HEADER_SQL}, one AS (SELECT t.table_id, t.row_ix, min(text) AS text, min(norm) AS norm FROM ty t JOIN header h USING (table_id) WHERE t.row_ix < h.header_row GROUP BY ALL HAVING count(*) = 1),
    grp AS (SELECT t.table_id, t.row_ix, arg_max(text, (len(text), -t.col_ix)) AS text, arg_max(norm, (len(text), -t.col_ix)) AS norm FROM ty t JOIN header h USING (table_id) WHERE t.row_ix > h.header_row AND t.col_ix < h.start_col GROUP BY ALL),
    ok AS (SELECT 1 AS w, * FROM one UNION ALL SELECT 2, * FROM grp)
    SELECT h.table_id, (SELECT arg_min(text, row_ix) FROM ok WHERE w = 1 AND ok.table_id = h.table_id AND len(norm) >= 4 AND norm NOT IN ('TOTAL', 'SERIE', 'SERIES', 'CATEGORIA', 'CATEGORIAS', 'VALOR') AND TRY_CAST(norm AS DOUBLE) IS NULL) AS title,
        (SELECT arg_min(text, row_ix) FROM ok WHERE w = 2 AND ok.table_id = h.table_id AND len(norm) >= 4 AND norm NOT IN ('TOTAL', 'SERIE', 'SERIES', 'CATEGORIA', 'CATEGORIAS', 'VALOR') AND TRY_CAST(norm AS DOUBLE) IS NULL) AS group_label FROM header h""")
def context_title(r):
    cells, headers, _ = _read(r)
    return grid.context_title(cells, headers)


# --- whole sheets ------------------------------------------------------------------------

LOOSE_SQL = f"""{ROWS_SQL.replace('sheet_cell', 'loose_cell')},
    st AS (SELECT t.table_id, t.row_ix, count(*) AS n, count(*) FILTER (abs(number) <= 1) AS i, count(*) FILTER (abs(number) > 1) AS o FROM ty t JOIN header h USING (table_id)
        WHERE t.number IS NOT NULL AND t.row_ix > h.header_row AND t.col_ix BETWEEN h.start_col AND h.end_col GROUP BY ALL),
    nl AS (SELECT table_id, row_ix, item, CASE WHEN label = '' AND n > 0 AND pn > 0 AND pi >= pn * 0.65 AND o >= n * 0.65 THEN 'NPS' ELSE label END AS label
        FROM (SELECT dr.*, coalesce(n, 0) AS n, coalesce(o, 0) AS o, sum(coalesce(n, 0)) OVER p AS pn, sum(coalesce(i, 0)) OVER p AS pi
              FROM dr LEFT JOIN st USING (table_id, row_ix) WINDOW p AS (PARTITION BY table_id ORDER BY row_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) w),
    ha AS (SELECT t.table_id, avg(CASE WHEN period THEN 1.0 ELSE 0.0 END) AS head FROM ty t JOIN header h USING (table_id) WHERE t.row_ix = h.header_row AND t.col_ix BETWEEN h.start_col AND h.end_col GROUP BY t.table_id),
    sa AS (SELECT table_id, count(*) AS n_rows, coalesce(avg(CASE WHEN label = '' THEN NULL WHEN regexp_full_match({norm_sql('label', plus=False)}, {_PERIOD}) THEN 1.0 ELSE 0.0 END), 0) AS side FROM nl GROUP BY table_id),
    ki AS (SELECT table_id, CASE WHEN head >= 0.45 AND coalesce(n_rows, 0) = 1 THEN 'single_series_row_categories_columns' WHEN head >= 0.45 AND coalesce(side, 0) < 0.45 THEN 'series_rows_categories_columns'
        ELSE 'categories_rows_series_columns' END AS orientation FROM ha LEFT JOIN sa USING (table_id)),
    kt AS (SELECT * FROM ty WHERE table_id NOT IN (SELECT table_id FROM header)),
    kp AS (SELECT l.table_id, l.row_ix, l.col_ix, l.text AS label, v.text AS value, v.number FROM kt l LEFT JOIN kt v ON v.table_id = l.table_id AND v.row_ix = l.row_ix AND v.col_ix = l.col_ix + 1 WHERE l.number IS NULL),
    ks AS (SELECT table_id, col_ix FROM (SELECT table_id, col_ix, count(*) AS n, count(value) AS v FROM kp GROUP BY ALL) c WHERE n >= 2 AND v >= 1 QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY n + v DESC, col_ix) = 1),
    kv AS MATERIALIZED (SELECT table_id, label, value, number, row_number() OVER (PARTITION BY table_id ORDER BY row_ix) - 1 AS ix FROM kp JOIN ks USING (table_id, col_ix)),
    va AS MATERIALIZED (SELECT t.table_id, nl.item AS row_ix, t.col_ix - h.start_col AS col_ix, t.text, t.number, t.fmt FROM ty t JOIN header h USING (table_id) JOIN nl USING (table_id, row_ix) WHERE t.col_ix BETWEEN h.start_col AND h.end_col)"""


def _loose(r):
    return r.kept_once("loose", lambda: sheets.read_sheets(r.role("loose_cell")))


@query("source_tables", f"""
    WITH {LOOSE_SQL},
    hx AS (SELECT h.table_id, h.col - h.start_col AS ix, coalesce(t.text, '') AS label FROM (SELECT *, unnest(range(start_col, end_col + 1)) AS col FROM header) h LEFT JOIN ty t ON t.table_id = h.table_id AND t.row_ix = h.header_row AND t.col_ix = h.col),
    la AS (SELECT table_id, CASE orientation WHEN 'categories_rows_series_columns' THEN 'series' ELSE 'category' END AS axis, ix, label FROM hx JOIN ki USING (table_id)
        UNION ALL SELECT table_id, CASE orientation WHEN 'categories_rows_series_columns' THEN 'category' ELSE 'series' END, item, CASE WHEN label <> '' THEN label WHEN orientation LIKE 'single%' THEN 'Valor'
            WHEN orientation LIKE 'series%' THEN 'Serie ' || (item + 1) ELSE 'Linha ' || (item + 1) END FROM nl JOIN ki USING (table_id)
        UNION ALL SELECT table_id, 'category', ix, label FROM kv UNION ALL SELECT DISTINCT table_id, 'series', 0, 'Valor' FROM kv),
    fo AS (SELECT table_id, ix, fmt FROM (SELECT table_id, CASE orientation WHEN 'categories_rows_series_columns' THEN col_ix ELSE row_ix END AS ix, fmt, count(*) AS n,
            min(CASE orientation WHEN 'categories_rows_series_columns' THEN row_ix ELSE col_ix END) AS p FROM va JOIN ki USING (table_id) WHERE lower(fmt) <> 'general' GROUP BY ALL) c
        QUALIFY row_number() OVER (PARTITION BY table_id, ix ORDER BY n DESC, p) = 1),
    al AS (SELECT DISTINCT table_id FROM loose_cell)
    SELECT al.table_id, coalesce(ki.orientation, CASE WHEN al.table_id IN (SELECT table_id FROM kv) THEN 'key_value_rows' WHEN al.table_id IN (SELECT table_id FROM ty) THEN 'unknown' ELSE 'empty' END) AS orientation,
        la.axis, CAST(la.ix AS INT) AS ix, la.label, CASE WHEN la.axis IS NULL THEN NULL WHEN la.axis = 'series' THEN coalesce(fo.fmt, '') ELSE '' END AS fmt
    FROM al LEFT JOIN ki USING (table_id) LEFT JOIN la USING (table_id) LEFT JOIN fo ON fo.table_id = al.table_id AND fo.ix = la.ix AND la.axis = 'series'""")
def source_tables(r):
    """Axes of every sheet, and sheets without any as one row."""
    read = _loose(r)
    return read.tables.select("table_id", "orientation").join(read.labels, "table_id", "left").select("table_id", "orientation", "axis", F.col("ix").cast("int").alias("ix"), "label", "fmt")


@query("source_values", f"""
    WITH {LOOSE_SQL} SELECT table_id, CAST(row_ix AS INT) AS row_ix, CAST(col_ix AS INT) AS col_ix, number AS num, CASE WHEN number IS NULL THEN text END AS text FROM va
    UNION ALL SELECT table_id, CAST(ix AS INT), 0, number, CASE WHEN number IS NULL THEN value END FROM kv WHERE value IS NOT NULL""")
def source_values(r):
    """Filled positions of every sheet that could be read."""
    v = _loose(r).values
    return v.select("table_id", F.col("row_ix").cast("int").alias("row_ix"), F.col("col_ix").cast("int").alias("col_ix"), "num", F.when(F.col("num").isNull(), F.col("text")).alias("text"))


@query("dominant_format", """
    SELECT table_id, row_ix, fmt FROM (SELECT table_id, row_ix, fmt, count(*) AS n, min(col_ix) AS p FROM sheet_cell WHERE lower(fmt) <> 'general' GROUP BY ALL) c QUALIFY row_number() OVER (PARTITION BY table_id, row_ix ORDER BY n DESC, p) = 1""")
def dominant_format(r):
    return grid.dominant_format(r.role("sheet_cell"), ["table_id", "row_ix"], ["col_ix"])


RANGES = "SELECT 'p' || k AS table_id, CAST(3 + k % 2 AS INT) AS r0, CAST(k % 3 AS INT) AS c0, CAST(5 + k % 4 AS INT) AS r1, CAST(k % 3 + 2 AS INT) AS c1 FROM src_head WHERE k >= 0"


@query("range_slice", f"""
    SELECT c.table_id, c.row_ix, c.col_ix, c.raw, c.num FROM sheet_cell c JOIN ({RANGES}) g ON g.table_id = c.table_id AND c.row_ix BETWEEN g.r0 AND g.r1 AND c.col_ix BETWEEN g.c0 AND g.c1""")
def range_slice(r):
    return grid.range_slice(r.role("sheet_cell"), r.sql(RANGES)).select("table_id", "row_ix", "col_ix", "raw", "num")


NAMED = "SELECT 'p' || k AS table_id, r0, c0, r1, c1 FROM named_region WHERE k % 10 = 1"


@query("grow_range", f"""
    WITH RECURSIVE s AS (SELECT s.table_id, s.r0, s.c0, greatest(s.r1, coalesce(g.r1, -1)) AS r1, greatest(s.c1, coalesce(g.c1, -1)) AS c1, g.table_id IS NOT NULL AS fixed FROM ({RANGES}) s
        LEFT JOIN ({NAMED}) g ON g.table_id = s.table_id AND s.r0 <= g.r1 AND g.r0 <= s.r1 AND s.c0 <= g.c1 AND g.c0 <= s.c1),
    c AS MATERIALIZED (SELECT table_id, row_ix, col_ix, coalesce(regexp_full_match({norm_sql('raw', plus=False)}, {_PERIOD}), false) AS period, num IS NULL AND TRY_CAST(raw AS DOUBLE) IS NULL AS label FROM sheet_cell),
    f AS (SELECT s.*, coalesce((SELECT bool_or(period) FROM c WHERE c.table_id = s.table_id AND c.row_ix = s.r0 AND c.col_ix BETWEEN s.c0 AND s.c1), false) AS per,
            coalesce((SELECT avg(CASE WHEN label THEN 1.0 ELSE 0 END) FROM c WHERE c.table_id = s.table_id AND c.col_ix = s.c0 AND c.row_ix > s.r0 AND c.row_ix <= s.r1), 0) >= 0.5 AS lab FROM s WHERE NOT fixed),
    gc AS (SELECT table_id, c1 FROM f UNION ALL SELECT gc.table_id, gc.c1 + 1 FROM gc JOIN f USING (table_id) JOIN c ON c.table_id = f.table_id AND c.row_ix = f.r0 AND c.col_ix = gc.c1 + 1 AND c.period WHERE f.per),
    w AS (SELECT f.table_id, f.r0, f.c0, f.r1, (SELECT max(c1) FROM gc WHERE gc.table_id = f.table_id) AS c1, lab FROM f),
    rw AS (SELECT DISTINCT w.table_id, c.row_ix FROM w JOIN c ON c.table_id = w.table_id AND c.col_ix BETWEEN w.c0 AND w.c1 AND (NOT w.lab OR EXISTS (SELECT 1 FROM c d WHERE d.table_id = w.table_id AND d.row_ix = c.row_ix AND d.col_ix = w.c0))),
    gr AS (SELECT table_id, r1 FROM w UNION ALL SELECT gr.table_id, gr.r1 + 1 FROM gr JOIN rw ON rw.table_id = gr.table_id AND rw.row_ix = gr.r1 + 1)
    SELECT table_id, r0, c0, r1, c1 FROM s WHERE fixed UNION ALL SELECT w.table_id, w.r0, w.c0, (SELECT max(r1) FROM gr WHERE gr.table_id = w.table_id), w.c1 FROM w""")
def grow_range(r):
    return grid.grow_range(r.role("sheet_cell"), r.sql(RANGES), r.sql(NAMED))


@query("pivot_matrix", "SELECT * FROM (PIVOT (SELECT table_id, row_ix, 'c' || col_ix AS c, num FROM src_value) ON c USING max(num) GROUP BY table_id, row_ix)")
def pivot_matrix(r):
    from ..sources.publish import delivery_matrix

    return delivery_matrix(r.role("src_value").withColumn("c", F.concat(F.lit("c"), F.col("col_ix").cast("string"))), ["table_id", "row_ix"], "c", "num")


@query("unpivot_matrix", """
    SELECT l_orderkey AS id, l_linenumber AS line, 'l_quantity' AS label, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem""")
def unpivot_matrix(r):
    wide = r.table("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), "l_quantity", "l_discount", "l_tax")
    return grid.unpivot_matrix(wide, ["id", "line"], ["l_quantity", "l_discount", "l_tax"])


@query("transpose", "SELECT table_id, col_ix AS row_ix, row_ix AS col_ix, num FROM src_value")
def transpose(r):
    return grid.transpose_cells(r.role("src_value"))


@query("pad_grid", """
    SELECT s.table_id, i.row_ix, j.col_ix, v.num FROM (SELECT table_id, k FROM src_head) s JOIN (SELECT k, ix AS row_ix FROM src_row) i ON i.k = s.k JOIN (SELECT k, ix AS col_ix FROM src_col) j ON j.k = s.k
    LEFT JOIN src_value v ON v.table_id = s.table_id AND v.row_ix = i.row_ix AND v.col_ix = j.col_ix""")
def pad_grid(r):
    rows = r.role("src_row").groupBy("k").agg((F.max("ix") + 1).alias("n_rows"))
    cols = r.role("src_col").groupBy("k").agg((F.max("ix") + 1).alias("n_cols"))
    shapes = r.role("src_head").select("k", "table_id").join(rows, "k").join(cols, "k")
    return grid.pad_grid(r.role("src_value"), shapes)


RECIPE = "SELECT table_id, CASE k % 6 WHEN 0 THEN 'keep' WHEN 1 THEN 'transpose' WHEN 2 THEN 'drop_and_keep' WHEN 3 THEN 'drop_and_transpose' WHEN 4 THEN 'explode' ELSE 'unknown' END AS operation, CAST(k % 4 - 1 AS INT) AS drop_rows, CAST(k % 3 AS INT) AS drop_cols FROM src_head"


@query("apply_recipe", f"""
    WITH r AS (SELECT table_id, operation, CASE WHEN operation LIKE 'drop%' THEN greatest(drop_rows, 0) ELSE 0 END AS dr, CASE WHEN operation LIKE 'drop%' THEN drop_cols ELSE 0 END AS dc FROM ({RECIPE}) x)
    SELECT v.table_id, CASE WHEN operation LIKE '%transpose' THEN col_ix - dc ELSE row_ix - dr END AS row_ix, CASE WHEN operation LIKE '%transpose' THEN row_ix - dr ELSE col_ix - dc END AS col_ix, num FROM src_value v JOIN r USING (table_id) WHERE row_ix >= dr AND col_ix >= dc""")
def apply_recipe(r):
    return grid.apply_recipe(r.role("src_value"), r.sql(RECIPE))


@query("thousands_flag", """
    SELECT table_id, avg(CASE WHEN abs(num) >= 1000 AND num = floor(num) THEN 1.0 ELSE 0.0 END) >= 0.8 AS thousands FROM (SELECT v.table_id, CASE WHEN h.k % 2 = 0 THEN floor(num) ELSE num END AS num FROM src_value v JOIN src_head h ON h.table_id = v.table_id) t GROUP BY table_id""")
def thousands_flag(r):
    v = r.sql("SELECT v.table_id, CASE WHEN h.k % 2 = 0 THEN CAST(floor(num) AS DOUBLE) ELSE num END AS num FROM src_value v JOIN src_head h ON h.table_id = v.table_id")
    return grid.thousands_flag(v, ["table_id"])


@query("compact_dump", """
    WITH c AS (SELECT doc_id, row_ix, col_ix, row_number() OVER (PARTITION BY doc_id ORDER BY row_ix, col_ix) AS n, count(*) OVER (PARTITION BY doc_id) AS total FROM doc_cell)
    SELECT CAST(doc_id AS VARCHAR) AS table_id, row_ix, count(*) AS n_cells, greatest(max(total) - 100, 0) AS omitted FROM c WHERE n <= 100 GROUP BY doc_id, row_ix""")
def compact_dump(r):
    cells = r.sql("SELECT CAST(doc_id AS STRING) AS table_id, row_ix, col_ix, raw, CAST(NULL AS DOUBLE) AS num, 'General' AS fmt FROM doc_cell")
    dump = grid.compact_dump(cells, 100)
    parsed = F.from_json("line", "array<struct<col_ix int>>")
    return dump.select("table_id", "row_ix", F.size(parsed).cast("bigint").alias("n_cells"), "omitted")
