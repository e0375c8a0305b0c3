"""Axis alignment, matrices, formats, contracts and the flagship plan."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import alignment, contracts, diff, tables
from ..operators.aggregates import issue_report
from ..plans import matching, package
from ..sources.mapping import load_mapping
from .matching import edges_of
from .registry import query
from .roles import norm_sql, soft_sql
from .scalars import LOADED_MAPPING_SQL

_N = lambda c: f"list_transform({c}, lambda v: {norm_sql('v')})"
_COV = lambda a, b: f"(CAST(len(list_filter({a}, lambda v: v <> '' AND len(list_filter({b}, lambda c: {soft_sql('v', 'c')} >= 0.68)) > 0)) AS DOUBLE) / greatest(len({a}), 1))"

PAIR_SQL = f"""
    pr AS MATERIALIZED (SELECT t.k, t.target_id, s.table_id, t.orientation, CASE WHEN t.orientation LIKE 'series%' THEN t.series ELSE t.categories END AS rows, CASE WHEN t.orientation LIKE 'series%' THEN t.categories ELSE t.series END AS cols,
              s.series AS srows, s.categories AS scols FROM target t JOIN source_table s ON s.k = t.k WHERE t.object_type = 'chart'),
    pn AS MATERIALIZED (SELECT *, {_N('rows')} AS a, {_N('cols')} AS b, {_N('srows')} AS c, {_N('scols')} AS d FROM pr),
    md AS MATERIALIZED (SELECT *, CASE WHEN {_COV('a', 'd')} + {_COV('b', 'c')} > {_COV('a', 'c')} + {_COV('b', 'd')} THEN 'cross' ELSE 'same' END AS mode FROM pn)"""
MAP_SQL = f"""{PAIR_SQL},
    ax AS (SELECT k, 'row' AS axis, rows AS labels, CASE mode WHEN 'cross' THEN scols ELSE srows END AS choices FROM md UNION ALL SELECT k, 'col', cols, CASE mode WHEN 'cross' THEN srows ELSE scols END FROM md),
    la AS (SELECT k, axis, labels[i] AS label, i, {norm_sql('labels[i]')} AS n FROM (SELECT k, axis, labels, unnest(range(1, len(labels) + 1)) AS i FROM ax) x),
    ch AS (SELECT k, axis, choices[i] AS choice, i AS j, {norm_sql('choices[i]')} AS m FROM (SELECT k, axis, choices, unnest(range(1, len(choices) + 1)) AS i FROM ax) x),
    sc AS MATERIALIZED (SELECT la.k, la.axis, la.i, la.label, ch.choice, ch.j, ch.m, {soft_sql('la.n', 'ch.m')} AS s FROM la JOIN ch ON ch.k = la.k AND ch.axis = la.axis),
    lm AS (SELECT k, axis, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS VARCHAR) AS label, CAST(NULL AS VARCHAR) AS choice, CAST(NULL AS BIGINT) AS j FROM ax
        UNION ALL
        SELECT k, axis, i, list_append(used, m), label, choice, j FROM (SELECT l.k, l.axis, sc.i, l.used, sc.m, sc.label, sc.choice, sc.j,
            row_number() OVER (PARTITION BY l.k, l.axis ORDER BY CASE WHEN list_contains(l.used, sc.m) THEN 1 ELSE 0 END, sc.s DESC, sc.j) AS rn FROM lm l JOIN sc ON sc.k = l.k AND sc.axis = l.axis AND sc.i = l.i + 1) z WHERE rn = 1),
    map AS MATERIALIZED (SELECT k, axis, i, label, choice, j FROM lm WHERE i > 0)"""


def _pairs(r):
    chosen = r.targets().where("object_type = 'chart'").select("k", "target_id").join(r.source_tables().select("k", "table_id"), "k")
    tables = r.source_tables().withColumn("allow_growth", F.col("k") % 4 == 0)
    return matching.pair_axes(chosen, r.targets(), tables)


def _aligned(r):
    return r.kept_once("aligned", lambda: alignment.align(_pairs(r)))


def _axes(r, which):
    a = _aligned(r)
    return a.axes.join(a.modes.where(which), "target_id", "left_semi").select("target_id", "axis", "label", "ix")


@query("axis_alignment", f"WITH {PAIR_SQL} SELECT target_id, table_id, mode FROM md")
def axis_alignment(r):
    return _aligned(r).modes.select("target_id", "table_id", "mode")


@query("label_map", f"WITH RECURSIVE {MAP_SQL} SELECT target_id, axis, label, choice FROM map JOIN pr USING (k)")
def label_map(r):
    return _aligned(r).maps.select("target_id", "axis", "label", "choice")


ORDER_SQL = f"""{MAP_SQL},
    ord AS MATERIALIZED (SELECT k, axis, label, choice, j, CAST(row_number() OVER (PARTITION BY k, axis ORDER BY j, i) - 1 AS INT) AS ix FROM map)"""


@query("source_order", f"WITH RECURSIVE {ORDER_SQL} SELECT target_id, axis, label, ix FROM ord JOIN pr USING (k) WHERE k % 4 <> 0")
def source_order(r):
    return _axes(r, "not allow_growth")


GROWN_SQL = f"""{ORDER_SQL},
    gx AS (SELECT k, CASE WHEN orientation LIKE 'series%' THEN 'col' ELSE 'row' END AS axis FROM pr WHERE k % 4 = 0),
    own AS (SELECT c.k, c.axis, c.j, coalesce((SELECT arg_max(label, i) FROM map WHERE map.k = c.k AND map.axis = c.axis AND map.j = c.j), c.choice) AS label FROM ch c JOIN gx ON gx.k = c.k AND gx.axis = c.axis),
    al AS (SELECT k, axis, 0 AS part, j AS p, label FROM own UNION ALL SELECT o.k, o.axis, 1, o.ix, o.label FROM ord o JOIN gx ON gx.k = o.k AND gx.axis = o.axis),
    fi AS (SELECT k, axis, part, p, label FROM al QUALIFY row_number() OVER (PARTITION BY k, axis, {norm_sql('label')} ORDER BY part, p) = 1),
    axes AS MATERIALIZED (SELECT k, axis, label, CAST(row_number() OVER (PARTITION BY k, axis ORDER BY part, p) - 1 AS INT) AS ix FROM fi
             UNION ALL SELECT o.k, o.axis, o.label, o.ix FROM ord o WHERE NOT EXISTS (SELECT 1 FROM gx WHERE gx.k = o.k AND gx.axis = o.axis))"""


@query("grow_axis", f"WITH RECURSIVE {GROWN_SQL} SELECT target_id, axis, label, ix FROM axes JOIN pr USING (k) WHERE k % 4 = 0")
def grow_axis(r):
    return _axes(r, "allow_growth")


FILL_SQL = f"""{GROWN_SQL},
    pl AS (SELECT a.k, a.axis, a.ix, coalesce(m.choice, a.label) AS shown, coalesce(m.j, c.j) - 1 AS at FROM axes a LEFT JOIN (SELECT k, axis, label, max(j) AS j, max(choice) AS choice FROM map GROUP BY ALL) m ON m.k = a.k AND m.axis = a.axis AND m.label = a.label
           LEFT JOIN ch c ON c.k = a.k AND c.axis = a.axis AND c.choice = a.label),
    cell AS (SELECT md.target_id, md.table_id, r.ix AS row_ix, c.ix AS col_ix, r.shown AS row_label, c.shown AS col_label, v.num AS value FROM md JOIN pl r ON r.k = md.k AND r.axis = 'row' JOIN pl c ON c.k = md.k AND c.axis = 'col'
             LEFT JOIN src_value v ON v.table_id = md.table_id AND v.row_ix = CASE md.mode WHEN 'cross' THEN c.at ELSE r.at END AND v.col_ix = CASE md.mode WHEN 'cross' THEN r.at ELSE c.at END)"""


@query("dense_fill", f"WITH RECURSIVE {FILL_SQL} SELECT target_id, table_id, row_ix, col_ix, row_label, col_label, value FROM cell")
def dense_fill(r):
    return alignment.dense_fill(_aligned(r), r.role("src_value"))


@query("aligned_values", f"WITH RECURSIVE {FILL_SQL} SELECT target_id, row_label, col_label, value FROM cell WHERE value IS NOT NULL")
def aligned_values(r):
    return alignment.dense_fill(_aligned(r), r.role("src_value")).where("value is not null").select("target_id", "row_label", "col_label", "value")



@query("fill_blank_labels", f"""
    WITH l AS (SELECT k, pos, CASE WHEN (k + pos) % 3 = 0 THEN ' ' ELSE label END AS label FROM (SELECT k, label, row_number() OVER (PARTITION BY k ORDER BY pos, label) - 1 AS pos FROM tgt_row) x),
    c AS (SELECT k, ix, CASE WHEN ix = 4 THEN 'nps' ELSE label END AS label FROM src_row WHERE k >= 0),
    f AS (SELECT k, label, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN {norm_sql('label')} = 'NPS' THEN 0 ELSE 1 END, ix) AS n FROM c WHERE {norm_sql('label')} NOT IN (SELECT {norm_sql('l.label')} FROM l WHERE l.k = c.k)),
    b AS (SELECT k, pos, label, CASE WHEN trim(label) = '' THEN row_number() OVER (PARTITION BY k, trim(label) = '' ORDER BY pos) END AS n FROM l)
    SELECT b.k, CAST(b.pos AS INT) AS ix, coalesce(f.label, b.label) AS label FROM b LEFT JOIN f ON f.k = b.k AND f.n = b.n WHERE b.k IN (SELECT k FROM c)""")
def fill_blank_labels(r):
    labels = r.sql("SELECT k, pos, CASE WHEN (k + pos) % 3 = 0 THEN ' ' ELSE label END AS label FROM (SELECT k, label, row_number() OVER (PARTITION BY k ORDER BY pos, label) - 1 AS pos FROM tgt_row) x")
    choices = r.sql("SELECT k, ix, CASE WHEN ix = 4 THEN 'nps' ELSE label END AS label FROM src_row WHERE k >= 0")
    labels = labels.join(choices.select("k").distinct(), "k", "left_semi").select("k", F.col("pos").alias("ix"), "label")
    return alignment.fill_blank_labels(labels, choices, ["k"]).select("k", F.col("ix").cast("int").alias("ix"), "label")


@query("adaptive_table", f"""
    WITH t AS (SELECT h.k, h.target_id, list({norm_sql('c.text')} ORDER BY c.row_ix, c.col_ix) FILTER (c.row_ix = 0) AS fr, list({norm_sql('c.text')} ORDER BY c.row_ix) FILTER (c.col_ix = 0) AS fc, max(c.row_ix) + 1 AS n, max(c.col_ix) + 1 AS w, bool_or(c.row_ix > 0 AND trim(c.text) <> '') AS later
          FROM tgt_head h JOIN tgt_cell c USING (target_id) GROUP BY ALL),
    j AS (SELECT t.*, s.categories, {_N('s.categories')} AS hd, {_N('s.series')} AS rl, list_filter(t.fr, lambda v: v <> '') AS f FROM t JOIN source_table s ON s.k = t.k),
    h AS (SELECT *, len(list_filter(f, lambda v: list_contains(hd, v))) >= greatest(1, (least(len(f), len(list_distinct(hd))) + 1) // 2) OR (n >= 2 AND len(f) > 0 AND NOT later) AS has_header FROM j)
    SELECT target_id, has_header, len(rl) > 1 OR w = len(categories) + 1 OR list_has_any(rl, CASE WHEN has_header THEN fc[2:] ELSE fc END) AS has_labels FROM h""")
def adaptive_table(r):
    shape = tables.table_shape(r.role("tgt_cell"))
    s = r.source_tables().select("k", F.col("categories").alias("headers"), F.col("series").alias("row_labels"))
    out = alignment.adaptive_table(r.role("tgt_head").select("k", "target_id").join(shape, "target_id").join(s, "k"))
    return out.select("target_id", "has_header", "has_labels")


# a third of the sources are read as names with one value, a third by their columns
@query("table_plans", f"""
    WITH pa AS MATERIALIZED (SELECT t.target_id, s.table_id, s.k % 3 AS m, s.series AS rl, s.categories AS hd FROM target t JOIN source_table s ON s.k = t.k WHERE t.object_type = 'table'),
    t AS (SELECT target_id, list({norm_sql('text')} ORDER BY row_ix, col_ix) FILTER (row_ix = 0) AS fr, list({norm_sql('text')} ORDER BY row_ix) FILTER (col_ix = 0) AS fc, max(row_ix) + 1 AS n, max(col_ix) + 1 AS w,
        bool_or(row_ix > 0 AND trim(text) <> '') AS later FROM tgt_cell GROUP BY target_id),
    j AS (SELECT *, {_N('hd')} AS nh, {_N('rl')} AS nr, list_filter(fr, lambda v: v <> '') AS f FROM pa JOIN t USING (target_id) WHERE m <> 0),
    h AS (SELECT *, len(list_filter(f, lambda v: list_contains(nh, v))) >= greatest(1, (least(len(f), len(list_distinct(nh))) + 1) // 2) OR (n >= 2 AND len(f) > 0 AND NOT later) AS top FROM j),
    g AS MATERIALIZED (SELECT target_id, table_id, rl, hd, CAST(top AS INT) AS top, CAST(len(rl) > 1 OR w = len(hd) + 1 OR list_has_any(nr, CASE WHEN top THEN fc[2:] ELSE fc END) AS INT) AS side FROM h),
    r AS (SELECT target_id, table_id, top, side, hd, rl[i] AS label, i FROM (SELECT *, unnest(range(1, len(rl) + 1)) AS i FROM g) x),
    c AS (SELECT target_id, table_id, top, side, hd[i] AS label, i FROM (SELECT *, unnest(range(1, len(hd) + 1)) AS i FROM g) x),
    kp AS MATERIALIZED (SELECT target_id, table_id, rl FROM pa WHERE m = 0), ks AS (SELECT target_id, table_id, rl[i] AS label, i - 1 AS ix FROM (SELECT *, unnest(range(1, len(rl) + 1)) AS i FROM kp) x),
    tr AS (SELECT target_id, row_ix, max(text) FILTER (col_ix = 0) AS label, coalesce(max(text) FILTER (col_ix = 1), '') AS value, max(col_ix) AS last FROM tgt_cell JOIN kp USING (target_id) GROUP BY ALL),
    tt AS (SELECT * FROM tr WHERE target_id NOT IN (SELECT target_id FROM tr WHERE last < 1 OR coalesce({norm_sql('label')}, '') = '')),
    b AS (SELECT tt.target_id, tt.row_ix, {norm_sql('tt.label')} AS a, {norm_sql('ks.label')} AS b, {soft_sql(norm_sql('tt.label'), norm_sql('ks.label'))} AS sc, ks.ix FROM tt JOIN ks USING (target_id)),
    bb AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY target_id, row_ix ORDER BY sc DESC, ix) = 1),
    al AS (SELECT tt.*, row_number() OVER (PARTITION BY tt.target_id ORDER BY tt.row_ix) - 1 AS p FROM tt LEFT JOIN bb USING (target_id, row_ix)
        WHERE coalesce(sc, 0) < 0.68 AND NOT coalesce(list_has_any(list_filter(string_split(a, ' '), lambda w: len(w) >= 3), list_filter(string_split(b, ' '), lambda w: len(w) >= 3)), false)),
    kr AS (SELECT al.target_id, kp.table_id, p AS row_ix, label, value AS shown, CAST(NULL AS DOUBLE) AS num FROM al JOIN kp USING (target_id)
        UNION ALL SELECT ks.target_id, ks.table_id, ks.ix + (SELECT count(*) FROM al WHERE al.target_id = ks.target_id), ks.label, CASE WHEN v.num IS NULL THEN '' END, v.num FROM ks LEFT JOIN src_value v ON v.table_id = ks.table_id AND v.row_ix = ks.ix AND v.col_ix = 0)
    SELECT target_id, table_id, CAST(0 AS INT) AS row_ix, CAST(0 AS INT) AS col_ix, CAST(NULL AS VARCHAR) AS row_label, CAST(NULL AS VARCHAR) AS col_label, CAST(NULL AS VARCHAR) AS text, CAST(NULL AS DOUBLE) AS value FROM g WHERE top = 1 AND side = 1
    UNION ALL SELECT target_id, table_id, 0, CAST(i - 1 + side AS INT), NULL, label, label, NULL FROM c WHERE top = 1
    UNION ALL SELECT target_id, table_id, CAST(i - 1 + top AS INT), 0, label, NULL, label, NULL FROM r WHERE side = 1
    UNION ALL SELECT r.target_id, r.table_id, CAST(r.i - 1 + r.top AS INT), CAST(c.i - 1 + r.side AS INT), r.label, c.label, NULL, v.num FROM r JOIN c USING (target_id) LEFT JOIN src_value v ON v.table_id = r.table_id AND v.row_ix = r.i - 1 AND v.col_ix = c.i - 1
    UNION ALL SELECT target_id, table_id, CAST(row_ix AS INT), 0, label, NULL, label, NULL FROM kr UNION ALL SELECT target_id, table_id, CAST(row_ix AS INT), 1, label, 'Vendas', shown, num FROM kr""")
def table_plans(r):
    """The filled grid of every table contract."""
    m = F.col("k") % 3
    kind = F.when(m == 0, tables.KEY_VALUE).when(m == 1, "categories_rows_series_columns").otherwise("series_rows_categories_columns")
    s = r.source_tables().select(
        "k", "table_id", kind.alias("source_orientation"), F.when(m == 2, F.col("categories")).otherwise(F.col("series")).alias("source_categories"),
        F.when(m == 0, F.array(F.lit("Vendas"))).when(m == 1, F.col("categories")).otherwise(F.col("series")).alias("source_series"))
    pairs = r.role("tgt_head").where("object_type = 'table'").select("k", "target_id").join(s, "k").drop("k")
    return tables.table_cells(pairs, r.role("tgt_cell"), r.role("src_value"))


TEMPLATE = "SELECT 't' || k AS target_id, k, CAST(row_number() OVER (PARTITION BY k ORDER BY pos, label) - 1 AS INT) AS ix, label, 'v' || pos AS value FROM tgt_row "
KV_SOURCE = "SELECT 't' || k AS target_id, k, ix, label, CAST(nk AS STRING) AS value FROM src_row WHERE k >= 0"


@query("key_value_fill", f"""
    WITH t AS ({TEMPLATE}), s AS ({KV_SOURCE}), p AS (SELECT t.target_id, t.ix, s.ix AS j, {norm_sql('t.label')} AS a, {norm_sql('s.label')} AS b FROM t JOIN s USING (target_id)),
    b AS (SELECT target_id, ix, a, b, sc FROM (SELECT *, {soft_sql('a', 'b')} AS sc FROM p) q QUALIFY row_number() OVER (PARTITION BY target_id, ix ORDER BY sc DESC, j) = 1)
    SELECT t.target_id, 0 AS part, t.ix, t.label, t.value FROM t LEFT JOIN b USING (target_id, ix) WHERE coalesce(sc, 0) < 0.68 AND NOT coalesce(list_has_any(list_filter(string_split(a, ' '), lambda w: len(w) >= 3), list_filter(string_split(b, ' '), lambda w: len(w) >= 3)), false)
    UNION ALL SELECT target_id, 1, ix, label, value FROM s""")
def key_value_fill(r):
    t, s = r.sql(TEMPLATE), r.sql(KV_SOURCE)
    return alignment.key_value_fill(t, s, tables.best_labels(t, s))


SERIES = """SELECT h.k, h.target_id, r.ix, CASE WHEN r.nk % 5 = 0 THEN 'Taxa ' || r.label ELSE r.label END AS label, CASE r.nk % 4 WHEN 0 THEN '0%' WHEN 1 THEN 'General' WHEN 2 THEN '#,##0.0' ELSE '' END AS target_format,
    CASE h.k % 3 WHEN 0 THEN '0.00' WHEN 1 THEN '0.0%' ELSE CASE r.nk % 2 WHEN 0 THEN '0%' ELSE '0.000' END END AS source_format, CASE WHEN h.k % 4 = 0 THEN '0.0' ELSE '@' END AS value_format, CASE WHEN h.k % 7 = 0 THEN 'thousands_pt_br' ELSE '' END AS plan_format,
    CASE WHEN h.k % 2 = 0 THEN 0.5 ELSE 2.5 END AS max_abs, CASE r.nk % 6 WHEN 0 THEN 'percent' WHEN 1 THEN 'number' ELSE 'auto' END AS mode FROM tgt_head h JOIN src_row r ON r.k = h.k"""


@query("format_cascade", f"""
    WITH s AS ({SERIES}), a AS (SELECT *, CASE WHEN lower(target_format) NOT IN ('', 'general', '@') AND k % 5 <> 1 THEN target_format WHEN k % 5 = 1 AND lower(value_format) <> '@' THEN value_format WHEN k % 2 = 0 THEN source_format
        WHEN k % 3 <> 2 THEN source_format WHEN label LIKE 'Taxa%' AND max_abs <= 1 THEN '0%' ELSE '0.0' END AS automatic FROM s)
    SELECT target_id, ix, automatic, CASE WHEN mode = 'percent' AND NOT contains(automatic, '%') THEN '0%' WHEN mode = 'number' AND contains(automatic, '%') THEN '0.0' ELSE automatic END AS format FROM a""")
def format_cascade(r):
    s = r.sql(SERIES)
    w = W.partitionBy("k").orderBy("ix").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # a contract without formats of its own (k % 5 = 1), and sources named alike (even k) or not
    every = lambda c: F.collect_list(c).over(w)
    nothing = F.transform(every("label"), lambda v: F.lit(""))
    named = s.withColumn("n_series", F.count("*").over(W.partitionBy("k")).cast("int")).withColumn("target_labels", every("label")).withColumn(
        "target_formats", F.when(F.col("k") % 5 == 1, nothing).otherwise(every("target_format"))).withColumn(
        "source_formats", every("source_format")).withColumn("source_labels", F.when(F.col("k") % 2 == 0, every("label")).otherwise(F.array(F.lit("x"))))
    return alignment.format_cascade(named).select("target_id", "ix", "automatic", "format")


CONTRACT_SQL = """
    rc AS (SELECT m.*, s.table_id, lower(m.reference) AS lr, n.only_region, coalesce(n.n, 0) AS n, g.region_name AS named, regexp_full_match(m.reference, '[A-Za-z]{1,4}\\d{1,7}(:[A-Za-z]{1,4}\\d{1,7})?') AS is_cell
           FROM (SELECT *, replace(trim(reference), '$', '') AS reference2 FROM mapping_once) m0 JOIN LATERAL (SELECT m0.k, m0.reference2 AS reference, CASE m0.k % 6 WHEN 1 THEN 'tabela_excel' WHEN 2 THEN 'dinamico' WHEN 3 THEN 'exato' ELSE 'auto' END AS mode) m ON true
           JOIN src_head s ON s.k = m.k LEFT JOIN (SELECT table_id, count(*) AS n, min(region_name) AS only_region FROM named_region GROUP BY 1) n ON n.table_id = s.table_id
           LEFT JOIN named_region g ON g.table_id = s.table_id AND lower(g.region_name) = lower(m.reference)),
    ri AS (SELECT *, CASE WHEN mode = 'tabela_excel' AND reference = '' AND n <> 1 THEN 'name of a region is missing' WHEN mode = 'tabela_excel' AND reference <> '' AND named IS NULL THEN 'region not found'
        WHEN mode IN ('dinamico', 'exato') AND reference = '' THEN 'range is missing' WHEN mode IN ('dinamico', 'exato') AND NOT is_cell THEN 'reference is invalid' WHEN mode = 'auto' AND reference <> '' AND named IS NULL AND NOT is_cell THEN 'reference is invalid' END AS issue FROM rc)"""


@query("read_contract", f"""
    WITH {CONTRACT_SQL} SELECT k, issue, CASE WHEN issue IS NOT NULL THEN NULL WHEN mode = 'tabela_excel' THEN coalesce(named, only_region) WHEN mode IN ('dinamico', 'exato') THEN reference WHEN reference <> '' THEN coalesce(named, reference) WHEN n = 1 THEN only_region ELSE '' END AS cell_range,
        CASE WHEN issue IS NULL THEN CASE WHEN mode = 'dinamico' OR (mode = 'auto' AND reference <> '' AND named IS NULL) THEN 'dynamic' ELSE 'exact' END END AS range_mode,
        issue IS NULL AND (mode IN ('dinamico', 'tabela_excel') OR (mode = 'auto' AND (reference <> '' OR n = 1))) AS allow_growth FROM ri""")
def read_contract(r):
    m = r.sql("SELECT m.k, s.table_id, m.reference, CASE m.k % 6 WHEN 1 THEN 'tabela_excel' WHEN 2 THEN 'dinamico' WHEN 3 THEN 'exato' ELSE 'auto' END AS read_mode FROM mapping_once m JOIN src_head s ON s.k = m.k")
    return contracts.read_contract(m, r.role("named_region").drop("k")).select("k", "issue", "cell_range", "range_mode", "allow_growth")


@query("contract_manifest", """
    SELECT target_id, array_to_string(CASE WHEN orientation LIKE 'series%' THEN series ELSE categories END, '|') AS row_labels, array_to_string(CASE WHEN orientation LIKE 'series%' THEN categories ELSE series END, '|') AS col_labels,
        CAST(len(CASE WHEN orientation LIKE 'series%' THEN series ELSE categories END) AS INT) AS n_rows, CAST(len(CASE WHEN orientation LIKE 'series%' THEN categories ELSE series END) AS INT) AS n_cols FROM target""")
def contract_manifest(r):
    m = contracts.contract_manifest(r.targets())
    return m.select("target_id", F.array_join("row_labels", "|").alias("row_labels"), F.array_join("col_labels", "|").alias("col_labels"), "n_rows", "n_cols")


PROPOSED = """SELECT h.target_id, r.ix AS row_ix, c.ix AS col_ix, CASE WHEN (h.k + r.ix + c.ix) % 17 = 0 THEN 'abc' ELSE CAST(c.ix % 10 AS {S}) END AS raw, CASE WHEN c.ix = 0 THEN 'text' ELSE 'number' END AS want
    FROM tgt_head h JOIN src_row r ON r.k = h.k JOIN src_col c ON c.k = h.k WHERE (h.k + r.ix) % 23 <> 0 OR c.ix <> 1"""


@query("typed_matrix_issues", f"""
    WITH p AS ({PROPOSED.format(S='VARCHAR')}), hd AS (SELECT h.target_id, count(*) AS n_headers FROM tgt_head h JOIN src_col c ON c.k = h.k GROUP BY 1), rw AS (SELECT target_id, row_ix, count(*) AS n, count(*) FILTER (want = 'number' AND raw = 'abc') AS bad FROM p GROUP BY ALL),
    g AS (SELECT rw.target_id, count(*) FILTER (n <> n_headers) AS ragged, CAST(sum(bad) AS BIGINT) AS bad, count(*) AS n_rows, max(n_headers) AS nh FROM rw JOIN hd USING (target_id) GROUP BY 1),
    u AS (SELECT g.*, CAST(len(t.series) AS BIGINT) AS cap, CASE WHEN t.orientation LIKE 'series%' THEN n_rows ELSE nh - 1 END AS used FROM g JOIN target t USING (target_id))
    SELECT target_id, 'ragged row' AS issue, ragged AS n FROM u WHERE ragged > 0 UNION ALL SELECT target_id, 'invalid number', bad FROM u WHERE bad > 0 UNION ALL SELECT target_id, 'series beyond capacity', used - cap FROM u WHERE cap > 0 AND used > cap""")
def typed_matrix_issues(r):
    headers = r.sql("SELECT h.target_id, count(*) AS n_headers FROM tgt_head h JOIN src_col c ON c.k = h.k GROUP BY h.target_id")
    capacity = r.targets().select("target_id", "orientation", F.size("series").cast("bigint").alias("n_series"))
    return contracts.typed_matrix_issues(r.sql(PROPOSED.format(S="STRING")), headers, capacity)


@query("matrix_shape_ok", f"""
    WITH p AS ({PROPOSED.format(S='VARCHAR')}), rw AS (SELECT target_id, row_ix, count(*) AS n FROM p GROUP BY ALL), s AS (SELECT target_id, count(*) AS r, min(n) AS lo, max(n) AS hi FROM rw GROUP BY 1),
    w AS (SELECT h.target_id, (SELECT count(*) FROM src_row r WHERE r.k = h.k) AS wr, (SELECT count(*) FROM src_col c WHERE c.k = h.k) AS wc FROM tgt_head h) SELECT target_id, coalesce(lo = hi AND r = wr AND hi = wc, false) AS ok FROM w LEFT JOIN s USING (target_id)""")
def matrix_shape_ok(r):
    rows = r.role("src_row").groupBy("k").agg(F.count("*").alias("want_rows"))
    cols = r.role("src_col").groupBy("k").agg(F.count("*").alias("want_cols"))
    want = r.role("tgt_head").select("k", "target_id").join(rows, "k").join(cols, "k")
    return contracts.matrix_shape_ok(r.sql(PROPOSED.format(S="STRING")), want)


# proposed matrices: headers with and without a corner, blank ones, too few; rows of one length and ragged ones
RESOLVE = {
    "pl": "SELECT target_id, orientation, object_type, CASE WHEN k % 7 = 2 THEN 'ok' ELSE 'Review' END AS status FROM tgt_head",
    "hd": """SELECT h.target_id, c.ix * 2 + 2 AS ix, CASE WHEN h.k % 16 = 6 THEN ' ' ELSE c.label END AS text FROM tgt_head h JOIN src_col c ON c.k = h.k WHERE h.k % 4 <> 3 OR c.ix > 0
        UNION ALL SELECT target_id, 0, CASE WHEN k % 4 = 0 THEN 'Corner' END FROM tgt_head WHERE k % 4 <> 3""",
    "ce": """SELECT h.target_id, r.ix * 3 AS row_ix, 0 AS col_ix, r.label AS text FROM tgt_head h JOIN src_row r ON r.k = h.k WHERE h.k % 13 <> 5
        UNION ALL SELECT h.target_id, r.ix * 3, c.ix + 1, CASE (h.k + r.ix + c.ix) % 6 WHEN 0 THEN '' WHEN 1 THEN c.ix || ',5%' WHEN 2 THEN '1.234,25' WHEN 3 THEN 'n/a' WHEN 4 THEN ' - 3 ' ELSE ',75' END
        FROM tgt_head h JOIN src_row r ON r.k = h.k JOIN src_col c ON c.k = h.k WHERE h.k % 13 <> 5 AND NOT (h.k % 11 = 4 AND r.ix = 1 AND c.ix = 0)""",
    "va": "SELECT h.target_id, v.row_ix, v.col_ix, v.num FROM src_value v JOIN src_head s ON s.table_id = v.table_id JOIN tgt_head h ON h.k = s.k",
}


@query("resolve_matrix", f"""
    WITH {', '.join(f'{n} AS ({q})' for n, q in RESOLVE.items())},
    ax AS (SELECT target_id, 'category' AS axis, i - 1 AS ix, categories[i] AS label FROM (SELECT *, unnest(range(1, len(categories) + 1)) AS i FROM target) t
        UNION ALL SELECT target_id, 'series', i - 1, series[i] FROM (SELECT *, unnest(range(1, len(series) + 1)) AS i FROM target) t),
    m AS (SELECT target_id, list(n) AS ns, count(*) AS n_rows, bool_or(p) AS p FROM (SELECT target_id, row_ix, count(*) AS n, bool_or(contains(text, '%')) AS p FROM ce GROUP BY 1, 2) r GROUP BY 1),
    hh AS (SELECT target_id, list(trim(coalesce(text, '')) ORDER BY ix) AS hs FROM hd GROUP BY 1),
    oo AS (SELECT target_id, axis, list(label ORDER BY ix) AS own FROM ax GROUP BY 1, 2),
    a AS (SELECT pl.*, CASE WHEN orientation LIKE 'series%' THEN 'category' ELSE 'series' END AS ca, ns, n_rows, p, coalesce(hs, []) AS hs, list_filter(coalesce(hs, []), lambda x: x <> '') AS fs, list_max(ns) - 1 AS w
        FROM pl LEFT JOIN m USING (target_id) LEFT JOIN hh USING (target_id)),
    b AS (SELECT a.*, coalesce(own, []) AS own, CASE WHEN len(fs) = w THEN 'filled' WHEN len(hs) = w + 1 THEN 'after corner' WHEN len(coalesce(own, [])) = w THEN 'kept' WHEN len(fs) > 0 THEN 'filled' ELSE 'kept' END AS rd
        FROM a LEFT JOIN oo ON oo.target_id = a.target_id AND oo.axis = a.ca),
    c AS (SELECT *, CASE rd WHEN 'filled' THEN fs WHEN 'kept' THEN own ELSE hs[2:] END AS cs FROM b),
    d AS (SELECT *, CASE WHEN object_type <> 'chart' THEN 'not a chart' WHEN lower(status) <> 'review' THEN 'not in review' WHEN n_rows IS NULL THEN 'no rows'
        WHEN len(cs) = 0 OR len(list_distinct(ns)) > 1 OR w <> len(cs) THEN 'shape differs' ELSE 'corrected' END AS oc FROM c),
    nw AS (SELECT ce.target_id, CAST(row_ix / 3 AS BIGINT) AS r, col_ix, trim(text) AS text, replace(replace(text, '%', ''), ' ', '') AS t, ca FROM ce JOIN d ON d.target_id = ce.target_id AND oc = 'corrected'),
    nn AS (SELECT *, TRY_CAST(replace(regexp_replace(CASE WHEN contains(t, ',') AND contains(t, '.') THEN replace(t, '.', '') ELSE t END, '^(-?),', '\\10,'), ',', '.') AS DOUBLE) AS num FROM nw)
    SELECT target_id, 'decision' AS kind, -1 AS row_ix, -1 AS col_ix, oc || CASE WHEN oc = 'corrected' THEN ', ' || rd ELSE '' END || CASE WHEN p THEN ', percent' ELSE '' END AS text, CAST(NULL AS DOUBLE) AS num FROM d
    UNION ALL SELECT target_id, ca, i - 1, -1, cs[i], NULL FROM (SELECT *, unnest(range(1, len(cs) + 1)) AS i FROM d WHERE oc = 'corrected') t
    UNION ALL SELECT target_id, CASE ca WHEN 'category' THEN 'series' ELSE 'category' END, r, -1, text, NULL FROM nw WHERE col_ix = 0
    UNION ALL SELECT target_id, axis, ix, -1, label, NULL FROM ax WHERE target_id NOT IN (SELECT target_id FROM d WHERE oc = 'corrected')
    UNION ALL SELECT target_id, 'value', r, col_ix - 1, CASE WHEN num IS NULL THEN nullif(text, '') END, num FROM nn WHERE col_ix > 0
    UNION ALL SELECT target_id, 'value', row_ix, col_ix, NULL, num FROM va WHERE target_id NOT IN (SELECT target_id FROM d WHERE oc = 'corrected')""")
def resolve_matrix(r):
    """Decisions, axes and values of all plans after their proposals, in one long table."""
    t = r.targets()
    axis = lambda name, c: t.select("target_id", F.lit(name).alias("axis"), F.posexplode(c).alias("ix", "label"))
    pl, hd, ce, va = (r.sql(q) for q in RESOLVE.values())
    out = contracts.resolve_matrix(pl, axis("category", "categories").unionByName(axis("series", "series")), va, hd, ce)
    long = lambda v: F.col(v).cast("bigint").alias(v)
    none, no = F.lit(-1).cast("bigint"), F.lit(None).cast("double").alias("num")
    said = F.concat_ws(", ", "outcome", "reading", F.when(F.col("percent"), "percent"))
    return (
        out.decisions.select("target_id", F.lit("decision").alias("kind"), none.alias("row_ix"), none.alias("col_ix"), said.alias("text"), no)
        .unionByName(out.axes.select("target_id", F.col("axis").alias("kind"), F.col("ix").cast("bigint").alias("row_ix"), none.alias("col_ix"), F.col("label").alias("text"), no))
        .unionByName(out.values.select("target_id", F.lit("value").alias("kind"), long("row_ix"), long("col_ix"), "text", "num"))
    )


WRITTEN = "SELECT h.target_id, v.row_ix, v.col_ix, CASE WHEN (h.k + v.row_ix) % 211 = 0 THEN 'None' ELSE 'x' END AS text FROM src_value v JOIN src_head s ON s.table_id = v.table_id JOIN tgt_head h ON h.k = s.k"


@query("truncation_check", f"""
    WITH p AS ({WRITTEN}), w AS (SELECT * FROM p WHERE NOT (row_ix = 16 AND target_id LIKE '%1_CHART') AND NOT (col_ix = 6 AND target_id LIKE '%2_CHART')), a AS (SELECT target_id, max(row_ix) AS r, max(col_ix) AS c FROM p GROUP BY 1),
    b AS (SELECT target_id, max(row_ix) AS r2, max(col_ix) AS c2, count(*) FILTER (text = 'None') AS n FROM w GROUP BY 1)
    SELECT target_id, CASE WHEN coalesce(r2, -1) < r THEN 'rows truncated' WHEN coalesce(c2, -1) < c THEN 'columns truncated' WHEN n > 0 THEN 'literal None' ELSE 'ok' END AS issue FROM a LEFT JOIN b USING (target_id)""")
def truncation_check(r):
    planned = r.sql(WRITTEN)
    written = planned.where("not (row_ix = 16 and target_id like '%1_CHART') and not (col_ix = 6 and target_id like '%2_CHART')")
    return diff.truncation_check(planned, written)


ISSUES_SQL = f"""
    m AS (SELECT target_id, active, file_name, sheet_name, reference, read_mode FROM ({LOADED_MAPPING_SQL}) z), sh AS (SELECT table_id, readable, lower(regexp_extract(split_part(table_id, '#', 1), '[^/]*$')) AS fk FROM src_head),
    mine AS (SELECT *, lower(regexp_extract(file_name, '[^/]*$')) AS fk FROM m WHERE active = 1 AND target_id IN (SELECT target_id FROM tgt_head)), fi AS (SELECT mine.*, sh.table_id, sh.readable FROM mine LEFT JOIN sh USING (fk) WHERE fk <> ''),
    loc AS (SELECT fi.*, CASE WHEN sheet_name = '' THEN 'Data' ELSE sheet_name END AS sn FROM fi WHERE table_id IS NOT NULL),
    rd AS (SELECT l.*, g.region_name AS named, (SELECT count(*) FROM named_region n WHERE n.table_id = l.table_id) AS n, regexp_full_match(reference, '[A-Za-z]{{1,4}}\\d{{1,7}}(:[A-Za-z]{{1,4}}\\d{{1,7}})?') AS is_cell FROM loc l
           LEFT JOIN named_region g ON g.table_id = l.table_id AND lower(g.region_name) = lower(l.reference) WHERE sn = 'Data'),
    rr AS (SELECT *, CASE WHEN read_mode = 'tabela_excel' AND reference = '' AND n <> 1 THEN 'name of a region is missing' WHEN read_mode = 'tabela_excel' AND reference <> '' AND named IS NULL THEN 'region not found' WHEN read_mode IN ('dinamico', 'exato') AND reference = '' THEN 'range is missing'
        WHEN read_mode IN ('dinamico', 'exato') AND NOT is_cell THEN 'reference is invalid' WHEN read_mode = 'auto' AND reference <> '' AND named IS NULL AND NOT is_cell THEN 'reference is invalid' END AS issue FROM rd),
    iss AS (SELECT 'ERROR' AS level, target_id, 'file is missing in the row' AS issue FROM mine WHERE fk = '' UNION ALL SELECT 'ERROR', target_id, 'file not found' FROM fi WHERE table_id IS NULL UNION ALL SELECT 'ERROR', target_id, 'sheet not found' FROM loc WHERE sn <> 'Data'
        UNION ALL SELECT 'ERROR', target_id, issue FROM rr WHERE issue IS NOT NULL UNION ALL SELECT 'ERROR', target_id, 'no data' FROM rr WHERE issue IS NULL AND readable = 0
        UNION ALL SELECT 'WARNING', target_id, 'unknown id' FROM (SELECT DISTINCT target_id FROM m) d WHERE target_id NOT IN (SELECT target_id FROM tgt_head) UNION ALL SELECT 'WARNING', '', 'contracts without a row' WHERE EXISTS (SELECT 1 FROM tgt_head WHERE target_id NOT IN (SELECT target_id FROM m))
        UNION ALL SELECT 'WARNING', '', 'file not used' FROM (SELECT DISTINCT fk FROM sh) s WHERE fk NOT IN (SELECT fk FROM fi))"""


def _issues(r):
    tables = r.sql("SELECT table_id, split_part(table_id, '#', 1) AS file_name, 'Data' AS sheet_name, readable FROM src_head")
    return package.validate_package(load_mapping(r.role("mapping")), r.role("tgt_head"), tables, r.role("named_region").drop("k"))[0]


@query("package_issues", f"WITH {ISSUES_SQL} SELECT level, target_id, issue, count(*) AS n FROM iss GROUP BY ALL")
def package_issues(r):
    return _issues(r).groupBy("level", "target_id", "issue").agg(F.count("*").alias("n"))


@query("validation_report", f"WITH {ISSUES_SQL} SELECT count(*) FILTER (level = 'ERROR') AS errors, count(*) FILTER (level = 'REVIEW') AS reviews, count(*) FILTER (level = 'WARNING') AS warnings, count(*) FILTER (level = 'ERROR') = 0 AS ok FROM iss")
def validation_report(r):
    return issue_report(_issues(r))


@query("match_plans")
def match_plans(r):
    """For each contract pick one source sheet and return the filled matrix."""
    edges = edges_of(r)
    return matching.match_plans(r.targets(), r.source_tables(), r.role("src_value"), edges, cells=r.role("tgt_cell")).cells
