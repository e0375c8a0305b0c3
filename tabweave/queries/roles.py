"""Role tables: the inputs of the operators, derived from the given tables.

Every role is one SELECT that both engines read, so a query and the SQL it is
compared with start from the same rows.  ``{name}`` stands for a given table.
A role grows with the tables behind it: one source sheet and one contract per
part, one log record per event, one file per page, and so on.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, prepare

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

#: Contracts and sheets per block.
BLOCK = 6

ROLES: dict[str, str] = {
    # sales per part, supplier nation and ship year, in whole cents
    "xt": """
        SELECT l_partkey AS k, n_nationkey AS nk, n_name AS label, CAST(year(l_shipdate) AS INT) AS yr,
               CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents
        FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey
        GROUP BY l_partkey, n_nationkey, n_name, year(l_shipdate)""",
    # the same plus one general sheet per region (negative k)
    "src_xt": """
        SELECT k, nk, label, yr, cents FROM xt
        UNION ALL
        SELECT CAST(-1 - n_regionkey AS BIGINT) AS k, nk, label, yr, CAST(sum(cents) AS BIGINT) AS cents
        FROM xt JOIN {nation} ON nk = n_nationkey GROUP BY n_regionkey, nk, label, yr""",
    # parts with a sale, of which sheets and contracts are made
    "sold": "SELECT DISTINCT l_partkey FROM {lineitem}",
    "src_row": """
        SELECT k, nk, label, CAST(row_number() OVER (PARTITION BY k ORDER BY nk) - 1 AS INT) AS ix
        FROM (SELECT DISTINCT k, nk, label FROM src_xt) d""",
    "src_col": """
        SELECT k, yr, CAST(yr AS STRING) AS label, CAST(row_number() OVER (PARTITION BY k ORDER BY yr) - 1 AS INT) AS ix
        FROM (SELECT DISTINCT k, yr FROM src_xt) d""",
    "src_head": """
        SELECT p_partkey AS k, 'sales/' || replace(p_name, ' ', '_') || '_' || p_partkey || '.xlsx#Data' AS table_id,
               CAST(1 + floor(p_partkey / 6) AS INT) AS block_id, CAST(p_partkey AS STRING) AS source_id,
               p_name || ' report' || CASE WHEN p_partkey % 8 = 0 THEN ' obj' || (1000000 + p_partkey) ELSE '' END AS title,
               CASE WHEN p_partkey % 8 = 3 THEN 'G' || p_partkey ELSE '' END AS graph_id, p_partkey AS table_ix,
               CASE WHEN p_partkey % 16 = 5 THEN 0 ELSE 1 END AS readable
        FROM {part} WHERE p_partkey IN (SELECT l_partkey FROM {lineitem})
        UNION ALL
        SELECT CAST(-1 - r_regionkey AS BIGINT), 'general/' || r_name || '.xlsx#Data', CAST(NULL AS INT), '', r_name, '',
               1000000000000 + r_regionkey, 1
        FROM {region}""",
    "src_value": """
        SELECT h.table_id, r.ix AS row_ix, c.ix AS col_ix, CAST(x.cents AS DOUBLE) / 100 AS num
        FROM src_xt x JOIN src_row r ON x.k = r.k AND x.nk = r.nk JOIN src_col c ON x.k = c.k AND x.yr = c.yr
        JOIN src_head h ON x.k = h.k WHERE h.readable = 1""",
    # contracts: the same axes seen by a report, renamed, thinned, crossed and extended
    "tgt_row": """
        SELECT k, nk AS pos, CASE WHEN nk % 4 = 1 THEN replace(lower(label), 'nation', 'nátion')
               ELSE replace(lower(label), '_', ' ') END AS label
        FROM (SELECT DISTINCT k, nk, label FROM xt) d WHERE (nk + k) % 6 <> 0
        UNION ALL SELECT p_partkey, 900, 'Extra ' || (p_partkey % 5) FROM {part}
        UNION ALL SELECT p_partkey, 901, 'Comp A' FROM {part} WHERE p_partkey % 14 = 3
        UNION ALL SELECT p_partkey, 902, 'Comp B' FROM {part} WHERE p_partkey % 14 = 3""",
    "tgt_col": """
        SELECT k, CASE WHEN k % 5 = 0 THEN -yr ELSE yr END AS pos, CAST(yr AS STRING) AS label
        FROM (SELECT DISTINCT k, yr FROM xt) d WHERE (yr + k) % 7 <> 0""",
    "tgt_head": """
        SELECT p_partkey AS k, 'S' || lpad(CAST(1 + CAST(floor(p_partkey / 6) AS INT) AS STRING), 6, '0') || '_T' ||
               lpad(CAST(1 + p_partkey % 6 AS STRING), 3, '0') || '_' ||
               CASE WHEN p_partkey % 10 = 8 THEN 'TABLE' WHEN p_partkey % 10 = 9 THEN 'TEXT' ELSE 'CHART' END AS target_id,
               CAST(1 + floor(p_partkey / 6) AS INT) AS block_id, p_partkey AS target_ix,
               CASE WHEN p_partkey % 10 = 8 THEN 'table' WHEN p_partkey % 10 = 9 THEN 'text' ELSE 'chart' END AS object_type,
               CASE WHEN p_partkey % 4 = 0 THEN CAST(1000000 + p_partkey AS STRING)
                    WHEN p_partkey % 4 = 2 THEN CAST(p_partkey AS STRING)
                    WHEN p_partkey % 4 = 3 THEN 'G' || p_partkey ELSE 'Shape ' || p_partkey END AS shape_name,
               CAST(5000 + p_partkey AS STRING) AS shape_id,
               CASE WHEN p_partkey % 3 = 0 THEN 'series_rows_categories_columns'
                    ELSE 'categories_rows_series_columns' END AS orientation,
               p_name || ' | ' || lower(p_type) AS nearby_text,
               CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN 'Vendas ' || p_type ELSE '' END AS title,
               CAST((p_partkey % 6) % 3 * 4 AS DOUBLE) AS left_in, CAST(floor((p_partkey % 6) / 3) * 3.5 + 0.5 AS DOUBLE) AS top_in,
               CAST(3.5 AS DOUBLE) AS width_in, CAST(2.75 AS DOUBLE) AS height_in
        FROM {part} WHERE p_partkey IN (SELECT l_partkey FROM {lineitem})""",
    # the label grid of table contracts
    "tgt_cell": """
        SELECT h.target_id, 0 AS row_ix,
               CAST(row_number() OVER (PARTITION BY h.target_id ORDER BY c.pos) - CASE WHEN h.k % 20 = 18 THEN 0 ELSE 1 END AS INT) AS col_ix,
               c.label AS text
        FROM tgt_head h JOIN tgt_col c ON h.k = c.k WHERE h.object_type = 'table'
        UNION ALL
        SELECT h.target_id, CAST(row_number() OVER (PARTITION BY h.target_id ORDER BY r.pos, r.label) AS INT), 0, r.label
        FROM tgt_head h JOIN tgt_row r ON h.k = r.k WHERE h.object_type = 'table' AND h.k % 20 = 18""",
    # sheets with a second block, and their row count
    "note": "SELECT k, max(ix) + 1 AS n FROM src_row WHERE k >= 0 AND k % 9 = 4 GROUP BY k",
    # raw sheets: a title, an id line, a header of years, labelled rows, sometimes a second block
    "sheet_cell": """
        SELECT 'p' || p_partkey AS table_id, 0 AS row_ix, CAST(p_partkey % 3 AS INT) AS col_ix,
               p_name || ' report' AS raw, CAST(NULL AS DOUBLE) AS num, 'General' AS fmt
        FROM {part} WHERE p_partkey IN (SELECT k FROM xt)
        UNION ALL
        SELECT 'p' || p_partkey, 1, CAST(p_partkey % 3 AS INT),
               CASE WHEN p_partkey % 2 = 0 THEN 'Graph ID: G' || p_partkey ELSE 'GRAPH ID' END, NULL, 'General'
        FROM {part} WHERE p_partkey IN (SELECT k FROM xt)
        UNION ALL
        SELECT 'p' || p_partkey, 1, CAST(1 + p_partkey % 3 AS INT), 'G' || p_partkey, NULL, 'General'
        FROM {part} WHERE p_partkey % 2 = 1 AND p_partkey IN (SELECT k FROM xt)
        UNION ALL
        SELECT 'p' || k, CAST(3 + k % 2 AS INT), CAST(1 + k % 3 + ix AS INT), label, NULL, 'General' FROM src_col WHERE k >= 0
        UNION ALL
        SELECT 'p' || k, CAST(4 + k % 2 + ix AS INT), CAST(k % 3 AS INT), label, NULL, 'General'
        FROM src_row WHERE k >= 0 AND nk % 11 <> 7
        UNION ALL
        SELECT 'p' || x.k, CAST(4 + x.k % 2 + r.ix AS INT), CAST(1 + x.k % 3 + c.ix AS INT), NULL, CAST(x.cents AS DOUBLE) / 100,
               CASE WHEN (x.k + x.nk) % 4 = 0 THEN '0.0' WHEN (x.k + x.nk) % 4 = 1 THEN 'General'
                    WHEN (x.k + x.nk) % 4 = 2 THEN '#,##0.0' ELSE '0.00' END
        FROM xt x JOIN src_row r ON x.k = r.k AND x.nk = r.nk JOIN src_col c ON x.k = c.k AND x.yr = c.yr
        UNION ALL
        SELECT 'p' || k, CAST(5 + k % 2 + n AS INT), CAST(k % 3 AS INT), 'Note 0', NULL, 'General' FROM note
        UNION ALL
        SELECT 'p' || k, CAST(5 + k % 2 + n AS INT), CAST(k % 3 + 1 AS INT), NULL, CAST(0 AS DOUBLE), 'General' FROM note
        UNION ALL
        SELECT 'p' || k, CAST(6 + k % 2 + n AS INT), CAST(k % 3 AS INT), 'Note 1', NULL, 'General' FROM note
        UNION ALL
        SELECT 'p' || k, CAST(6 + k % 2 + n AS INT), CAST(k % 3 + 1 AS INT), NULL, CAST(1.5 AS DOUBLE), 'General' FROM note""",
    # two-column sheets without a header, one per customer
    "kv_cell": """
        SELECT 'c' || o_custkey AS table_id, row_ix, CAST(o_custkey % 2 AS INT) AS col_ix,
               CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderkey AS STRING) ELSE 'Order ' || o_orderkey END AS raw,
               CAST(NULL AS DOUBLE) AS num
        FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS row_ix FROM {orders}) a
        UNION ALL
        SELECT 'c' || o_custkey, row_ix, CAST(1 + o_custkey % 2 AS INT), NULL, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END
        FROM (SELECT o_custkey, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS row_ix FROM {orders}) b""",
    # files with the many spellings of a page hint
    # sheets of every shape: as above, turned, with one row of data, without a header, with a title only, blank
    "loose_cell": """
        SELECT table_id, row_ix, col_ix, raw, num, fmt FROM sheet_cell WHERE CAST(substr(table_id, 2) AS BIGINT) % 4 <> 1
        UNION ALL
        SELECT 't' || substr(table_id, 2), col_ix, row_ix, raw, num, fmt FROM sheet_cell WHERE CAST(substr(table_id, 2) AS BIGINT) % 3 = 0
        UNION ALL
        SELECT 'o' || substr(table_id, 2), row_ix, col_ix, raw, num, fmt FROM sheet_cell
        WHERE CAST(substr(table_id, 2) AS BIGINT) % 4 = 1 AND row_ix <= 4 + CAST(substr(table_id, 2) AS BIGINT) % 2
        UNION ALL
        SELECT table_id, row_ix, col_ix, raw, num, 'General' FROM kv_cell
        UNION ALL
        SELECT 'u' || substr(table_id, 2), row_ix, col_ix, raw, num, fmt FROM sheet_cell WHERE CAST(substr(table_id, 2) AS BIGINT) % 5 = 0 AND row_ix = 0
        UNION ALL
        SELECT 'e' || substr(table_id, 2), row_ix, col_ix, '  ', CAST(NULL AS DOUBLE), 'General' FROM sheet_cell WHERE CAST(substr(table_id, 2) AS BIGINT) % 7 = 0 AND row_ix = 0""",
    "file": """
        SELECT page_id, CASE page_id % 9
                 WHEN 0 THEN 'slide_' || lpad(CAST(page_id % 40 AS STRING), 3, '0') || '/'
                 WHEN 1 THEN 'Slide ' || (page_id % 40) || '/' WHEN 2 THEN 's' || (page_id % 40) || '/'
                 WHEN 3 THEN lpad(CAST(page_id % 40 AS STRING), 3, '0') || '/' ELSE 'src/' END
               || replace(substr(url, 9, 8), '/', '-') || CASE page_id % 9
                 WHEN 4 THEN '_slide' || (page_id % 40) WHEN 5 THEN '_s' || (page_id % 40) WHEN 6 THEN '-SLIDE0' || (page_id % 40)
                 WHEN 7 THEN ' slides ' || (page_id % 40) ELSE '' END || CASE WHEN page_id % 8 = 7 THEN '.csv' ELSE '.xlsx' END AS path
        FROM {pages}""",
    # prepared mapping rows as a person fills them in, a few of them twice
    "mapping_once": """
        SELECT h.k, CASE WHEN h.k % 17 = 5 THEN 'X' || h.k ELSE h.target_id END AS target_id,
               CASE h.k % 6 WHEN 0 THEN 'Sim' WHEN 1 THEN '1' WHEN 2 THEN '' WHEN 3 THEN 'não' WHEN 4 THEN 'ativo' ELSE 'talvez' END AS active,
               CASE WHEN h.k % 13 = 0 THEN '' WHEN h.k % 13 = 1 THEN 'missing_' || h.k || '.xlsx'
                    ELSE upper(replace(p.p_name, ' ', '_')) || '_' || h.k || '.XLSX' END AS file_name,
               CASE h.k % 7 WHEN 0 THEN 'Data' WHEN 1 THEN 'Outra' ELSE '' END AS sheet_name,
               CASE h.k % 6 WHEN 0 THEN 'auto' WHEN 1 THEN 'Tabela' WHEN 2 THEN 'dinâmico' WHEN 3 THEN 'exact' WHEN 4 THEN 'Automático' ELSE 'outro' END AS read_mode,
               CASE h.k % 5 WHEN 0 THEN 'A2:F8' WHEN 1 THEN 'SALES' || h.k WHEN 2 THEN '' WHEN 3 THEN '$B$2' ELSE 'bad ref!' END AS reference,
               CASE h.k % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'keep' WHEN 2 THEN 'Transpor' ELSE '' END AS orientation,
               CASE h.k % 5 WHEN 0 THEN 'auto' WHEN 1 THEN 'percent' WHEN 2 THEN 'Número' WHEN 3 THEN 'milhares' ELSE 'cor' END AS value_format
        FROM tgt_head h JOIN {part} p ON h.k = p.p_partkey WHERE h.k % 19 <> 3""",
    "mapping": "SELECT * FROM mapping_once UNION ALL SELECT * FROM mapping_once WHERE k % 50 = 0",
    # numbers as people type them
    "number_text": """
        SELECT o_orderkey AS id, CASE o_orderkey % 12
                 WHEN 0 THEN i || '.' || d WHEN 1 THEN i || ',' || d
                 WHEN 2 THEN CAST(floor(i / 1000) AS BIGINT) || '.' || lpad(CAST(i % 1000 AS STRING), 3, '0') || ',' || d
                 WHEN 3 THEN i || '%' WHEN 4 THEN ',' || d WHEN 5 THEN '-,' || d WHEN 6 THEN o_orderpriority
                 WHEN 7 THEN ' ' || (i % 10) || ' ' WHEN 8 THEN 'nan' WHEN 9 THEN '0' || i WHEN 10 THEN 'Nov/' || (i % 90 + 10)
                 ELSE (i % 20 + 1) || '-' || (i % 10 + 1) END AS raw
        FROM (SELECT o_orderkey, o_orderpriority, CAST(floor(o_totalprice) AS BIGINT) AS i,
                     lpad(CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 100 AS STRING), 2, '0') AS d FROM {orders}) o""",
    # answer labels, some of them covered by the domain rules
    "phrase": """
        SELECT p_partkey AS k, CASE p_partkey % 11 WHEN 0 THEN 'Auto consumo' WHEN 1 THEN 'Uso próprio' WHEN 2 THEN 'Não compro ' || p_name
                 WHEN 3 THEN 'Não tem auto consumo' WHEN 4 THEN 'Até 25% ' || p_type WHEN 5 THEN 'até 25' WHEN 6 THEN 'Entre 26-50%' WHEN 7 THEN 'Mais de 75% +'
                 WHEN 8 THEN p_type || ' ' || p_name WHEN 9 THEN 'Compro para uso próprio' ELSE p_name || ' ' || p_brand END AS label
        FROM {part}""",
    # named regions of the sheets
    "named_region": """
        SELECT k, table_id, 'Sales' || k AS region_name, CAST(3 + k % 2 AS INT) AS r0, CAST(k % 3 AS INT) AS c0,
               CAST(8 + k % 4 AS INT) AS r1, CAST(k % 3 + 4 AS INT) AS c1
        FROM src_head WHERE k >= 0 AND k % 2 = 1""",
    # call log
    "usage": """
        SELECT event_id AS call_id, ts AS returned_at, event_type AS operation,
               CASE WHEN user_id % 10 = 0 THEN 'error' ELSE 'ok' END AS status,
               CASE WHEN event_id % 3 = 0 THEN 'Small-2024' WHEN event_id % 3 = 1 THEN 'large' ELSE 'unlisted' END AS model,
               CAST(floor(value * 10) AS BIGINT) AS input_tokens, CAST(floor(value * 3) AS BIGINT) AS cached_input_tokens,
               event_id % 100 AS output_tokens, CASE WHEN event_id % 5 = 0 THEN 0 ELSE CAST(floor(value * 10) AS BIGINT) + event_id % 100 END AS total_tokens,
               event_id % 700 AS duration_ms
        FROM {events}""",
    "progress": """
        SELECT user_id AS job_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'complete' ELSE event_type END AS phase,
               CAST(event_id % 50 AS INT) AS completed, 50 AS total, 'T' || (event_id % 50) AS target_id
        FROM {events}""",
    "audit": """
        SELECT CAST(event_id AS STRING) AS event_id, ts AS at, 'tenant' || (user_id % 7) AS tenant,
               CASE WHEN user_id % 13 = 0 THEN '' ELSE 'user' || user_id || '@example.com' END AS actor, event_type AS action
        FROM {events}
        UNION ALL
        SELECT CAST(event_id AS STRING), ts, 'tenant' || (user_id % 7),
               CASE WHEN user_id % 13 = 0 THEN '' ELSE 'user' || user_id || '@example.com' END, event_type
        FROM {events} WHERE event_id % 20 = 0""",
    "users": """
        SELECT 'user' || c_custkey || '@example.com' AS email, 'tenant' || (c_custkey % 7) AS tenant,
               CASE WHEN c_custkey % 20 = 1 THEN 'admin' ELSE 'member' END AS role, c_custkey % 9 <> 0 AS active, c_name AS name
        FROM {customer}""",
    # remembered mappings of an earlier run: some names changed, some contracts rebuilt
    "learned": """
        SELECT h.k AS entry_ix, 'tpl' || (h.k % 20) AS template,
               CASE WHEN h.k % 4 = 1 THEN 'old-' || h.k WHEN h.k % 4 = 2 THEN h.shape_name ELSE h.target_id END AS entry_id,
               CASE WHEN h.k % 8 = 1 THEN h.shape_id ELSE 'gone-' || h.k END AS alias,
               CASE WHEN h.k % 5 = 2 THEN 'renamed_' || h.k || '.xlsx' ELSE replace(p.p_name, ' ', '_') || '_' || h.k || '.xlsx#Data' END AS basename,
               CASE WHEN h.k % 3 = 0 THEN 'A1:C9' ELSE '' END AS cell_range, CASE WHEN h.k % 6 = 0 THEN 'dynamic' ELSE '' END AS range_mode
        FROM tgt_head h JOIN {part} p ON h.k = p.p_partkey WHERE h.k % 9 <> 4""",
    "suggestion": """
        SELECT h.k, CASE WHEN h.k % 11 = 0 THEN 'X' || h.k ELSE h.target_id END AS target_id,
               CASE WHEN h.k % 13 = 0 THEN 'nowhere.xlsx' ELSE s.table_id END AS table_id,
               CAST(h.k % 100 AS DOUBLE) / 100.0 AS confidence, h.k % 3 = 0 AS replace_existing
        FROM tgt_head h JOIN src_head s ON s.k = h.k + CASE WHEN h.k % 4 = 0 THEN 1 ELSE 0 END WHERE h.k % 2 = 0""",
    # one plan header per contract of an earlier run
    "job": """
        SELECT h.k, h.target_id, h.block_id, h.object_type,
               CASE WHEN h.k % 5 = 4 THEN NULL ELSE s.table_id END AS table_id,
               CASE WHEN h.k % 5 = 4 THEN NULL ELSE CAST((h.k * 37) % 101 AS DOUBLE) / 100.0 END AS score,
               CASE WHEN h.k % 5 = 4 THEN NULL ELSE CASE WHEN h.k % 7 = 0 THEN 1 ELSE 0 END END AS warned,
               h.k % 12 = 0 AS manual, h.k % 10 = 3 AS ai
        FROM tgt_head h JOIN src_head s ON h.k = s.k WHERE h.object_type IN ('chart', 'table')""",
    # boxes of text around the contracts
    "text_box": """
        SELECT block_id, CAST(k * 10 AS BIGINT) AS box_ix, title || ' box ' || k AS text, CAST(left_in + 0.25 AS DOUBLE) AS left_in, CAST(top_in - 0.5 AS DOUBLE) AS top_in,
               CAST(3.0 AS DOUBLE) AS width_in, CAST(0.375 AS DOUBLE) AS height_in FROM tgt_head WHERE title <> ''
        UNION ALL
        SELECT block_id, CAST(k * 10 + 1 AS BIGINT), nearby_text || ' ' || k, CAST(left_in + 1.75 AS DOUBLE), CAST(top_in + 2.75 AS DOUBLE), CAST(2.5 AS DOUBLE), CAST(0.25 AS DOUBLE) FROM tgt_head""",
    "delivery": """
        SELECT o_orderkey AS id, CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 23 = 0 THEN o_totalprice + 1
                    WHEN o_orderkey % 29 = 0 THEN o_totalprice * (1 + 1e-12) ELSE o_totalprice END AS amount,
               CASE WHEN o_orderkey % 37 = 0 THEN '' WHEN o_orderkey % 41 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS note
        FROM {orders} WHERE o_orderkey % 43 <> 0
        UNION ALL SELECT -1 - o_orderkey, o_totalprice, o_orderpriority FROM {orders} WHERE o_orderkey % 97 = 0""",
}

#: Roles whose text differs between the engines (splitting text into rows).
SPLIT_ROLES: dict[str, tuple[str, str]] = {
    "doc_line": (
        "SELECT doc_id, CAST(pos AS INT) AS row_ix, line FROM {documents} LATERAL VIEW posexplode(split(text, '\\n')) t AS pos, line",
        "SELECT doc_id, CAST(i - 1 AS INT) AS row_ix, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l, "
        "unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM {documents}) t",
    ),
    "doc_cell": (
        "SELECT doc_id, row_ix, CAST(pos AS INT) AS col_ix, trim(cell) AS raw FROM doc_line "
        "LATERAL VIEW posexplode(split(line, ',')) t AS pos, cell",
        "SELECT doc_id, row_ix, CAST(i - 1 AS INT) AS col_ix, trim(l[i]) AS raw FROM (SELECT doc_id, row_ix, string_split(line, ',') AS l, "
        "unnest(range(1, len(string_split(line, ',')) + 1)) AS i FROM doc_line) t",
    ),
}

#: The sales of all sheets with their places on both axes, which the SQL finds by joining the axes.  The first sale of a row or column
#: stands for its label, so that axes and values are read from one kept table without a further shuffle.
_AXES_BY_JOIN = "x JOIN src_row r ON x.k = r.k AND x.nk = r.nk JOIN src_col c ON x.k = c.k AND x.yr = c.yr"
_SOLD = "(SELECT k FROM xt)"
SPARK_ROLES: dict[str, str] = {
    # by one sort for the rows and one for the columns: the places are counted in the order that the first sales need
    "src_cell": """
        SELECT k, nk, label, yr, cents, row_ix, CAST(dense_rank() OVER (PARTITION BY k ORDER BY yr) - 1 AS INT) AS col_ix, heads_row, heads_col
        FROM (SELECT *, row_number() OVER (PARTITION BY k, yr ORDER BY nk) = 1 AS heads_col
              FROM (SELECT *, CAST(dense_rank() OVER (PARTITION BY k ORDER BY nk) - 1 AS INT) AS row_ix
                    FROM (SELECT *, row_number() OVER (PARTITION BY k, nk ORDER BY yr) = 1 AS heads_row FROM (SELECT * FROM src_xt DISTRIBUTE BY k) x) a) b) c""",
    **{role: ROLES[role].replace("(SELECT l_partkey FROM {lineitem})", "(SELECT l_partkey FROM sold)") for role in ("src_head", "tgt_head")},
    "src_row": "SELECT k, nk, label, row_ix AS ix FROM src_cell WHERE heads_row",
    "src_col": "SELECT k, yr, CAST(yr AS STRING) AS label, col_ix AS ix FROM src_cell WHERE heads_col",
    "src_value": """
        SELECT h.table_id, x.row_ix, x.col_ix, CAST(x.cents AS DOUBLE) / 100 AS num
        FROM src_cell x JOIN src_head h ON x.k = h.k WHERE h.readable = 1 AND x.yr IS NOT NULL""",
    "tgt_row": ROLES["tgt_row"].replace("(SELECT DISTINCT k, nk, label FROM xt) d WHERE", "src_cell WHERE heads_row AND k >= 0 AND"),
    "tgt_col": ROLES["tgt_col"].replace("(SELECT DISTINCT k, yr FROM xt) d WHERE", "src_cell WHERE heads_col AND k >= 0 AND"),
    "sheet_cell": ROLES["sheet_cell"].replace(f"xt {_AXES_BY_JOIN}", "src_cell x WHERE x.k >= 0 AND x.yr IS NOT NULL")
    .replace("r.ix", "x.row_ix").replace("c.ix", "x.col_ix").replace(_SOLD, "(SELECT k FROM src_cell WHERE heads_row AND row_ix = 0)"),
    # one pass over the sheets
    "loose_cell": """
        SELECT inline(array_compact(array(
            CASE WHEN k % 4 <> 1 THEN named_struct('table_id', table_id, 'row_ix', row_ix, 'col_ix', col_ix, 'raw', raw, 'num', num, 'fmt', fmt) END,
            CASE WHEN k % 3 = 0 THEN named_struct('table_id', 't' || part, 'row_ix', col_ix, 'col_ix', row_ix, 'raw', raw, 'num', num, 'fmt', fmt) END,
            CASE WHEN k % 4 = 1 AND row_ix <= 4 + k % 2 THEN named_struct('table_id', 'o' || part, 'row_ix', row_ix, 'col_ix', col_ix, 'raw', raw, 'num', num, 'fmt', fmt) END,
            CASE WHEN k % 5 = 0 AND row_ix = 0 THEN named_struct('table_id', 'u' || part, 'row_ix', row_ix, 'col_ix', col_ix, 'raw', raw, 'num', num, 'fmt', fmt) END,
            CASE WHEN k % 7 = 0 AND row_ix = 0 THEN named_struct('table_id', 'e' || part, 'row_ix', row_ix, 'col_ix', col_ix, 'raw', '  ', 'num', CAST(NULL AS DOUBLE), 'fmt', 'General') END)))
        FROM (SELECT *, substr(table_id, 2) AS part, CAST(substr(table_id, 2) AS BIGINT) AS k FROM sheet_cell) s
        UNION ALL
        SELECT table_id, row_ix, col_ix, raw, num, 'General' FROM kv_cell""",
}
#: Roles that Spark writes once per session and scale: most others start from them, several more than once.
KEPT_ROLES = ("xt", "src_cell", "sold")

_ORDER = ["src_cell", *ROLES, *SPLIT_ROLES]


def _text(role: str, engine: int) -> str:
    if engine == 0 and role in SPARK_ROLES:
        return SPARK_ROLES[role]
    return ROLES[role] if role in ROLES else SPLIT_ROLES[role][engine]


def _relations(text: str) -> str:
    """The parts of a text that can name a relation (after FROM and JOIN)."""
    return " ".join(re.findall(r"(?:FROM|JOIN)\s+(\w+)", text, flags=re.I))


def duck_sql(body: str) -> str:
    """``body`` with the roles it uses put in front as common table expressions."""
    todo, found = [body], set()
    while todo:
        names = set(_relations(todo.pop()).split())
        for role in _ORDER:
            if role in names and role not in found:
                found.add(role)
                todo.append(_text(role, 1))
    ctes = [f"{role} AS ({_text(role, 1)})" for role in _ORDER if role in found]
    text = ", ".join(ctes)
    body = body.strip()
    if re.match(r"WITH\s+RECURSIVE\b", body, flags=re.I):
        body = re.sub(r"^WITH\s+RECURSIVE", "", body, flags=re.I)
        out = f"WITH RECURSIVE {text + ', ' if text else ''}{body}"
    elif re.match(r"WITH\b", body, flags=re.I):
        out = f"WITH {text + ', ' if text else ''}{re.sub(r'^WITH', '', body, flags=re.I)}"
    else:
        out = f"WITH {text} {body}" if text else body
    return re.sub(r"\{(\w+)\}", lambda m: m.group(1) if m.group(1) in TABLES else m.group(0), out)


_KEPT: dict[tuple, DataFrame] = {}


class Roles:
    """The given tables of one scale, and the roles derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")
        prepare(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def role(self, name: str) -> DataFrame:
        return self.sql(f"SELECT * FROM {name}")

    def sql(self, body: str) -> DataFrame:
        todo, found = [body], set()
        while todo:
            names = set(_relations(todo.pop()).split())
            for role in _ORDER:
                if role in names and role not in found:
                    found.add(role)
                    if role not in KEPT_ROLES:
                        todo.append(_text(role, 0))
        text = {role: self._kept_view(role) if role in KEPT_ROLES else _text(role, 0) for role in found}
        ctes = ", ".join(f"{role} AS ({text[role]})" for role in _ORDER if role in found)
        return self.spark.sql(self._located(f"WITH {ctes} {body}" if ctes else body))

    def _kept_view(self, role: str) -> str:
        """The text that reads a kept role."""
        view = f"tabweave_kept_{role}"
        self.kept(role, lambda: self.sql(_text(role, 0))).createOrReplaceTempView(view)
        return f"SELECT * FROM {view}"

    def _located(self, text: str) -> str:
        return re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{self.dir}/{m.group(1)}.parquet`", text)

    def kept(self, name: str, build) -> DataFrame:
        """A table many queries start from, written once per session and scale."""
        key = (self.spark.sparkContext.applicationId, self.dir, name)
        if key not in _KEPT:
            _KEPT[key] = cut_lineage(build(), name)
        return _KEPT[key]

    def kept_once(self, name: str, build):
        """What ``build`` gives, which keeps its own tables, made once per session and scale."""
        key = (self.spark.sparkContext.applicationId, self.dir, name)
        if key not in _KEPT:
            _KEPT[key] = build()
        return _KEPT[key]

    # --- roles with arrays -------------------------------------------------

    def source_tables(self) -> DataFrame:
        """tables: one row per sheet with its two axes as arrays."""
        return self.kept("source_table", self._source_tables)

    def targets(self) -> DataFrame:
        """targets: one row per contract with its expected axes as arrays."""
        return self.kept("target", self._targets)

    def _source_tables(self) -> DataFrame:
        rows = self.role("src_row").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("ix", "label"))).alias("r"))
        cols = self.role("src_col").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("ix", "label"))).alias("c"))
        return (
            self.role("src_head").join(rows, "k").join(cols, "k")
            .select(
                "k", "table_id", F.split_part("table_id", F.lit("#"), F.lit(1)).alias("file_name"), F.lit("Data").alias("sheet_name"),
                "block_id", "table_ix", "source_id", F.lit("series_rows_categories_columns").alias("orientation"),
                F.col("c.label").alias("categories"), F.col("r.label").alias("series"), "title", "graph_id", "readable",
            )
        )

    def _targets(self) -> DataFrame:
        rows = self.role("tgt_row").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("pos", "label"))).alias("r"))
        cols = self.role("tgt_col").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("pos", "label"))).alias("c"))
        empty = F.array().cast("array<string>")
        width = self.role("tgt_cell").groupBy("target_id").agg((F.max("col_ix") + 1).alias("table_width"))
        texts = (
            self.role("tgt_cell").groupBy("target_id")
            .agg(F.array_sort(F.collect_list(F.struct("row_ix", "col_ix", "text"))).alias("g"))
            .select("target_id", F.col("g.text").alias("cell_texts"))
        )
        is_chart = F.col("object_type") == "chart"
        r = F.coalesce(F.col("r.label"), empty)
        c = F.coalesce(F.col("c.label"), empty)
        return (
            self.role("tgt_head").join(rows, "k", "left").join(cols, "k", "left").join(width, "target_id", "left").join(texts, "target_id", "left")
            .select(
                "k", "target_id", "block_id", "target_ix", "object_type", "shape_name", "shape_id", "orientation",
                F.when(~is_chart, empty).when(F.col("k") % 3 == 1, r).otherwise(c).alias("categories"),
                F.when(~is_chart, empty).when(F.col("k") % 3 == 1, c).otherwise(r).alias("series"),
                "nearby_text", "title", F.coalesce("table_width", F.lit(0)).alias("table_width"),
                "left_in", "top_in", "width_in", "height_in", F.coalesce("cell_texts", empty).alias("cell_texts"),
            )
        )


# The two array roles for the SQL side.
ROLES["source_table"] = """
        SELECT h.k, h.table_id, split_part(h.table_id, '#', 1) AS file_name, 'Data' AS sheet_name, h.block_id, h.table_ix, h.source_id,
               'series_rows_categories_columns' AS orientation,
               (SELECT list(c.label ORDER BY c.ix) FROM src_col c WHERE c.k = h.k) AS categories,
               (SELECT list(r.label ORDER BY r.ix) FROM src_row r WHERE r.k = h.k) AS series, h.title, h.graph_id, h.readable
        FROM src_head h WHERE h.k IN (SELECT k FROM src_row)"""
ROLES["target"] = """
        SELECT h.k, h.target_id, h.block_id, h.target_ix, h.object_type, h.shape_name, h.shape_id, h.orientation,
               CASE WHEN h.object_type <> 'chart' THEN [] WHEN h.k % 3 = 1 THEN coalesce(r.l, []) ELSE coalesce(c.l, []) END AS categories,
               CASE WHEN h.object_type <> 'chart' THEN [] WHEN h.k % 3 = 1 THEN coalesce(c.l, []) ELSE coalesce(r.l, []) END AS series,
               h.nearby_text, h.title, coalesce(w.table_width, 0) AS table_width, h.left_in, h.top_in, h.width_in, h.height_in,
               coalesce(x.l, []) AS cell_texts
        FROM tgt_head h LEFT JOIN (SELECT k, list(label ORDER BY pos, label) AS l FROM tgt_row GROUP BY k) r ON r.k = h.k
        LEFT JOIN (SELECT k, list(label ORDER BY pos, label) AS l FROM tgt_col GROUP BY k) c ON c.k = h.k
        LEFT JOIN (SELECT target_id, max(col_ix) + 1 AS table_width FROM tgt_cell GROUP BY target_id) w ON w.target_id = h.target_id
        LEFT JOIN (SELECT target_id, list(text ORDER BY row_ix, col_ix) AS l FROM tgt_cell GROUP BY target_id) x ON x.target_id = h.target_id"""
_ORDER.extend(["source_table", "target"])


def norm_sql(x: str, plus: bool = True) -> str:
    """SQL text of the label normalization."""
    base = f"coalesce(CAST({x} AS VARCHAR), '')"
    if plus:
        base = f"replace({base}, '+', ' PLUS ')"
    return f"trim(regexp_replace(upper(strip_accents(replace({base}, 'ß', 'ss'))), '[^A-Z0-9]+', ' ', 'g'))"


def overlap_sql(a: str, b: str) -> str:
    """SQL text of the word overlap of two normalized texts."""
    la, lb = (f"list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> ''))" for x in (a, b))
    return f"(CAST(len(list_intersect({la}, {lb})) AS DOUBLE) / greatest(len({la}), len({lb}), 1))"


def soft_sql(a: str, b: str) -> str:
    """SQL text of the soft score of two normalized texts."""
    bands = " ".join(
        f"WHEN contains({a}, '{p}') AND contains({b}, '{p}') THEN 0.96" for p in ("ATE 25", "26 50", "51 75", "MAIS DE 75")
    )
    return f"""(CASE WHEN {a} = '' OR {b} = '' THEN 0.0
        WHEN contains({a} || ' ' || {b}, 'AUTO CONSUMO') AND contains({a} || ' ' || {b}, 'USO PROPRIO')
             AND (contains({a} || ' ' || {b}, 'NAO') OR contains({a} || ' ' || {b}, 'COMPRO')) THEN 0.9
        WHEN contains({a} || ' ' || {b}, 'NAO TEM AUTO CONSUMO') AND contains({a} || ' ' || {b}, 'NAO COMPRO') THEN 0.95
        {bands} WHEN {a} = {b} THEN 1.0 WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 0.9
        ELSE {overlap_sql(a, b)} END)"""
