"""Sources, scalar projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import choices, dates, hashing, numbers, text
from ..operators import filters
from ..session import ensure_checkpoint_dir
from ..sources import cells, files, logs, mapping, publish
from .registry import query
from .roles import norm_sql

# --- sources and sinks ---------------------------------------------------------


@query("cells_from_table", """
    SELECT 'customer' AS table_id, c_custkey AS row_ix, 0 AS col_ix, c_name AS raw, CAST(NULL AS DOUBLE) AS num, 'General' AS fmt FROM customer
    UNION ALL SELECT 'customer', c_custkey, 1, NULL, CAST(c_nationkey AS DOUBLE), 'General' FROM customer
    UNION ALL SELECT 'customer', c_custkey, 2, NULL, c_acctbal, 'General' FROM customer
    UNION ALL SELECT 'customer', c_custkey, 3, c_mktsegment, NULL, 'General' FROM customer""")
def cells_from_table(r):
    return cells.to_cells(r.table("customer"), F.lit("customer"), "c_custkey", ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])


@query("source_ids", """
    SELECT table_id AS source_id, split_part(table_id, '#', 1) AS file_name, 'Data' AS sheet_name FROM src_head""")
def source_ids(r):
    heads = r.role("src_head").select(cells.file_of("table_id").alias("f"), cells.sheet_of("table_id").alias("s"))
    rebuilt = heads.select(cells.source_id_of("f", "s").alias("source_id"))
    return rebuilt.select("source_id", cells.file_of("source_id").alias("file_name"), cells.sheet_of("source_id").alias("sheet_name"))


@query("prune_sources", """
    SELECT table_id, CAST(count(*) AS BIGINT) AS n_cells, max(row_ix) AS last_row FROM src_value
    WHERE table_id IN (SELECT table_id FROM suggestion WHERE confidence >= 0.5) GROUP BY table_id""")
def prune_sources(r):
    wanted = r.role("suggestion").where("confidence >= 0.5")
    kept = cells.prune_sources(r.role("src_value"), wanted)
    return kept.groupBy("table_id").agg(F.count("*").alias("n_cells"), F.max("row_ix").alias("last_row"))


HINT_PATH_SQL = """coalesce(
        CASE WHEN contains(path, '/') THEN CASE WHEN TRY_CAST(nullif(regexp_extract(lower(regexp_replace(split_part(path, '/', 1), '[\\s_-]+', '', 'g')), '^(?:slide|s)?0*(\\d+)$', 1), '') AS INT) > 0
            THEN CAST(regexp_extract(lower(regexp_replace(split_part(path, '/', 1), '[\\s_-]+', '', 'g')), '^(?:slide|s)?0*(\\d+)$', 1) AS INT) END END,
        CASE WHEN TRY_CAST(nullif(regexp_extract(regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', ''), '(?i)(?:^|[\\s_-])(?:slide|s)0*(\\d+)$', 1), '') AS INT) > 0
            THEN CAST(regexp_extract(regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', ''), '(?i)(?:^|[\\s_-])(?:slide|s)0*(\\d+)$', 1) AS INT) END)"""


@query("file_manifest", f"""
    SELECT page_id, path, {HINT_PATH_SQL} AS block_id, {HINT_PATH_SQL} IS NULL AS is_general
    FROM file WHERE lower(path) LIKE '%.xlsx'""")
def file_manifest(r):
    return files.file_manifest(r.role("file"))


@query("content_hash", "SELECT page_id, sha256(html) AS sha256 FROM pages")
def content_hash(r):
    return files.content_hash(r.table("pages").select("page_id", F.col("html").alias("content")))


def _choice_sql(col, allowed):
    key = f"replace(lower({norm_sql(col, plus=False)}), ' ', '_')"
    value = f"""CASE {key} WHEN '' THEN 'auto' WHEN 'automatico' THEN 'auto' WHEN 'tabela' THEN 'tabela_excel' WHEN 'exact' THEN 'exato'
        WHEN 'keep' THEN 'manter' WHEN 'transpose' THEN 'transpor' WHEN 'percent' THEN 'percentual' ELSE {key} END"""
    return value, f"({value}) IN ({', '.join(repr(a) for a in allowed)})"


def _active_sql(col):
    key = f"lower({norm_sql(col, plus=False)})"
    return (f"CASE WHEN {key} IN {choices_tuple(numbers.ACTIVE_WORDS)} THEN 1 WHEN {key} IN {choices_tuple(numbers.INACTIVE_WORDS)} THEN 0 END")


def choices_tuple(values):
    return "(" + ", ".join(repr(v) for v in values) + ")"


_RM, _RMV = _choice_sql("read_mode", choices.READ_MODES)
_OR, _ORV = _choice_sql("orientation", choices.ORIENTATIONS)
_VF, _VFV = _choice_sql("value_format", choices.VALUE_FORMATS)

LOADED_MAPPING_SQL = f"""
    SELECT trim(target_id) AS target_id, {_active_sql('active')} AS active, regexp_extract(file_name, '[^/]*$') AS file_name,
           trim(sheet_name) AS sheet_name, replace(trim(reference), '$', '') AS reference, {_RM} AS read_mode, {_OR} AS orientation, {_VF} AS value_format,
           {_RMV} AS read_mode_valid, {_ORV} AS orientation_valid, {_VFV} AS value_format_valid
    FROM mapping WHERE trim(target_id) <> ''"""


@query("load_mapping", LOADED_MAPPING_SQL)
def load_mapping(r):
    return mapping.load_mapping(r.role("mapping"))


@query("mapping_checks", f"""
    WITH m AS ({LOADED_MAPPING_SQL}),
    g AS (SELECT target_id, CASE WHEN count(*) > 1 THEN count(*) ELSE 0 END AS d, count(*) FILTER (active IS NULL) AS a,
                 count(*) FILTER (NOT read_mode_valid) AS r, count(*) FILTER (NOT orientation_valid) AS o,
                 count(*) FILTER (NOT value_format_valid) AS v FROM m GROUP BY target_id)
    SELECT target_id, 'duplicate_id' AS issue, d AS n FROM g WHERE d > 0 UNION ALL SELECT target_id, 'bad_active', a FROM g WHERE a > 0
    UNION ALL SELECT target_id, 'bad_read_mode', r FROM g WHERE r > 0 UNION ALL SELECT target_id, 'bad_orientation', o FROM g WHERE o > 0
    UNION ALL SELECT target_id, 'bad_value_format', v FROM g WHERE v > 0""")
def mapping_checks(r):
    return mapping.mapping_checks(mapping.load_mapping(r.role("mapping")))


LABELLED_SQL = """
    SELECT k, row_ix, CASE WHEN nk % 12 = 5 THEN 'Respondentes' WHEN nk % 12 = 7 THEN ' ' ELSE label END AS label, total
    FROM (SELECT s.k, r.ix AS row_ix, s.nk, s.label, CAST(sum(s.cents) AS BIGINT) AS total FROM src_xt s
          JOIN src_row r ON s.k = r.k AND s.nk = r.nk GROUP BY s.k, r.ix, s.nk, s.label) t"""


@query("split_base_row", f"""
    SELECT k, row_ix, label, total, label = 'Respondentes' AS is_base FROM ({LABELLED_SQL}) l WHERE trim(label) <> ''""")
def split_base_row(r):
    rows, base = cells.split_base_row(r.sql(LABELLED_SQL))
    return rows.withColumn("is_base", F.lit(False)).unionByName(base.withColumn("is_base", F.lit(True)))


def scratch(r, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    import uuid

    return f"{ensure_checkpoint_dir(r.spark)}/{name}-{uuid.uuid4().hex}"


@query("event_log_roundtrip", """
    SELECT call_id, operation, status, input_tokens, output_tokens, duration_ms FROM usage""")
def event_log_roundtrip(r):
    records = r.role("usage").select("call_id", "operation", "status", "input_tokens", "output_tokens", "duration_ms")
    path = scratch(r, "event-log")
    logs.append_events(records.where("status = 'ok'"), path)
    logs.append_events(records.where("status <> 'ok'"), path)
    return logs.read_events(r.spark, path, records.schema)


@query("run_report", """
    SELECT target_id, block_id, table_id, CAST(round(score * 100, 1) AS DOUBLE) AS confidence_percent, 'run-1' AS run_id FROM job WHERE table_id IS NOT NULL""")
def run_report(r):
    plans = r.role("job").where("table_id is not null").select(
        "target_id", "block_id", "table_id", F.round(F.col("score") * 100, 1).alias("confidence_percent"))
    path = scratch(r, "run-report")
    publish.write_run_report(plans, path, "run-0")
    publish.write_run_report(plans, path, "run-1")
    return r.spark.read.parquet(path).where("run_id = 'run-1'")


@query("publish_version", "SELECT target_id, table_id, score FROM job WHERE score >= 0.5")
def publish_version(r):
    root = scratch(r, "publish")
    plans = r.role("job").select("target_id", "table_id", "score")
    publish.publish_version(plans.where("score < 0.5"), root, "plans", "v1", "2024-01-01 00:00:00")
    publish.publish_version(plans.where("score >= 0.5"), root, "plans", "v2", "2024-01-02 00:00:00")
    return publish.read_current(r.spark, root, "plans")


@query("delivery_matrix", """
    SELECT * FROM (PIVOT (SELECT s.table_id, v.row_ix, 'y' || c.label AS label, v.num FROM src_value v JOIN src_head s ON v.table_id = s.table_id JOIN src_col c ON s.k = c.k AND v.col_ix = c.ix)
        ON label USING max(num) GROUP BY table_id, row_ix)""")
def delivery_matrix(r):
    long = r.sql("SELECT s.table_id, v.row_ix, 'y' || c.label AS label, v.num FROM src_value v JOIN src_head s ON v.table_id = s.table_id "
                 "JOIN src_col c ON s.k = c.k AND v.col_ix = c.ix")
    return publish.delivery_matrix(long, ["table_id", "row_ix"], "label", "num")


# --- scalar projections --------------------------------------------------------


@query("norm_label", f"""
    SELECT doc_id, {norm_sql('text')} AS plus_key, {norm_sql('text', plus=False)} AS plain_key FROM documents""")
def norm_label(r):
    return r.table("documents").select("doc_id", text.norm_label("text").alias("plus_key"), text.norm_label("text", plus=False).alias("plain_key"))


PLAIN_NUMBER_SQL = """CASE WHEN contains(t, ',') AND contains(t, '.') THEN replace(replace(t, '.', ''), ',', '.') ELSE replace(t, ',', '.') END"""


@query("parse_number", f"""
    SELECT id, CASE WHEN regexp_full_match(p, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN TRY_CAST(p AS DOUBLE) END AS number,
           CASE WHEN regexp_full_match(p, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN CAST(TRY_CAST(p AS DECIMAL(30, 6)) AS DOUBLE) END AS exact,
           CASE WHEN regexp_full_match(replace(trim(raw), ',', '.'), '[+-]?(\\d+\\.?\\d*|\\.\\d+)') THEN CAST(replace(trim(raw), ',', '.') AS DOUBLE) ELSE 0.0 END AS lenient
    FROM (SELECT id, raw, {PLAIN_NUMBER_SQL} AS p FROM (
        SELECT id, raw, regexp_replace(regexp_replace(trim(replace(trim(raw), '%', '')), '^,', '0,'), '^-,', '-0,') AS t FROM number_text) a) b""")
def parse_number(r):
    return r.role("number_text").select(
        "id", numbers.parse_number("raw").alias("number"), numbers.parse_decimal("raw").cast("decimal(30,6)").cast("double").alias("exact"),
        numbers.lenient_number("raw").alias("lenient"))


@query("cell_text", """
    SELECT table_id, row_ix, col_ix, CASE WHEN num = floor(num) THEN CAST(CAST(num AS BIGINT) AS VARCHAR) ELSE coalesce(trim(raw), '') END AS text FROM sheet_cell""")
def cell_text(r):
    return r.role("sheet_cell").select("table_id", "row_ix", "col_ix", text.cell_text("raw", "num").alias("text"))


@query("id_digits", """
    SELECT page_id, regexp_replace(trim(regexp_replace(regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', ''), '(^|[\\s_-])(slide|s)0*\\d+$', '', 'i')), '\\D', '', 'g') AS digits,
           CASE WHEN d <> '' AND len(d) < 10 THEN lpad(d, 10, '0') ELSE d END AS padded
    FROM (SELECT page_id, path, regexp_replace(path, '\\D', '', 'g') AS d FROM file) t""")
def id_digits(r):
    return r.role("file").select("page_id", text.id_digits(text.file_stem("path")).alias("digits"), text.padded_id("path").alias("padded"))


@query("block_hint", f"""
    SELECT page_id, {HINT_PATH_SQL} AS by_path,
           TRY_CAST(nullif(regexp_extract(path, '(?i)slide[_\\s-]*([0-9]{{1,3}})', 1), '') AS INT) AS by_text FROM file""")
def block_hint(r):
    return r.role("file").select("page_id", text.block_hint_path("path").alias("by_path"), text.block_hint_text("path").alias("by_text"))


@query("object_ids", """
    SELECT k, list_aggregate(list_distinct(regexp_extract_all(t, '(?i)obj[_\\s]*([0-9]{4,})', 1)), 'min') AS first_id,
           CAST(len(list_distinct(regexp_extract_all(t, '(?i)obj[_\\s]*([0-9]{4,})', 1))) AS INT) AS n_ids
    FROM (SELECT k, title || ' OBJ_' || (20000 + k % 7) || ' obj ' || (20000 + k % 3) || ' obj12' AS t FROM src_head) s""")
def object_ids(r):
    source = r.sql("SELECT k, title || ' OBJ_' || (20000 + k % 7) || ' obj ' || (20000 + k % 3) || ' obj12' AS t FROM src_head")
    found = text.object_ids("t")
    return source.select("k", F.array_min(found).alias("first_id"), F.size(found).alias("n_ids"))


@query("context_variants", """
    SELECT k, array_to_string(list_filter(list_concat([t], CASE WHEN contains(t, ' - ') THEN list_transform(string_split(t, ' - '), lambda p: trim(p)) ELSE [] END,
        CASE WHEN contains(t, ' | ') THEN list_transform(string_split(t, ' | '), lambda p: trim(p)) ELSE [] END,
        CASE WHEN contains(t, ':') THEN list_transform(string_split(t, ':'), lambda p: trim(p)) ELSE [] END), lambda p: p <> ''), '~') AS variants
    FROM (SELECT k, trim(CASE k % 4 WHEN 0 THEN nearby_text WHEN 1 THEN title || ' - ' || nearby_text WHEN 2 THEN 'P: ' || nearby_text || ': ' ELSE title END) AS t FROM tgt_head) s""")
def context_variants(r):
    source = r.sql("SELECT k, CASE k % 4 WHEN 0 THEN nearby_text WHEN 1 THEN title || ' - ' || nearby_text WHEN 2 THEN 'P: ' || nearby_text || ': ' ELSE title END AS t FROM tgt_head")
    return source.select("k", F.array_join(text.context_variants("t"), "~").alias("variants"))


@query("join_unique", f"""
    WITH parts AS (SELECT k, i, t, {norm_sql('t', plus=False)} AS key FROM (
        SELECT k, 1 AS i, trim(title) AS t FROM tgt_head UNION ALL SELECT k, 2, trim(nearby_text) FROM tgt_head
        UNION ALL SELECT k, 3, upper(trim(title)) || '!' FROM tgt_head UNION ALL SELECT k, 4, shape_name FROM tgt_head
        UNION ALL SELECT k, 5, lower(shape_name) FROM tgt_head) u WHERE t <> ''),
    firsts AS (SELECT k, i, t FROM parts QUALIFY row_number() OVER (PARTITION BY k, key ORDER BY i) = 1)
    SELECT k, string_agg(t, ' | ' ORDER BY i) AS joined FROM firsts GROUP BY k""")
def join_unique(r):
    return r.role("tgt_head").select("k", text.join_unique(F.array(
        F.col("title"), F.col("nearby_text"), F.concat(F.upper(F.trim("title")), F.lit("!")), F.col("shape_name"), F.lower("shape_name"))).alias("joined"))


@query("typed_cell", f"""
    SELECT id, raw AS value, CASE WHEN forced THEN 'text' ELSE 'number' END AS type, forced AS force_text, CASE WHEN forced THEN '' ELSE raw END AS source_raw FROM (
      SELECT id, raw, trim(raw) = '' OR trim(raw) LIKE '''%' OR regexp_full_match(trim(raw), '0\\d+')
        OR regexp_full_match(trim(raw), '(?i)(\\d{{1,2}}[/-]\\d{{2,4}}|\\d{{1,2}}-\\d{{1,2}}|\\d+Q\\d{{2,4}}|Q\\d{{1,2}}\\s*\\d{{2,4}}|[A-Za-zÀ-ÿ]{{3}}/\\d{{2,4}}|\\d{{2,}})')
        OR NOT regexp_full_match(p, '[+-]?(\\d+\\.?\\d*|\\.\\d+)') AS forced
      FROM (SELECT id, raw, {PLAIN_NUMBER_SQL} AS p FROM (
        SELECT id, raw, replace(regexp_replace(regexp_replace(trim(replace(trim(raw), '%', '')), '^,', '0,'), '^-,', '-0,'), ' ', '') AS t FROM number_text) a) b) c""")
def typed_cell(r):
    return r.role("number_text").select("id", choices.typed_cell("raw").alias("c")).select("id", "c.*")


@query("display_number", """
    SELECT id, CASE fmt WHEN '0%' THEN replace(printf('%.0f', num * 100), '.', ',') || '%' WHEN '0.0%' THEN replace(printf('%.1f', num * 100), '.', ',') || '%'
        WHEN '#,##0.0' THEN translate(format('{:,.1f}', num), ',.', '.,') WHEN '0.00;[Red]-0.0' THEN replace(printf('%.2f', num), '.', ',')
        ELSE replace(printf('%.1f', num), '.', ',') END AS shown
    FROM (SELECT l_orderkey * 1000 + l_partkey AS id, l_extendedprice / 700 AS num,
          CASE l_linenumber % 5 WHEN 0 THEN '0%' WHEN 1 THEN '0.0%' WHEN 2 THEN '#,##0.0' WHEN 3 THEN '0.00;[Red]-0.0' ELSE '' END AS fmt FROM lineitem) t""")
def display_number(r):
    source = r.sql("SELECT l_orderkey * 1000 + l_partkey AS id, l_extendedprice / 700 AS num, CASE l_linenumber % 5 WHEN 0 THEN '0%' WHEN 1 THEN '0.0%' "
                   "WHEN 2 THEN '#,##0.0' WHEN 3 THEN '0.00;[Red]-0.0' ELSE '' END AS fmt FROM {lineitem}")
    return source.select("id", numbers.display_number("num", "fmt").alias("shown"))


@query("display_table", """
    SELECT o_orderkey AS id, CASE WHEN num IS NULL THEN o_orderpriority WHEN num = floor(num) AND o_orderkey % 2 = 0 THEN replace(format('{:,}', CAST(num AS BIGINT)), ',', '.')
        WHEN num = floor(num) THEN CAST(CAST(num AS BIGINT) AS VARCHAR) ELSE replace(CAST(num AS VARCHAR), '.', ',') END AS shown
    FROM (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN o_totalprice WHEN 1 THEN floor(o_totalprice) END AS num FROM orders) t""")
def display_table(r):
    source = r.sql("SELECT o_orderkey AS id, o_orderpriority AS raw, CASE o_orderkey % 3 WHEN 0 THEN o_totalprice WHEN 1 THEN CAST(floor(o_totalprice) AS DOUBLE) END AS num, "
                   "o_orderkey % 2 = 0 AS thousands FROM {orders}")
    return source.select("id", numbers.display_table("raw", "num", F.col("thousands")).alias("shown"))


@query("legacy_scale", """
    SELECT l_orderkey * 1000 + l_partkey AS id, CASE WHEN abs(v) <= 1 THEN round(v * 100, 1) ELSE round(v, 1) END AS scaled
    FROM (SELECT l_orderkey, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN l_discount * 0.77 ELSE l_extendedprice / 700 END AS v FROM lineitem) t""")
def legacy_scale(r):
    source = r.table("lineitem").select(
        (F.col("l_orderkey") * 1000 + F.col("l_partkey")).alias("id"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount") * 0.77).otherwise(F.col("l_extendedprice") / 700).alias("v"))
    return source.select("id", numbers.legacy_scale("v").alias("scaled"))


@query("coerce_flags", f"""
    SELECT k, coalesce(lower(trim(active)) IN ('1', 'true', 'sim', 'yes', 'y') AND trim(active) <> '', false) AS truthy, {_active_sql('active')} AS active,
           CASE WHEN regexp_full_match(trim(n), '[+-]?\\d+') THEN TRY_CAST(trim(n) AS INT) END AS whole
    FROM (SELECT k, active, CASE k % 3 WHEN 0 THEN ' ' || k WHEN 1 THEN reference ELSE CAST(k AS VARCHAR) || '.5' END AS n FROM mapping) m""")
def coerce_flags(r):
    source = r.sql("SELECT k, active, CASE k % 3 WHEN 0 THEN ' ' || k WHEN 1 THEN reference ELSE CAST(k AS STRING) || '.5' END AS n FROM mapping")
    return source.select("k", numbers.truthy("active").alias("truthy"), numbers.active_flag("active").alias("active"), numbers.int_or_null("n").alias("whole"))


@query("normalize_choice", f"""
    SELECT k, {_RM} AS read_mode, {_RMV} AS read_mode_ok, {_VF} AS value_format, {_VFV} AS value_format_ok FROM mapping""")
def normalize_choice(r):
    m = r.role("mapping").select("k", choices.normalize_choice("read_mode", choices.READ_MODES).alias("a"), choices.normalize_choice("value_format", choices.VALUE_FORMATS).alias("b"))
    return m.select("k", F.col("a.value").alias("read_mode"), F.col("a.valid").alias("read_mode_ok"), F.col("b.value").alias("value_format"), F.col("b.valid").alias("value_format_ok"))


PERIOD_TEXT = """SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN CAST(year(o_orderdate) AS {S}) WHEN 1 THEN 'Set/' || (year(o_orderdate) % 100)
    WHEN 2 THEN 'dez ' || year(o_orderdate) WHEN 3 THEN o_orderpriority WHEN 4 THEN CAST(o_custkey AS {S}) WHEN 5 THEN '1/' || year(o_orderdate) ELSE 'Maio 24' END AS label FROM """


@query("is_period", f"""
    SELECT id, regexp_full_match({norm_sql('label', plus=False)}, '(19|20)\\d{{2}}|({dates.PERIOD_MONTHS})\\s*\\d{{2,4}}') AS periodic
    FROM ({PERIOD_TEXT.format(S='VARCHAR')} orders) t""")
def is_period(r):
    source = r.sql(PERIOD_TEXT.format(S="STRING") + "{orders}")
    return source.select("id", dates.is_period(text.norm_label("label", plus=False)).alias("periodic"))


@query("period_label", """
    SELECT o_orderkey AS id, ['Jan','Fev','Mar','Abr','Mai','Jun','Jul','Ago','Set','Out','Nov','Dez'][month(o_orderdate)] || '/' ||
        lpad(CAST(CASE WHEN day(o_orderdate) >= 13 THEN day(o_orderdate) ELSE year(o_orderdate) % 100 END AS VARCHAR), 2, '0') AS label FROM orders""")
def period_label(r):
    return r.table("orders").select(F.col("o_orderkey").alias("id"), dates.period_label("o_orderdate").alias("label"))


@query("expand_ranges", """
    SELECT id, CASE WHEN id % 10 = 0 OR id % 9 = 4 THEN NULL ELSE array_to_string(list_sort(list_distinct(list_concat(
        [a, b], range(least(b, c), greatest(b, c) + 1)))), ',') END AS blocks
    FROM (SELECT o_orderkey AS id, o_orderkey % 10 AS a, o_orderkey % 7 + 1 AS b, o_orderkey % 5 + 3 AS c FROM orders) t""")
def expand_ranges(r):
    source = r.sql("SELECT o_orderkey AS id, (o_orderkey % 10) || ', ' || (o_orderkey % 7 + 1) || ';' || (o_orderkey % 7 + 1) || CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE ':' END || "
                   "(o_orderkey % 5 + 3) || CASE WHEN o_orderkey % 9 = 4 THEN ' x' ELSE '' END AS t FROM {orders}")
    return source.select("id", F.array_join(choices.expand_ranges("t"), ",").alias("blocks"))


@query("a1_ref", """
    SELECT k, CASE WHEN n <= 26 THEN chr(CAST(64 + n AS INT)) WHEN n <= 702 THEN chr(CAST(65 + (n - 27) // 26 AS INT)) || chr(CAST(65 + (n - 27) % 26 AS INT))
        ELSE chr(CAST(65 + (n - 703) // 676 AS INT)) || chr(CAST(65 + ((n - 703) // 26) % 26 AS INT)) || chr(CAST(65 + (n - 703) % 26 AS INT)) END AS letters, k AS row_no, n AS col_no
    FROM (SELECT o_orderkey AS k, o_orderkey % 16000 + 1 AS n FROM orders) t""")
def a1_ref(r):
    source = r.table("orders").select(F.col("o_orderkey").alias("k"), text.column_letters(F.col("o_orderkey") % 16000 + 1).alias("letters"))
    ref = F.concat("letters", F.col("k").cast("string"))
    return source.select("k", "letters", text.a1_row(ref).alias("row_no"), text.a1_col(ref).alias("col_no"))


@query("truncate", """
    SELECT doc_id, CASE WHEN len(text) <= 300 THEN text ELSE text[:300] || '...' END AS short, array_to_string(string_split(text, ' ')[:16], '|') AS first_words FROM documents""")
def truncate(r):
    return r.table("documents").select("doc_id", text.short_text("text", 300).alias("short"), F.array_join(F.slice(F.split("text", " "), 1, 16), "|").alias("first_words"))


@query("slugify", """
    SELECT page_id, coalesce(nullif(trim(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'projeto') AS slug,
           coalesce(nullif(trim(regexp_replace(regexp_extract(url, '[^/]*$'), '[^A-Za-z0-9._ -]+', '_', 'g'), '. '), ''), 'arquivo') AS safe_name FROM pages""")
def slugify(r):
    return r.table("pages").select("page_id", text.slugify("url").alias("slug"), text.safe_file_name("url").alias("safe_name"))


def set_key_sql(col):
    n = norm_sql("v", plus=False)
    return f"array_to_string(list_sort(list_filter(list_transform({col}, lambda v: {n}), lambda v: v <> '')), '|')"


@query("fingerprint", f"""
    SELECT t.target_id, substr(sha1(concat_ws('||', object_type, {set_key_sql('t.categories')}, {set_key_sql('t.series')})), 1, 16) AS fingerprint,
           coalesce(substr(sha1({set_key_sql('s.categories')} || '||' || {set_key_sql('s.series')}), 1, 16), '') AS signature
    FROM target t JOIN source_table s ON t.k = s.k""")
def fingerprint(r):
    t = r.targets().select("k", "target_id", hashing.target_fingerprint("object_type", "categories", "series").alias("fingerprint"))
    s = r.source_tables().select("k", hashing.source_signature("categories", "series").alias("signature"))
    return t.join(s, "k").drop("k")


@query("structure_profile", """
    SELECT table_id, 'contextual_series_rows_categories_columns' AS structure, CAST(len(categories) AS INT) AS category_count, CAST(len(series) AS INT) AS series_count,
        substr(sha1('{"name":"contextual_series_rows_categories_columns","orientation":"series_rows_categories_columns","category_count":' || len(categories)
        || ',"series_count":' || len(series) || '}'), 1, 12) AS signature FROM source_table""")
def structure_profile(r):
    s = r.source_tables().select(
        "table_id", hashing.structure_name("orientation", F.col("title") != "").alias("structure"), "orientation",
        F.size("categories").alias("category_count"), F.size("series").alias("series_count"))
    return s.withColumn("signature", hashing.structure_signature(
        F.col("structure").alias("name"), F.col("orientation"), F.col("category_count"), F.col("series_count"))).drop("orientation")


@query("payload_bytes", """
    SELECT doc_id, CAST(strlen(CAST(to_json({'lang': lang, 'source': source, 'text': text}) AS VARCHAR)) AS INT) AS bytes FROM documents""")
def payload_bytes(r):
    return r.table("documents").select("doc_id", hashing.payload_bytes("lang", "source", "text").alias("bytes"))


@query("value_text", """
    SELECT id, CASE WHEN num IS NULL THEN '0' ELSE regexp_replace(printf('%.12g', num), '^-0$', '0') END AS text FROM (
        SELECT l_orderkey * 1000 + l_partkey AS id, CASE l_linenumber % 4 WHEN 0 THEN l_extendedprice WHEN 1 THEN l_extendedprice / 7 WHEN 2 THEN l_tax / 1000000 END AS num FROM lineitem) t""")
def value_text(r):
    source = r.sql("SELECT l_orderkey * 1000 + l_partkey AS id, CASE l_linenumber % 4 WHEN 0 THEN l_extendedprice WHEN 1 THEN l_extendedprice / 7 WHEN 2 THEN l_tax / 1000000 END AS num FROM {lineitem}")
    return source.select("id", numbers.value_text("num").alias("text"))


@query("detect_title", """
    WITH seg AS (SELECT k, i, trim(regexp_replace(s[i], '\\s+', ' ', 'g'), ' .:-') AS t FROM (
            SELECT k, string_split_regex(near, '\\s+\\|\\s+') AS s, unnest(range(1, len(string_split_regex(near, '\\s+\\|\\s+')) + 1)) AS i
            FROM (SELECT k, nearby_text || ' | RELATÓRIO ' || upper(nearby_text) || ' | <b>' AS near FROM tgt_head) a) b),
    ok AS (SELECT k, i, t, CASE WHEN len(regexp_replace(t, '[^\\p{L}]', '', 'g')) > 0 AND len(regexp_replace(t, '[^\\p{Lu}]', '', 'g')) >= 0.85 * len(regexp_replace(t, '[^\\p{L}]', '', 'g')) THEN 4 ELSE 0 END AS u,
            CASE WHEN len(string_split(t, ' ')) BETWEEN 2 AND 12 THEN 2 ELSE 0 END AS w FROM seg WHERE len(t) BETWEEN 4 AND 100 AND NOT contains(t, '<') AND NOT contains(t, '>')),
    best AS (SELECT k, t FROM ok QUALIFY row_number() OVER (PARTITION BY k ORDER BY u DESC, w DESC, abs(len(t) - 32), i) = 1)
    SELECT h.k, coalesce(nullif(h.title, ''), b.t, '') AS detected, CASE WHEN h.title <> '' AND contains(h.nearby_text, h.title) THEN 'alta' WHEN h.title <> '' THEN 'media'
        WHEN b.t IS NOT NULL THEN 'baixa' ELSE 'ausente' END AS confidence FROM tgt_head h LEFT JOIN best b ON h.k = b.k""")
def detect_title(r):
    near = F.concat("nearby_text", F.lit(" | RELATÓRIO "), F.upper("nearby_text"), F.lit(" | <b>"))
    heads = r.role("tgt_head").select("k", "title", "nearby_text", text.detect_title("title", near).alias("detected"))
    return heads.select("k", "detected", text.title_confidence("title", "nearby_text", "detected").alias("confidence"))


@query("search_text", """
    SELECT target_id, lower(concat_ws(' ', block_id, target_id, shape_name, object_type, nearby_text)) AS search_text FROM tgt_head""")
def search_text(r):
    return r.role("tgt_head").select("target_id", text.search_text("block_id", "target_id", "shape_name", "object_type", "nearby_text").alias("search_text"))


# --- filters ---------------------------------------------------------------------


@query("scope_blocks", "SELECT target_id, block_id FROM tgt_head WHERE block_id IN (3, 5, 8, 9, 10) OR block_id BETWEEN 20 AND 60")
def scope_blocks(r):
    return filters.select_blocks(r.role("tgt_head").select("target_id", "block_id"), "3, 5, 10-8; 20-60")


@query("allowed_targets", "SELECT target_id, score FROM job WHERE target_id IN (SELECT target_id FROM mapping)")
def allowed_targets(r):
    return filters.keep_allowed(r.role("job").select("target_id", "score"), r.role("mapping"))


@query("criteria_filter", """
    SELECT id, lenient >= 10 AS at_least_ten, lenient <> 0 AS not_zero, lenient = 0 AS equals_text, upper(trim(raw)) = '5-LOW' AS is_low FROM (
        SELECT id, raw, CASE WHEN regexp_full_match(replace(trim(raw), ',', '.'), '[+-]?(\\d+\\.?\\d*|\\.\\d+)') THEN CAST(replace(trim(raw), ',', '.') AS DOUBLE) ELSE 0.0 END AS lenient FROM number_text) t""")
def criteria_filter(r):
    return r.role("number_text").select(
        "id", choices.criteria("raw", ">=10").alias("at_least_ten"), choices.criteria("raw", "<>0").alias("not_zero"),
        choices.criteria("raw", "=abc").alias("equals_text"), choices.criteria("raw", "5 low").alias("is_low"))


@query("readable_tables", "SELECT table_id, block_id FROM src_head WHERE table_id IN (SELECT table_id FROM src_value WHERE num IS NOT NULL)")
def readable_tables(r):
    values = r.role("src_value").withColumn("raw", F.lit(None).cast("string"))
    return filters.readable_tables(r.role("src_head").select("table_id", "block_id"), values)


@query("valid_suggestions", """
    SELECT target_id, table_id, confidence FROM suggestion WHERE confidence >= 0.55 AND target_id IN (SELECT target_id FROM tgt_head) AND table_id IN (SELECT table_id FROM src_head)""")
def valid_suggestions(r):
    return filters.valid_suggestions(r.role("suggestion"), r.role("tgt_head"), r.role("src_head")).select("target_id", "table_id", "confidence")


@query("tenant_scope", """
    SELECT event_id, tenant, actor, action, 'member' AS seen_by FROM audit WHERE tenant = (SELECT tenant FROM users WHERE email = 'user2@example.com' AND active)
    UNION ALL SELECT event_id, tenant, actor, action, 'admin' FROM audit WHERE EXISTS (SELECT 1 FROM users WHERE email = 'user1@example.com' AND active AND role = 'admin')
    UNION ALL SELECT event_id, tenant, actor, action, 'inactive' FROM audit WHERE tenant = (SELECT tenant FROM users WHERE email = 'user9@example.com' AND active)""")
def tenant_scope(r):
    log, users = r.role("audit").select("event_id", "tenant", "actor", "action"), r.role("users")
    seen = [filters.scope_to_tenant(log, users, mail).withColumn("seen_by", F.lit(who))
            for mail, who in (("User2@example.com", "member"), ("user1@example.com", "admin"), ("user9@example.com", "inactive"))]
    return seen[0].unionByName(seen[1]).unionByName(seen[2])


@query("scope_bounds", "SELECT DISTINCT c_custkey AS block_id FROM customer WHERE c_custkey > (SELECT max(block_id) FROM tgt_head)")
def scope_bounds(r):
    return filters.out_of_scope(r.table("customer").select(F.col("c_custkey").alias("block_id")).distinct(), r.role("tgt_head").select("block_id"))


@query("retention", "SELECT event_id, kind FROM (SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 'template' ELSE 'run' END AS kind FROM events) e WHERE kind = 'run' AND ts < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 14 DAY")
def retention(r):
    artifacts = r.sql("SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 'template' ELSE 'run' END AS kind FROM {events}")
    return filters.expired(artifacts, "2024-01-31 00:00:00", 14).select("event_id", "kind")
