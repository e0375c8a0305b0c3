"""Review decisions, range functions and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import aggregates, candidates, contracts, joins, review
from .matching import EDGES_SQL, edges_of
from .registry import query
from .roles import norm_sql, overlap_sql

def _legacy_sql(a: str, b: str) -> str:
    """SQL text of the legacy comparison of two normalized texts."""
    x, y = f"replace({a}, ' ', '')", f"replace({b}, ' ', '')"
    return f"""(CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {x} = {y} THEN 1.0 WHEN len({x}) > 2 AND len({y}) > 2 AND (contains({x}, {y}) OR contains({y}, {x})) THEN 0.92
        ELSE greatest({overlap_sql(a, b)}, 0.75 * (1 - CAST(levenshtein({x}, {y}) AS DOUBLE) / greatest(len({x}), len({y}), 1))) END)"""


_P = lambda x: norm_sql(x, plus=False)
# every second contract beside the sheet of its neighbour
PARTS_SQL = f"""
    pa AS MATERIALIZED (SELECT t.k, t.categories AS h, t.series AS w, s.categories AS sh, s.series AS sw, {_P('t.title')} AS va, {_P('s.title')} AS qu, {_P("t.title || ' ' || t.nearby_text")} AS hi,
            {_P("s.file_name || ' ' || s.title || ' ' || array_to_string(s.categories, ' ') || ' ' || array_to_string(s.series, ' ')")} AS st,
            {_P("t.target_id || ' ' || t.nearby_text || ' ' || array_to_string(t.categories, ' ') || ' ' || array_to_string(t.series, ' ')")} AS tt,
            {_P('t.nearby_text')} AS op, {_P("t.nearby_text || ' ' || t.title")} AS oh, {_P("array_to_string(s.categories, ' ')")} AS hd, s.graph_id AS sg, t.target_id AS tg, 'G' || t.k AS mg
          FROM target t JOIN source_table s ON s.k = CASE WHEN t.k % 2 = 0 THEN t.k + 1 ELSE t.k END WHERE t.object_type = 'chart'),
    ax AS (SELECT k, 'h' AS axis, {_P('unnest(h)')} AS l FROM pa UNION ALL SELECT k, 'w', {_P('unnest(w)')} FROM pa),
    sx AS (SELECT DISTINCT k, axis, r FROM (SELECT k, 'h' AS axis, {_P('unnest(sh)')} AS r FROM pa UNION ALL SELECT k, 'w', {_P('unnest(sw)')} FROM pa) z),
    co AS (SELECT k, axis, sum(b * n) / sum(n) AS c FROM (SELECT ax.k, ax.axis, ax.l, n, max({_legacy_sql('ax.l', 'sx.r')}) AS b FROM (SELECT k, axis, l, count(*) AS n FROM ax WHERE l <> '' GROUP BY ALL) ax
            JOIN sx ON sx.k = ax.k AND sx.axis = ax.axis GROUP BY ALL) z GROUP BY ALL),
    parts AS MATERIALIZED (SELECT k, coalesce((SELECT c FROM co WHERE co.k = pa.k AND axis = 'h'), 0) AS header, coalesce((SELECT c FROM co WHERE co.k = pa.k AND axis = 'w'), 0) AS row_part,
            greatest({_legacy_sql('va', 'qu')}, {_legacy_sql('hi', 'st')}, 0.7 * {_legacy_sql('tt', 'st')}) AS variable, greatest({_legacy_sql('op', 'hd')}, {_legacy_sql('oh', 'hd')}) AS opening,
            CASE WHEN sg <> '' AND sg IN (mg, tg) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS metadata, sg <> '' AND sg = mg AS same_id FROM pa)"""


def _parts(r):
    t = r.targets().where("object_type = 'chart'").select(
        "k", F.when(F.col("k") % 2 == 0, F.col("k") + 1).otherwise(F.col("k")).alias("sk"), F.col("categories").alias("headers"), F.col("series").alias("rows"), F.col("title").alias("variable"),
        F.concat_ws(" ", "title", "nearby_text").alias("hints"), F.col("nearby_text").alias("opening"), F.concat_ws(" ", "nearby_text", "title").alias("opening_hints"),
        F.concat_ws(" ", "target_id", "nearby_text", F.array_join("categories", " "), F.array_join("series", " ")).alias("target_text"),
        F.concat(F.lit("G"), F.col("k").cast("string")).alias("graph_id"), F.col("target_id").alias("target_graph_id"))
    s = r.source_tables().select(
        F.col("k").alias("sk"), F.col("categories").alias("source_headers"), F.col("series").alias("source_rows"), F.col("title").alias("question"),
        F.concat_ws(" ", "file_name", "title", F.array_join("categories", " "), F.array_join("series", " ")).alias("source_text"), F.col("graph_id").alias("source_graph_id"))
    return review.legacy_parts(t.join(s, "sk"))


@query("legacy_parts", f"WITH {PARTS_SQL} SELECT k, round(header, 6) AS header, round(row_part, 6) AS row_part, round(variable, 6) AS variable, round(opening, 6) AS opening, metadata, same_id FROM parts")
def legacy_parts(r):
    six = lambda c, name: F.round(c, 6).alias(name)
    return _parts(r).select("k", six("header", "header"), six("row", "row_part"), six("variable_part", "variable"), six("opening_part", "opening"), "metadata", "same_id")


@query("legacy_score", f"""
    WITH {PARTS_SQL} SELECT k, round(CASE WHEN same_id THEN 1 ELSE least(1, 0.44 * header + 0.34 * row_part + 0.14 * variable + 0.05 * opening + 0.03 * metadata) END, 6) AS score FROM parts""")
def legacy_score(r):
    return _parts(r).select("k", F.round(review.legacy_score("header", "row", "variable_part", "opening_part", "metadata", "same_id"), 6).alias("score"))


@query("ambiguity", f"""
    WITH {EDGES_SQL}, r AS (SELECT target_id, table_id, round(score, 9) AS score, row_number() OVER (PARTITION BY target_id ORDER BY round(score, 9) DESC, table_ix) AS n FROM edge),
    b AS (SELECT a.target_id, a.table_id, a.score, coalesce(s.score, 0) AS second FROM r a LEFT JOIN r s ON s.target_id = a.target_id AND s.n = 2 WHERE a.n = 1)
    SELECT target_id, table_id, CASE WHEN score < 0.68 THEN 'missing_source' WHEN score - second >= 0.08 THEN 'matched' ELSE 'ambiguous_source' END AS status FROM b""")
def ambiguity(r):
    return review.ambiguity(edges_of(r).withColumn("score", F.round("score", 9)))


@query("review_route", f"""
    WITH {EDGES_SQL}, best AS (SELECT target_id, max(round(score, 9)) AS s FROM edge GROUP BY target_id), pl AS (SELECT target_id, score AS confidence FROM job WHERE table_id IS NOT NULL)
    SELECT t.target_id, CASE WHEN p.confidence IS NULL AND coalesce(b.s, 0) < 0.3 THEN 'no_source' WHEN p.confidence IS NULL THEN 'unmatched' WHEN p.confidence < 0.8 THEN 'low_confidence' ELSE 'ok' END AS route
    FROM tgt_head t LEFT JOIN pl p USING (target_id) LEFT JOIN best b USING (target_id)""")
def review_route(r):
    best = edges_of(r).groupBy("target_id").agg(F.max(F.round("score", 9)).alias("best_score"))
    plans = r.role("job").where("table_id is not null").select("target_id", F.col("score").alias("confidence"))
    return review.review_route(r.role("tgt_head").select("target_id"), plans, best)


@query("block_review", """
    SELECT block_id, m + l + w > 0 AS needs_review, CASE WHEN m > 0 THEN m || ' without source' WHEN l > 0 THEN l || ' below confidence' WHEN w > 0 THEN w || ' with warnings' ELSE 'all matched' END AS reason
    FROM (SELECT block_id, count(*) FILTER (score IS NULL) AS m, count(*) FILTER (score < 0.82) AS l, count(*) FILTER (warned = 1) AS w FROM job GROUP BY block_id) t""")
def block_review(r):
    return review.block_review(r.role("job"))


@query("work_batches", """
    SELECT target_id, CAST(floor((n - 1) / 10) AS INT) AS batch FROM (SELECT target_id, row_number() OVER (ORDER BY CASE WHEN score >= 0.25 THEN 1 ELSE 0 END DESC, score DESC, k) AS n FROM job WHERE score < 0.8) t WHERE n <= 120""")
def work_batches(r):
    return review.work_batches(r.role("job").where("score < 0.8"), order="k").select("target_id", "batch")


@query("duplicate_contracts", f"""
    SELECT block_id, object_type, orientation, cats, sers, n FROM (SELECT block_id, object_type, orientation, array_to_string(list_transform(categories, lambda v: {norm_sql('v')}), '|') AS cats,
        array_to_string(list_transform(series, lambda v: {norm_sql('v')}), '|') AS sers, count(*) AS n FROM (SELECT * FROM target UNION ALL SELECT * FROM target WHERE target_ix % 5 = 0) u WHERE object_type IN ('chart', 'table') GROUP BY ALL) t WHERE n > 1""")
def duplicate_contracts(r):
    from ..functions.text import norm_label

    t = r.targets().where("object_type in ('chart', 'table')")
    t = t.unionByName(t.where("target_ix % 5 = 0"))  # these ask twice
    axes = {"cats": "categories", "sers": "series"}
    t = t.withColumns({k: F.array_join(F.transform(c, lambda v: norm_label(v)), "|") for k, c in axes.items()})
    return review.duplicate_contracts(t, ["object_type", "orientation", *axes])


CHOICES = """SELECT j.target_id, CASE WHEN j.manual THEN 'manual.xlsx' ELSE '' END AS manual, coalesce(s.table_id, '') AS suggested, coalesce(j.table_id, '') AS found, 'first-' || j.k AS first,
    s.confidence, j.table_id IS NOT NULL AND j.warned = 0 AS ok FROM job j LEFT JOIN suggestion s ON s.target_id = j.target_id"""


@query("choice_precedence", f"""
    WITH c AS ({CHOICES}), f AS (SELECT *, suggested <> '' AND found <> '' AND suggested <> found AS differs, suggested <> '' AND confidence < 0.72 AS low FROM c)
    SELECT target_id, coalesce(nullif(manual, ''), nullif(suggested, ''), nullif(found, ''), first) AS choice,
        CASE WHEN differs AND low THEN 'suggestion differs; low confidence' WHEN differs THEN 'suggestion differs' WHEN low THEN 'low confidence' ELSE '' END AS alert,
        manual <> '' OR (coalesce(ok, false) AND NOT low AND NOT (differs AND confidence < 0.85)) AS use FROM f""")
def choice_precedence(r):
    return review.choice_precedence(r.sql(CHOICES)).select("target_id", "choice", "alert", "use")


REVIEWED = "SELECT target_id, table_id, k % 4 <> 1 AS use FROM suggestion"


@query("reviewed_selection", f"""
    SELECT target_id, table_id, target_id IN (SELECT target_id FROM tgt_head) AND table_id IN (SELECT table_id FROM src_head) AS valid FROM ({REVIEWED}) v WHERE use""")
def reviewed_selection(r):
    good, bad = review.reviewed_selection(r.sql(REVIEWED), r.role("tgt_head"), r.role("src_head"))
    return good.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False))).drop("use")


@query("match_records", f"""
    WITH {EDGES_SQL}, c AS (SELECT target_id, count(*) AS n FROM edge GROUP BY target_id)
    SELECT t.block_id, count(*) AS n_targets, CAST(sum(least(coalesce(c.n, 0), 4)) AS BIGINT) AS n_candidates FROM tgt_head t LEFT JOIN c USING (target_id) GROUP BY t.block_id""")
def match_records(r):
    ranked = candidates.top_candidates(edges_of(r), 4)
    records = review.match_records(r.role("tgt_head"), ranked)
    parsed = F.from_json("record", "objects array<struct<candidates: array<struct<rank int>>>>")
    return records.select("block_id", "n_targets", F.aggregate(
        parsed["objects"], F.lit(0).cast("bigint"), lambda n, o: n + F.coalesce(F.size(o["candidates"]), F.lit(0))).alias("n_candidates"))


# each plan beside its own sheet or its neighbour's, which lacks some of the labels
JUDGED = """SELECT j.target_id, j.k, s.table_id, s.series AS source_rows, s.categories AS source_headers, j.score * 100 AS confidence
    FROM job j JOIN source_table s ON s.k = CASE WHEN j.k % 3 = 0 THEN j.k + 1 ELSE j.k END"""


def _judged_sql(own: str, other: str) -> str:
    """SQL text of the labels of ``own`` that no label of ``other`` is like."""
    n = lambda x: norm_sql(x, plus=False)
    words = lambda x: f"list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> ''))"
    share = f"len(list_intersect({words('v.y')}, {words('c')})) >= 0.68 * greatest(len({words('v.y')}), 1)"
    like = f"c <> '' AND (contains(v.y, c) OR contains(c, v.y) OR {share})"
    asked = f"list_filter(list_transform({own}, lambda x: {{'x': x, 'y': {n('x')}}}), lambda v: v.y <> '')"
    return f"list_filter({asked}, lambda v: len(list_filter(list_transform({other}, lambda z: {n('z')}), lambda c: {like})) = 0)"


def _share_sql(own: str, lost: str) -> str:
    asked = f"len(list_filter({own}, lambda x: {norm_sql('x', plus=False)} <> ''))"
    return f"CASE WHEN {asked} > 0 THEN round_even(({asked} - len({lost})) * 100.0 / {asked}, 1) ELSE 0 END"


@query("quality_report", f"""
    WITH f AS (SELECT table_id, count(num) AS n FROM src_value GROUP BY 1),
    j AS (SELECT q.*, CASE WHEN t.orientation LIKE 'series%' THEN t.series ELSE t.categories END AS ro, CASE WHEN t.orientation LIKE 'series%' THEN t.categories ELSE t.series END AS he,
        round_even(coalesce(f.n, 0) * 100.0 / (len(source_rows) * len(source_headers)), 1) AS filled FROM ({JUDGED}) q JOIN target t USING (target_id) LEFT JOIN f USING (table_id)),
    l AS (SELECT *, {_judged_sql('ro', 'source_rows')} AS lr, {_judged_sql('he', 'source_headers')} AS lh FROM j),
    m AS (SELECT *, {_share_sql('ro', 'lr')} AS rows_ok, {_share_sql('he', 'lh')} AS cols_ok FROM l)
    SELECT target_id, CAST(rows_ok AS DOUBLE) AS rows_ok, CAST(cols_ok AS DOUBLE) AS cols_ok, CAST(filled AS DOUBLE) AS filled,
        array_to_string(list_transform(lr[:6], lambda v: v.x), ', ') AS rows_missing, array_to_string(list_transform(lh[:6], lambda v: v.x), ', ') AS cols_missing,
        concat_ws('; ', CASE WHEN rows_ok < 70 THEN 'rows' END, CASE WHEN cols_ok < 80 THEN 'columns' END, CASE WHEN filled < 70 THEN 'empty values' END, CASE WHEN confidence < 72 THEN 'confidence' END) AS alerts,
        CASE WHEN rows_ok < 70 OR cols_ok < 80 OR filled < 70 OR coalesce(confidence < 72, false) THEN 'Review' ELSE 'OK' END AS verdict FROM m""")
def quality_report(r):
    asked = contracts.contract_manifest(r.targets()).select("target_id", F.col("row_labels").alias("rows"), F.col("col_labels").alias("headers"))
    beside = r.role("job").select("target_id", "k", (F.col("score") * 100).alias("confidence"), F.when(F.col("k") % 3 == 0, F.col("k") + 1).otherwise(F.col("k")).alias("sk"))
    judged = beside.join(r.source_tables().select(F.col("k").alias("sk"), "table_id", F.col("series").alias("source_rows"), F.col("categories").alias("source_headers")), "sk").drop("sk")
    fill = judged.select("target_id", "table_id", (F.size("source_rows") * F.size("source_headers")).alias("n_values")).join(
        r.role("src_value").groupBy("table_id").agg(F.count("num").alias("n_filled")), "table_id", "left").fillna(0, ["n_filled"]).drop("table_id")
    measured = review.quality_measures(judged.drop("table_id", "k").join(asked, "target_id"), fill)
    return review.quality_report(measured).select("target_id", "rows_ok", "cols_ok", "filled", "rows_missing", "cols_missing", "alerts", "verdict")


@query("reading_order", "SELECT target_id, block_id, top_in, left_in FROM tgt_head ORDER BY block_id, top_in, left_in, target_id")
def reading_order(r):
    return review.reading_order(r.role("tgt_head").select("target_id", "block_id", "top_in", "left_in"))


@query("recent_first", "SELECT email, active, name FROM users ORDER BY active DESC, email")
def recent_first(r):
    return r.role("users").select("email", "active", "name").orderBy(F.desc("active"), "email")


# some names look like ids of the same or the next block
NAMES = """SELECT target_id, block_id, top_in, left_in, shape_id, object_type, CASE WHEN k % 5 = 0 THEN 'S' || lpad(CAST((block_id + CASE WHEN k % 15 = 0 THEN 1 ELSE 0 END) % 1000 AS {S}), 3, '0')
    || '_T00' || (2 + k % 4) || CASE WHEN k % 2 = 0 THEN '_CHART' ELSE '_TABLE' END ELSE shape_name END AS shape_name FROM tgt_head"""


@query("stable_ids", f"""
    WITH RECURSIVE n AS ({NAMES.format(S='VARCHAR')}), u AS (SELECT shape_name FROM n WHERE regexp_full_match(shape_name, 'S\\d{{3}}_T\\d{{3}}_[A-Z0-9_]+') GROUP BY shape_name HAVING count(*) = 1),
    q AS (SELECT *, shape_name IN (SELECT shape_name FROM u) AS kept, row_number() OVER (PARTITION BY block_id ORDER BY top_in, left_in, shape_id, object_type, shape_name) AS p FROM n),
    t AS (SELECT shape_name, CAST(substr(shape_name, 2, 3) AS INT) AS b, block_id AS ob, p AS op FROM q WHERE kept),
    w AS (SELECT q.target_id, q.block_id, q.p, q.kept, q.shape_name, upper(q.object_type) AS kind, coalesce(list(t.shape_name) FILTER (t.shape_name IS NOT NULL), []) AS taken
        FROM q LEFT JOIN t ON t.b = q.block_id AND (t.ob < q.block_id OR (t.ob = q.block_id AND t.op < q.p)) GROUP BY ALL),
    o AS (SELECT block_id, CAST(0 AS BIGINT) AS p, CAST(0 AS BIGINT) AS ordinal, CAST('' AS VARCHAR) AS target_id, CAST('' AS VARCHAR) AS stable_id FROM (SELECT DISTINCT block_id FROM w) b
        UNION ALL SELECT block_id, p, CAST(nx AS BIGINT), target_id, CASE WHEN kept THEN shape_name ELSE printf('S%03d_T%03d_', block_id, nx) || kind END FROM (
            SELECT w.*, CASE WHEN kept THEN ordinal + 1 ELSE list_filter(range(ordinal + 1, ordinal + 2 + len(taken)), lambda c: NOT list_contains(taken, printf('S%03d_T%03d_', w.block_id, c) || kind))[1] END AS nx
            FROM o JOIN w ON w.block_id = o.block_id AND w.p = o.p + 1) s)
    SELECT target_id, stable_id FROM o WHERE p > 0""")
def stable_ids(r):
    return review.stable_ids(r.sql(NAMES.format(S="STRING"))).select("target_id", "stable_id")


# --- range functions --------------------------------------------------------------------


@query("range_aggregates", """
    WITH v AS (SELECT l_partkey AS k, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(round(l_quantity) AS BIGINT) END AS q FROM lineitem)
    SELECT k, CAST(coalesce(sum(q), 0) AS DOUBLE) AS total, round(CAST(coalesce(sum(q), 0) AS DOUBLE) / count(*), 9) AS average, CAST(min(coalesce(q, 0)) AS DOUBLE) AS lowest, CAST(max(coalesce(q, 0)) AS DOUBLE) AS highest, count(*) AS n,
        coalesce(CAST(min(q) AS DOUBLE), 0) AS lowest_filled, count(q) AS n_filled FROM v GROUP BY k""")
def range_aggregates(r):
    v = r.sql("SELECT l_partkey AS k, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(round(l_quantity) AS BIGINT) END AS q FROM {lineitem}")
    total, average, lowest, highest, n, _ = aggregates.range_aggregates("q")
    strict = aggregates.range_aggregates("q", blank_as_zero=False)
    return v.groupBy("k").agg(total, average, lowest, highest, n, strict[2].alias("lowest_filled"), strict[5]).withColumn("average", F.round("average", 9))


@query("sumif_countif", """
    SELECT l_suppkey AS k, CAST(coalesce(sum(CASE WHEN l_quantity >= 25 THEN CAST(round(l_extendedprice * 100) AS BIGINT) END), 0) AS DOUBLE) AS big_cents, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_quantity <> 10) AS not_ten
    FROM lineitem GROUP BY l_suppkey""")
def sumif_countif(r):
    v = r.table("lineitem").withColumn("cents", F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    return v.groupBy(F.col("l_suppkey").alias("k")).agg(
        aggregates.sumif("l_quantity", ">=25", "cents").alias("big_cents"), aggregates.countif("l_returnflag", "r").alias("returned"), aggregates.countif("l_quantity", "<>10").alias("not_ten"))


@query("sumproduct", """
    WITH a AS (SELECT k, ix, nk AS x FROM src_row), b AS (SELECT k, ix, yr AS y FROM src_col) SELECT k, CAST(sum(x * y) AS DOUBLE) AS product FROM a JOIN b USING (k, ix) GROUP BY k""")
def sumproduct(r):
    a = r.role("src_row").select("k", "ix", F.col("nk").alias("x"))
    b = r.role("src_col").select("k", "ix", F.col("yr").alias("y"))
    return aggregates.sumproduct(a, b, ["k"], "ix", "x", "y")


@query("margin_of_error", "SELECT l_suppkey AS k, count(*) AS n, round(1.96 * sqrt(0.25 / count(*)) * 100, 6) AS margin FROM lineitem GROUP BY l_suppkey")
def margin_of_error(r):
    return r.table("lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("n")).withColumn("margin", F.round(aggregates.margin_of_error("n"), 6))


@query("nps", """
    SELECT k, round((p - d) * 100, 6) AS score FROM (SELECT l_partkey AS k, CAST(count(*) FILTER (l_quantity >= 45) AS DOUBLE) / count(*) AS p, CAST(count(*) FILTER (l_quantity <= 30) AS DOUBLE) / count(*) AS d FROM lineitem GROUP BY l_partkey) t""")
def nps(r):
    shares = r.table("lineitem").groupBy(F.col("l_partkey").alias("k")).agg(
        (F.count_if(F.col("l_quantity") >= 45) / F.count("*")).alias("p"), (F.count_if(F.col("l_quantity") <= 30) / F.count("*")).alias("d"))
    return shares.select("k", F.round(aggregates.nps("p", "d"), 6).alias("score"))


# --- reports ------------------------------------------------------------------------------


@query("duplicate_keys", "SELECT target_id, count(*) AS n FROM mapping GROUP BY target_id HAVING count(*) > 1")
def duplicate_keys(r):
    return aggregates.duplicate_keys(r.role("mapping"), "target_id")


@query("sheets_per_file", "SELECT source || '.xlsx' AS file_name, count(*) AS n_sheets FROM documents GROUP BY source ORDER BY n_sheets DESC, file_name LIMIT 6")
def sheets_per_file(r):
    return aggregates.sheets_per_file(r.table("documents").select(F.concat("source", F.lit(".xlsx")).alias("file_name")))


@query("analysis_warnings", """
    SELECT 'several blocks in one sheet' AS warning, count(*) AS n FROM src_head WHERE k >= 0 AND k % 9 = 4 UNION ALL SELECT 'contracts without source', count(*) FROM job WHERE table_id IS NULL""")
def analysis_warnings(r):
    tables = r.sql("SELECT table_id, CASE WHEN k >= 0 AND k % 9 = 4 THEN 2 ELSE 1 END AS table_blocks FROM src_head")
    jobs = r.role("job")
    return aggregates.analysis_warnings(tables, jobs.select("target_id"), jobs.where("table_id is not null"))


@query("status_rollup", """
    SELECT block_id, count(*) AS targets, count(table_id) AS mapped, count(*) FILTER (table_id IS NULL) AS unmapped, count(*) FILTER (manual) AS manual, count(*) FILTER (ai) AS ai FROM job GROUP BY ROLLUP (block_id)""")
def status_rollup(r):
    return aggregates.status_rollup(r.role("job"))


@query("object_inventory", "SELECT block_id, count(*) FILTER (object_type = 'chart') AS charts, count(*) FILTER (object_type = 'table') AS tables, count(*) AS objects FROM tgt_head GROUP BY block_id")
def object_inventory(r):
    return aggregates.object_inventory(r.role("tgt_head"))


RATES = [("small", 1.0, 0.1, 6.0), ("large", 2.5, 0.25, 15.0)]
COST_SQL = """CAST(sum(CAST(round((greatest(input_tokens - cached_input_tokens, 0) * i + cached_input_tokens * c + output_tokens * o) / 1000000 * 100000000) AS BIGINT)) AS DOUBLE) / 100000000"""
PRICED_SQL = """SELECT *, CASE WHEN lower(model) LIKE 'small%' THEN 1.0 WHEN lower(model) LIKE 'large%' THEN 2.5 END::DOUBLE AS i, CASE WHEN lower(model) LIKE 'small%' THEN 0.1 WHEN lower(model) LIKE 'large%' THEN 0.25 END::DOUBLE AS c,
    CASE WHEN lower(model) LIKE 'small%' THEN 6.0 WHEN lower(model) LIKE 'large%' THEN 15.0 END::DOUBLE AS o FROM usage"""
USAGE_SQL = f"""count(*) AS calls, count(*) FILTER (status = 'error') AS errors, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(cached_input_tokens) AS BIGINT) AS cached_input_tokens,
    CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(CASE WHEN total_tokens > 0 THEN total_tokens ELSE input_tokens + output_tokens END) AS BIGINT) AS total_tokens, {COST_SQL} AS cost"""


@query("usage_cost", f"SELECT operation, model, {USAGE_SQL} FROM ({PRICED_SQL}) p GROUP BY operation, model")
def usage_cost(r):
    return aggregates.usage_cost(r.role("usage"), RATES, ["operation", "model"])


@query("usage_hourly", f"SELECT date_trunc('hour', returned_at) AS hour, operation, {USAGE_SQL} FROM ({PRICED_SQL}) p GROUP BY 1, operation")
def usage_hourly(r):
    calls = r.role("usage").withColumn("hour", F.date_trunc("hour", "returned_at").cast("timestamp_ntz"))
    return aggregates.usage_cost(calls, RATES, ["hour", "operation"])


@query("payload_summary", "SELECT lang, CAST(sum(strlen(CAST(to_json({'lang': lang, 'text': text}) AS VARCHAR))) AS BIGINT) AS bytes, count(*) AS n FROM documents GROUP BY lang")
def payload_summary(r):
    sized = r.table("documents").select("lang", hashing.payload_bytes("lang", "text").alias("b"))
    return sized.groupBy("lang").agg(F.sum("b").alias("bytes"), F.count("*").alias("n"))


BLOCKS = "SELECT block_id, sum(CASE WHEN ai THEN 1 ELSE 0 END) AS outputs, max(CASE WHEN warned = 1 THEN 1 ELSE 0 END) = 1 AS skipped, sum(CASE WHEN score < 0.1 THEN 1 ELSE 0 END) AS questions, sum(CASE WHEN table_id IS NULL THEN 1 ELSE 0 END) AS unmapped FROM job GROUP BY block_id"


@query("review_progress", f"""
    SELECT count(*) FILTER (outputs > 0) AS with_outputs, count(*) FILTER (skipped) AS skipped, CAST(sum(questions) AS BIGINT) AS questions, CAST(sum(unmapped) AS BIGINT) AS unmapped, CASE WHEN sum(unmapped) > 0 THEN 'warn' ELSE 'done' END AS mapping,
        CASE WHEN count(*) FILTER (outputs > 0) + count(*) FILTER (skipped) > 0 THEN 'done' ELSE 'active' END AS assist, CASE WHEN sum(questions) + sum(unmapped) > 0 THEN 'warn' ELSE 'active' END AS review FROM ({BLOCKS}) b""")
def review_progress(r):
    return aggregates.review_progress(r.sql(BLOCKS))


@query("distinct_first", "SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def distinct_first(r):
    orders = r.table("orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate")
    return joins.first_by(orders, ["o_custkey"], "o_orderdate", "o_orderkey").drop("o_orderdate")


@query("stale_outputs", """
    SELECT o_custkey, count(*) FILTER (o_orderkey % 50 = 0) > 0 AS stale FROM orders GROUP BY o_custkey""")
def stale_outputs(r):
    then = r.table("orders").select("o_custkey", "o_orderkey", "o_totalprice")
    now = then.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 50 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    sign = lambda df: aggregates.input_signature(df, ["o_custkey"], ["o_orderkey", "o_totalprice"])
    return aggregates.stale_outputs(sign(then), sign(now), "o_custkey")


@query("template_summary", """
    SELECT 'matched' AS what, count(*) AS n FROM suggestion WHERE target_id IN (SELECT target_id FROM tgt_head)
    UNION ALL SELECT 'missing_sources', count(*) FROM suggestion WHERE target_id IN (SELECT target_id FROM tgt_head) AND table_id NOT IN (SELECT table_id FROM src_head)
    UNION ALL SELECT 'new_targets', count(*) FROM tgt_head WHERE target_id NOT IN (SELECT target_id FROM suggestion)""")
def template_summary(r):
    return aggregates.template_summary(r.role("suggestion"), r.role("tgt_head"), r.role("src_head"))


@query("headline_counts", """
    SELECT count(*) AS total, count(table_id) AS ready, count(*) FILTER (table_id IS NULL) AS pending, count(DISTINCT CASE WHEN table_id IS NOT NULL THEN block_id END) AS blocks,
        count(*) FILTER (table_id IS NULL OR (score <> 0 AND score < 0.8)) AS to_review FROM job""")
def headline_counts(r):
    return aggregates.headline_counts(r.role("job"))


@query("progress_percent", """
    SELECT job_id, seq, done, CAST(CASE WHEN phase = 'complete' THEN 100 ELSE least(100, round_even(100.0 * done / (total + 1), 0)) END AS INT) AS percent
    FROM (SELECT *, count(*) OVER (PARTITION BY job_id ORDER BY seq) AS done FROM progress) p""")
def progress_percent(r):
    return aggregates.progress_percent(r.role("progress")).select("job_id", "seq", "done", "percent")


@query("job_state", """
    SELECT job_id, seq, phase, completed, total, CAST(CASE WHEN phase = 'complete' THEN 100 ELSE round_even(100.0 * completed / (total + 1), 0) END AS INT) AS percent
    FROM progress QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) = 1""")
def job_state(r):
    return aggregates.latest_state(r.role("progress"))


@query("audit_history", """SELECT DISTINCT event_id, "at", tenant, actor, action, actor <> '' AS identified FROM audit""")
def audit_history(r):
    from ..streaming.logs import audit_rows

    return audit_rows(r.role("audit")).dropDuplicates(["event_id"])
