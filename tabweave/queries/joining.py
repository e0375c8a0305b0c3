"""Joins, diffs and remembered mappings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing
from ..functions.text import norm_label
from ..operators import assignment, diff, joins, learning
from .registry import query
from .roles import norm_sql
from .scalars import HINT_PATH_SQL, set_key_sql

MAPPED = """SELECT k AS row_no, CASE WHEN k % 17 = 5 THEN k + 100000000 ELSE k END AS id, k % 6 <> 2 AS update FROM mapping_once"""


@query("chart_jobs", f"""
    WITH m AS ({MAPPED}), s AS (SELECT k AS id, table_id FROM src_head WHERE k % 13 <> 0), t AS (SELECT k AS id FROM tgt_head WHERE k % 12 <> 7)
    SELECT m.row_no, s.table_id, CASE WHEN NOT m.update THEN 'skipped' WHEN s.id IS NULL THEN 'missing_source' WHEN t.id IS NULL THEN 'missing_target' ELSE 'ok' END AS status
    FROM m LEFT JOIN s USING (id) LEFT JOIN t USING (id)""")
def chart_jobs(r):
    sources = r.sql("SELECT k AS id, table_id FROM src_head WHERE k % 13 <> 0")
    targets = r.sql("SELECT k AS id FROM tgt_head WHERE k % 12 <> 7")
    return joins.chart_jobs(r.sql(MAPPED), targets, sources).select("row_no", "table_id", "status")


ALIASES = """SELECT target_id AS alias, target_id, target_ix FROM tgt_head UNION ALL SELECT shape_name, target_id, target_ix FROM tgt_head
    UNION ALL SELECT shape_id, target_id, target_ix FROM tgt_head"""
RESOLVED_SQL = f"""
    al AS (SELECT alias, target_id FROM ({ALIASES}) a QUALIFY row_number() OVER (PARTITION BY alias ORDER BY target_ix) = 1),
    di AS (SELECT entry_ix, target_id FROM (SELECT entry_ix, 0 AS p, entry_id AS alias FROM learned UNION ALL SELECT entry_ix, 1, alias FROM learned) n JOIN al USING (alias)
           QUALIFY row_number() OVER (PARTITION BY entry_ix ORDER BY p) = 1)"""


def _entries(r):
    return r.role("learned").withColumn("names", F.array("entry_id", "alias"))


@query("alias_join", f"WITH {RESOLVED_SQL} SELECT entry_ix, target_id FROM di")
def alias_join(r):
    return joins.alias_join(_entries(r), r.sql(ALIASES))


PRINT_SQL = f"substr(sha1(concat_ws('||', object_type, {set_key_sql('categories')}, {set_key_sql('series')})), 1, 16)"


@query("unique_join", f"""
    WITH f AS (SELECT k, target_id, {PRINT_SQL} AS fingerprint FROM target), u AS (SELECT fingerprint, min(target_id) AS target_id FROM f GROUP BY fingerprint HAVING count(*) = 1)
    SELECT l.entry_ix, u.target_id FROM learned l JOIN f ON f.k = l.entry_ix JOIN u ON u.fingerprint = f.fingerprint""")
def unique_join(r):
    prints = r.targets().select("k", "target_id", hashing.target_fingerprint("object_type", "categories", "series").alias("fingerprint"))
    entries = r.role("learned").join(prints.select(F.col("k").alias("entry_ix"), "fingerprint"), "entry_ix").select("entry_ix", "fingerprint")
    return joins.unique_join(entries, prints.select("target_id", "fingerprint"), "fingerprint").select("entry_ix", "target_id")


@query("basename_join", """
    WITH f AS (SELECT lower(regexp_extract(split_part(table_id, '#', 1), '[^/]*$')) AS b, table_id, table_ix FROM src_head QUALIFY row_number() OVER (PARTITION BY b ORDER BY table_ix) = 1)
    SELECT m.k, f.table_id FROM mapping m JOIN f ON f.b = lower(regexp_extract(m.file_name, '[^/]*$'))""")
def basename_join(r):
    files = r.role("src_head").select("table_id", "table_ix", F.split_part("table_id", F.lit("#"), F.lit(1)).alias("path"))
    return joins.basename_join(r.role("mapping"), files, "file_name", "path", "table_ix").select("k", "table_id")


# an entry remembers the axes of its own sheet, and some names have changed since
def _blocked_sql(column, block):
    return f"list_transform({column}, lambda v: v || ' B' || {block})"


def _learned_sql(cats, sers, alike, counts=""):
    return f"""
    st AS MATERIALIZED (SELECT k, block, table_id, table_ix, substr(sha1({set_key_sql(cats)} || '||' || {set_key_sql(sers)}), 1, 16) AS signature,
              list_transform({cats}, lambda v: {norm_sql('v', plus=False)}) AS cats, list_transform({sers}, lambda v: {norm_sql('v', plus=False)}) AS sers
           FROM (SELECT *, coalesce(block_id, 0) AS block FROM source_table) s),
    en AS MATERIALIZED (SELECT l.entry_ix, l.basename, {PRINT_SQL.replace('object_type', 't.object_type').replace('categories', 't.categories').replace('series', 't.series')} AS fingerprint,
              s.signature, s.cats, s.sers, s.block FROM learned l JOIN st s ON s.k = l.entry_ix JOIN target t ON t.k = l.entry_ix),
    so AS MATERIALIZED (SELECT k, block, CASE WHEN k % 7 = 3 THEN 'renamed/' || table_id || '2' ELSE table_id END AS table_id, table_ix, signature, cats, sers FROM st),{counts}
    cand AS (SELECT e.entry_ix, s.table_id, s.table_ix, 0 AS step, 1.0 AS score FROM en e JOIN so s ON lower(regexp_extract(s.table_id, '[^/]*$')) = lower(e.basename)
        UNION ALL SELECT e.entry_ix, s.table_id, s.table_ix, 1, 1.0 FROM en e JOIN so s ON s.signature = e.signature
        UNION ALL SELECT entry_ix, table_id, table_ix, 2, score FROM ({alike}) j WHERE score >= 0.6)"""


# each label with its block, and the sources of the block
LEARNED_SQL = _learned_sql(_blocked_sql("s.categories", "s.block"), _blocked_sql("s.series", "s.block"), """SELECT e.entry_ix, s.table_id, s.table_ix,
            (CAST(len(list_intersect(e.cats, s.cats)) AS DOUBLE) / len(list_distinct(list_concat(e.cats, s.cats))) + CAST(len(list_intersect(e.sers, s.sers)) AS DOUBLE) / len(list_distinct(list_concat(e.sers, s.sers)))) / 2 AS score
            FROM en e JOIN so s ON e.block = s.block AND (list_has_any(e.cats, s.cats) OR list_has_any(e.sers, s.sers))""")
# labels as they are, and every source; shared labels are counted in place of comparing the lists of all pairs
EVERY_LEARNED_SQL = _learned_sql("s.categories", "s.series", """SELECT sh.entry_ix, s.table_id, s.table_ix, sum(CAST(c AS DOUBLE) / (x.n + y.n - c)) / 2 AS score
            FROM sh JOIN n x ON x.side = 0 AND x.ix = sh.entry_ix AND x.axis = sh.axis JOIN n y ON y.side = 1 AND y.ix = sh.table_ix AND y.axis = sh.axis JOIN so s ON s.table_ix = sh.table_ix GROUP BY ALL""", """
    w AS MATERIALIZED (SELECT 0 AS side, entry_ix AS ix, axis, unnest(list_distinct(CASE WHEN axis = 0 THEN cats ELSE sers END)) AS v FROM en, range(2) r(axis)
        UNION ALL SELECT 1, table_ix, axis, unnest(list_distinct(CASE WHEN axis = 0 THEN cats ELSE sers END)) FROM so, range(2) r(axis)),
    n AS MATERIALIZED (SELECT side, ix, axis, count(*) AS n FROM w GROUP BY ALL),
    sh AS MATERIALIZED (SELECT e.ix AS entry_ix, s.ix AS table_ix, e.axis, count(*) AS c FROM w e JOIN w s ON e.axis = s.axis AND e.v = s.v WHERE e.side = 0 AND s.side = 1 GROUP BY ALL),""")


def remembered_sources(r, blocked=True):
    """Sources and contracts with what entries remember of them; labels carry their block, or stay as they are and meet all sources."""
    tables = r.source_tables()
    if blocked:
        block = F.coalesce("block_id", F.lit(0)).cast("string")
        for c in ("categories", "series"):
            tables = tables.withColumn(c, F.transform(c, lambda v: F.concat(v, F.lit(" B"), block)))
    n = lambda c, name: F.transform(c, lambda v: norm_label(v, plus=False)).alias(name)
    src = tables.select("k", "table_id", "table_ix", hashing.source_signature("categories", "series").alias("signature"), n("categories", "cats"), n("series", "sers"))
    return src, r.targets().select("k", "target_id", hashing.target_fingerprint("object_type", "categories", "series").alias("fingerprint"))


def with_renamed(src):
    """A seventh of the sources were renamed since."""
    renamed = F.when(F.col("k") % 7 == 3, F.concat(F.lit("renamed/"), "table_id", F.lit("2"))).otherwise(F.col("table_id"))
    return src.withColumn("table_id", renamed)


def _remembered(r, blocked=True):
    src, prints = remembered_sources(r, blocked)
    entries = (
        _entries(r).join(src.select(F.col("k").alias("entry_ix"), "signature", "cats", "sers"), "entry_ix")
        .join(prints.select(F.col("k").alias("entry_ix"), "fingerprint"), "entry_ix")
    )
    return entries, with_renamed(src), prints


@query("cascade_join", f"""
    WITH {EVERY_LEARNED_SQL} SELECT entry_ix, table_id, CAST(step AS INT) AS step FROM cand QUALIFY row_number() OVER (PARTITION BY entry_ix ORDER BY step, round(score, 9) DESC, table_ix) = 1""")
def cascade_join(r):
    """The best source of each entry among all sources."""
    entries, sources, _ = _remembered(r, blocked=False)
    cand = learning.source_candidates(entries, sources, best=True)
    steps = [cand.where(F.col("step") == i).drop("step") for i in range(3)]
    return joins.cascade_join(steps, ["entry_ix"], F.desc("score"), "table_ix").select("entry_ix", "table_id", "step")


# the entries one after the other: each takes its best free candidate, if its contract is still open
ORDERED_SQL = """
    cd AS MATERIALIZED (SELECT entry_ix, target_id, table_id, table_ix, step, score, dense_rank() OVER (ORDER BY entry_ix) AS rn FROM (
        SELECT entry_ix, target_id, table_id, table_ix, step, round(score, 9) AS score FROM {edges} QUALIFY row_number() OVER (PARTITION BY entry_ix, table_id ORDER BY step, round(score, 9) DESC) = 1) z),
    g AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS VARCHAR[]) AS ut, CAST([] AS VARCHAR[]) AS us, CAST(NULL AS BIGINT) AS entry_ix, CAST(NULL AS VARCHAR) AS target_id, CAST(NULL AS VARCHAR) AS table_id, CAST(NULL AS INT) AS step, false AS ok
        UNION ALL
        SELECT rn, CASE WHEN free THEN list_append(ut, target_id) ELSE ut END, CASE WHEN free THEN list_append(us, table_id) ELSE us END, entry_ix, target_id, table_id, step, free
        FROM (SELECT c.rn, g.ut, g.us, c.entry_ix, c.target_id, c.table_id, c.step, NOT list_contains(g.ut, c.target_id) AND NOT list_contains(g.us, c.table_id) AS free,
                row_number() OVER (ORDER BY CASE WHEN list_contains(g.us, c.table_id) THEN 1 ELSE 0 END, c.step, c.score DESC, c.table_ix) AS z
              FROM g JOIN cd c ON c.rn = g.rn + 1) y WHERE z = 1)"""
BY_PRINT_SQL = f"""{RESOLVED_SQL},
    pf AS (SELECT target_id, {PRINT_SQL} AS fingerprint FROM target),
    tg AS MATERIALIZED (SELECT entry_ix, target_id FROM di UNION ALL SELECT en.entry_ix, u.target_id FROM en JOIN (SELECT fingerprint, min(target_id) AS target_id FROM pf GROUP BY fingerprint HAVING count(*) = 1) u USING (fingerprint)
        WHERE en.entry_ix NOT IN (SELECT entry_ix FROM di))"""


@query("resolve_learned", f"""
    WITH RECURSIVE {LEARNED_SQL}, {BY_PRINT_SQL}, {ORDERED_SQL.format(edges='cand JOIN tg USING (entry_ix)')}
    SELECT entry_ix, target_id, table_id, CAST(step AS INT) AS step FROM g WHERE ok""")
def resolve_learned(r):
    entries, sources, prints = _remembered(r)
    out = learning.resolve_learned(entries, r.sql(ALIASES), prints.select("target_id", "fingerprint"), sources)
    return out.select("entry_ix", "target_id", "table_id", "step")


@query("assign_ordered", f"""
    WITH RECURSIVE {LEARNED_SQL}, {ORDERED_SQL.format(edges="(SELECT *, CAST(entry_ix AS VARCHAR) AS target_id FROM cand) cand")}
    SELECT entry_ix, table_id, CAST(step AS INT) AS step FROM g WHERE ok""")
def assign_ordered(r):
    """Sources handed out in the order of the entries, the best step of each first."""
    entries, sources, _ = _remembered(r)
    cand = learning.source_candidates(entries, sources).withColumn("score", F.round("score", 9))
    cand = joins.first_by(cand, ["entry_ix", "table_id"], "step", F.desc("score"))
    return assignment.assign_greedy(cand, ["entry_ix"], ["table_id"], [F.col("entry_ix"), F.col("step"), -F.col("score"), F.col("table_ix")]).select(
        "entry_ix", "table_id", "step")


EXISTING = """SELECT l.entry_ix, CASE WHEN l.entry_ix % 2 = 0 THEN h.target_id ELSE l.entry_id END AS entry_id, l.cell_range, l.range_mode, 'F' || (l.entry_ix % 700) AS fingerprint,
    l.basename AS table_id, CAST(0.5 AS DOUBLE) AS confidence, '2023' AS updated_at FROM learned l JOIN tgt_head h ON h.k = l.entry_ix WHERE l.entry_ix % 3 <> 2"""
RUN = "SELECT target_id, table_id, 'F' || (k % 700) AS fingerprint, score AS confidence FROM job WHERE score >= 0.4"


@query("learn_mappings", f"""
    WITH old AS ({EXISTING}), run AS ({RUN}), fp AS (SELECT fingerprint, cell_range, range_mode FROM old QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY entry_ix) = 1)
    SELECT entry_id, table_id, fingerprint, confidence, cell_range, range_mode, updated_at FROM old WHERE entry_id NOT IN (SELECT target_id FROM run)
    UNION ALL
    SELECT r.target_id, r.table_id, r.fingerprint, round(r.confidence, 4), coalesce(CASE WHEN o.entry_id IS NOT NULL THEN o.cell_range ELSE f.cell_range END, ''),
        coalesce(nullif(CASE WHEN o.entry_id IS NOT NULL THEN o.range_mode ELSE f.range_mode END, ''), 'exact'), '2024'
    FROM run r LEFT JOIN old o ON o.entry_id = r.target_id LEFT JOIN fp f ON f.fingerprint = r.fingerprint""")
def learn_mappings(r):
    return learning.learn_mappings(r.sql(EXISTING), r.sql(RUN), "2024")


@query("rank_templates", f"""
    WITH al AS (SELECT alias, target_id FROM ({ALIASES}) a QUALIFY row_number() OVER (PARTITION BY alias ORDER BY target_ix) = 1),
    n AS (SELECT DISTINCT l.template, coalesce(al.target_id, l.entry_id) AS target_id FROM learned l LEFT JOIN al ON al.alias = l.entry_id),
    h AS (SELECT template, count(*) AS matched FROM n WHERE target_id IN (SELECT target_id FROM tgt_head) GROUP BY template)
    SELECT template, matched, (SELECT count(DISTINCT target_id) FROM tgt_head) - matched AS new_targets, round(CAST(matched AS DOUBLE) / (SELECT count(DISTINCT target_id) FROM tgt_head) * 100, 1) AS score FROM h""")
def rank_templates(r):
    return learning.rank_templates(r.role("learned").select("template", "entry_id"), r.sql(ALIASES), r.role("tgt_head"))


@query("fallback_scope", f"""
    WITH f AS (SELECT path, {HINT_PATH_SQL} AS block_id FROM file), b AS (SELECT DISTINCT CAST(c_nationkey * 2 AS INT) AS block_id FROM customer)
    SELECT block_id, CASE WHEN block_id IN (SELECT block_id FROM f WHERE block_id IS NOT NULL) THEN 'own' WHEN EXISTS (SELECT 1 FROM f WHERE block_id IS NULL) THEN 'general' ELSE 'all' END AS scope, CAST(NULL AS VARCHAR) AS path FROM b
    UNION ALL SELECT block_id, CASE WHEN block_id IS NULL THEN 'general' ELSE 'own' END, path FROM f
    UNION ALL SELECT NULL, 'all', path FROM f WHERE NOT EXISTS (SELECT 1 FROM f WHERE block_id IS NULL)""")
def fallback_scope(r):
    """The scope of each block, and the files of each scope."""
    from ..functions.text import block_hint_path

    files = r.role("file").select("path", block_hint_path("path").alias("block_id"))
    blocks = r.sql("SELECT DISTINCT CAST(c_nationkey * 2 AS INT) AS block_id FROM {customer}")
    scopes = joins.fallback_scope(blocks, files).withColumn("path", F.lit(None).cast("string"))
    return scopes.unionByName(joins.scope_files(files))


# --- boxes ------------------------------------------------------------------------------

NEAR_SQL = """
    p AS (SELECT h.target_id, b.box_ix, b.text, h.left_in, h.top_in, h.width_in, h.height_in, b.left_in AS bl, b.top_in AS bt, b.width_in AS bw, b.height_in AS bh,
             abs(h.left_in + h.width_in / 2 - b.left_in - b.width_in / 2) + abs(h.top_in + h.height_in / 2 - b.top_in - b.height_in / 2) AS raw,
             greatest(0, least(h.left_in + h.width_in, b.left_in + b.width_in) - greatest(h.left_in, b.left_in)) / least(h.width_in, b.width_in) AS ratio
          FROM tgt_head h JOIN text_box b USING (block_id))"""


@query("nearest_text", f"""
    WITH {NEAR_SQL}, d AS (SELECT target_id, box_ix, trim(text) AS text, raw * CASE WHEN ratio >= 0.2 AND bt <= top_in + height_in AND bt + bh <= top_in + height_in + 0.5 THEN 0.45 ELSE 1 END
        * CASE WHEN least(abs(bt + bh - top_in), abs(top_in + height_in - bt)) <= 0.35 THEN 0.7 ELSE 1 END AS d FROM p),
    n AS (SELECT target_id, text, row_number() OVER (PARTITION BY target_id ORDER BY round(d, 9), box_ix) AS n FROM d QUALIFY n <= 8),
    u AS (SELECT target_id, text, n FROM n QUALIFY row_number() OVER (PARTITION BY target_id, {norm_sql('text', plus=False)} ORDER BY n) = 1)
    SELECT target_id, string_agg(text, ' | ' ORDER BY n) AS nearby_text FROM u GROUP BY target_id""")
def nearest_text(r):
    return joins.nearest_text(r.role("tgt_head"), r.role("text_box"))


@query("nearest_title", f"""
    WITH {NEAR_SQL} SELECT target_id, left(trim(split_part(trim(text), ' | ', 1)), 160) AS title FROM p WHERE ratio >= 0.3 AND top_in - (bt + bh) BETWEEN -0.15 AND 2.5
    QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY abs(top_in - (bt + bh)), box_ix) = 1""")
def nearest_title(r):
    return joins.nearest_title(r.role("tgt_head"), r.role("text_box"))


SEEDS = "SELECT k, table_id, CAST(k % 9 AS INT) AS s0, CAST(k % 4 AS INT) AS sc0, CAST(k % 9 + 2 AS INT) AS s1, CAST(k % 4 + 1 AS INT) AS sc1 FROM src_head WHERE k >= 0"


@query("region_overlap", f"""
    SELECT s.k, n.region_name FROM ({SEEDS}) s JOIN named_region n ON n.table_id = s.table_id AND n.r0 <= s.s1 AND s.s0 <= n.r1 AND n.c0 <= s.sc1 AND s.sc0 <= n.c1""")
def region_overlap(r):
    hit = joins.overlap_join(r.sql(SEEDS), r.role("named_region").drop("k"), ["table_id"], ("s0", "s1", "r0", "r1"), ("sc0", "sc1", "c0", "c1"))
    return hit.select("k", "region_name")


@query("merged_lookup", """
    SELECT v.table_id, v.row_ix, v.col_ix, n.region_name FROM src_value v JOIN named_region n ON n.table_id = v.table_id AND v.row_ix BETWEEN n.r0 AND n.r1 AND v.col_ix BETWEEN n.c0 AND n.c1""")
def merged_lookup(r):
    hit = joins.overlap_join(r.role("src_value"), r.role("named_region"), ["table_id"], ("row_ix", "row_ix", "r0", "r1"), ("col_ix", "col_ix", "c0", "c1"))
    return hit.select("table_id", "row_ix", "col_ix", "region_name")


# --- upserts and diffs ----------------------------------------------------------------------


@query("override_upsert", """
    WITH b AS (SELECT target_id, table_id, score FROM job WHERE table_id IS NOT NULL), o AS (SELECT target_id, table_id, confidence AS score, replace_existing FROM suggestion)
    SELECT coalesce(b.target_id, o.target_id) AS target_id, CASE WHEN o.target_id IS NOT NULL AND (b.target_id IS NULL OR o.replace_existing) THEN o.table_id ELSE b.table_id END AS table_id,
        CASE WHEN o.target_id IS NOT NULL AND (b.target_id IS NULL OR o.replace_existing) THEN o.score ELSE b.score END AS score,
        CASE WHEN b.target_id IS NULL THEN 'added' WHEN o.replace_existing THEN 'replaced' ELSE 'kept' END AS origin
    FROM b FULL JOIN o ON b.target_id = o.target_id""")
def override_upsert(r):
    base = r.role("job").where("table_id is not null").select("target_id", "table_id", "score")
    over = r.role("suggestion").select("target_id", "table_id", F.col("confidence").alias("score"), "replace_existing")
    return joins.override_upsert(base, over, "target_id", "replace_existing")


@query("id_reconcile", """
    SELECT DISTINCT target_id, 'unknown' AS issue FROM mapping WHERE target_id NOT IN (SELECT target_id FROM tgt_head)
    UNION ALL SELECT DISTINCT target_id, 'missing' FROM tgt_head WHERE target_id NOT IN (SELECT target_id FROM mapping)""")
def id_reconcile(r):
    return joins.id_reconcile(r.role("tgt_head"), r.role("mapping"), "target_id")


DIFF_SQL = """
    d AS (SELECT coalesce(o.o_orderkey, v.id) AS id, CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN v.id IS NULL THEN 'missing'
        WHEN v.amount IS NOT NULL AND abs(v.amount - o.o_totalprice) <= greatest(1e-9, abs(o.o_totalprice) * 1e-9) AND coalesce(v.note, '') = coalesce(o.o_orderpriority, '') THEN 'unchanged' ELSE 'changed' END AS change
        FROM orders o FULL JOIN delivery v ON v.id = o.o_orderkey),
    e AS (SELECT id, change, change <> 'unchanged' AND id % 2 <> 0 AS outside FROM d)"""


def _diff(r):
    before = r.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("note"))
    after = r.role("delivery")
    allowed = before.select("id").unionByName(after.select("id")).where("id % 2 = 0")
    return diff.scoped_diff(before, after, "id", allowed)


@query("scoped_diff", f"WITH {DIFF_SQL} SELECT id, change, outside FROM e")
def scoped_diff(r):
    return _diff(r)


@query("diff_report", f"WITH {DIFF_SQL} SELECT change, count(*) AS n, count(*) FILTER (outside) AS n_outside FROM e GROUP BY change")
def diff_report(r):
    return diff.diff_report(_diff(r))


MOVED = """SELECT target_id, left_in, CASE WHEN k % 25 = 7 THEN CAST(top_in + 0.5 AS DOUBLE) ELSE top_in END AS top_in, width_in, height_in FROM tgt_head WHERE k % 40 <> 11"""


@query("attribute_diff", f"""
    SELECT h.target_id, CASE WHEN m.target_id IS NULL THEN 'object lost' ELSE 'attributes changed' END AS issue FROM tgt_head h LEFT JOIN ({MOVED}) m ON m.target_id = h.target_id
    WHERE m.target_id IS NULL OR m.top_in <> h.top_in""")
def attribute_diff(r):
    return diff.attribute_diff(r.role("tgt_head"), r.sql(MOVED), "target_id", ["left_in", "top_in", "width_in", "height_in"])


@query("match_index", f"""
    WITH c AS (SELECT k, ix, {norm_sql('label')} AS c FROM src_row WHERE k >= 0),
    t AS (SELECT k, label, {norm_sql('label')} AS n, CAST(row_number() OVER (PARTITION BY k ORDER BY pos, label) - 1 AS INT) AS ix FROM tgt_row),
    m AS (SELECT t.k, t.label, t.ix, min(c.ix) FILTER (c.c = t.n) AS a, min(c.ix) FILTER (contains(c.c, t.n) OR contains(t.n, c.c)) AS b, count(*) AS size FROM t JOIN c ON c.k = t.k GROUP BY t.k, t.label, t.ix)
    SELECT k, label, CAST(coalesce(a, b, CASE WHEN ix < size THEN ix END) AS INT) AS source_ix, CASE WHEN a IS NOT NULL THEN 'equal' WHEN b IS NOT NULL THEN 'contained' END AS how FROM m""")
def match_index(r):
    choices = r.role("src_row").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("ix", norm_label("label").alias("c")))).alias("c")).select("k", F.col("c.c").alias("choices"))
    labels = r.sql("SELECT k, label AS text, CAST(row_number() OVER (PARTITION BY k ORDER BY pos, label) - 1 AS INT) AS ix FROM tgt_row")
    out = joins.match_index(labels.select("k", "text", "ix", norm_label("text").alias("label")).join(choices, "k"))
    return out.select("k", F.col("text").alias("label"), "source_ix", "how")


@query("incremental_pending", """
    WITH el AS (SELECT target_id, k FROM job WHERE score IS NULL OR score < 0.8), b AS (SELECT target_id FROM el WHERE target_id NOT IN (SELECT target_id FROM suggestion) ORDER BY k LIMIT 200)
    SELECT b.target_id, coalesce(j.table_id, '') AS table_id, coalesce(j.score, 0) AS score FROM b LEFT JOIN (SELECT target_id, table_id, score FROM job WHERE k % 3 = 0 AND table_id IS NOT NULL) j USING (target_id)""")
def incremental_pending(r):
    jobs = r.role("job")
    asked = joins.incremental_pending(jobs.where("score is null or score < 0.8").select("target_id", "k"), r.role("suggestion"), 200, order="k")
    answers = jobs.where("k % 3 = 0 and table_id is not null").select("target_id", "table_id", "score")
    return joins.with_defaults(asked, answers, {"table_id": "", "score": 0.0})
