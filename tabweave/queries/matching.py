"""Similarity, candidate scoring and assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scores import coverage, jaccard, soft_score
from ..functions.text import norm_label
from ..operators import assignment, candidates, similarity
from .registry import query
from .roles import norm_sql, overlap_sql, soft_sql

# --- scores ----------------------------------------------------------------------

NEIGHBOURS = """SELECT a.k, {A} AS l, {B} AS r FROM phrase a JOIN phrase b ON b.k = CASE WHEN a.k % 3 = 0 THEN a.k + 1 ELSE a.k + 11 END"""


@query("soft_score", f"""
    WITH n AS ({NEIGHBOURS.format(A=norm_sql('a.label'), B=norm_sql('b.label'))}),
    c AS (SELECT *, replace(l, ' ', '') AS lc, replace(r, ' ', '') AS rc FROM n)
    SELECT k, round({soft_sql('l', 'r')}, 6) AS current,
        round(CASE WHEN l = '' OR r = '' THEN 0 WHEN lc = rc THEN 1 WHEN len(lc) > 2 AND len(rc) > 2 AND (contains(lc, rc) OR contains(rc, lc)) THEN 0.92
            ELSE greatest({overlap_sql('l', 'r')}, 0.75 * (1 - CAST(levenshtein(lc, rc) AS DOUBLE) / greatest(len(lc), len(rc), 1))) END, 6) AS legacy,
        round(CASE WHEN l = '' OR r = '' THEN 0 WHEN l = r THEN 1 WHEN contains(l, r) OR contains(r, l) THEN 0.9
            ELSE CAST(len(list_intersect(list_distinct(string_split(l, ' ')), list_distinct(string_split(r, ' ')))) AS DOUBLE) / len(list_distinct(string_split(l, ' '))) END, 6) AS review FROM c""")
def soft_scores(r):
    n = r.sql(NEIGHBOURS.format(A="a.label", B="b.label")).select("k", norm_label("l").alias("l"), norm_label("r").alias("r"))
    return n.select("k", *[F.round(soft_score("l", "r", mode), 6).alias(mode) for mode in ("current", "legacy", "review")])


@query("synonym_rules", f"""
    WITH v AS (SELECT DISTINCT {norm_sql('label')} AS t FROM phrase), p AS (SELECT a.t AS l, b.t AS r FROM v a, v b),
    s AS (SELECT l, r, {soft_sql('l', 'r')} AS score FROM p) SELECT l, r, round(score, 6) AS score FROM s WHERE score >= 0.68""")
def synonym_rules(r):
    v = r.role("phrase").select(norm_label("label").alias("t")).distinct()
    pairs = similarity.similar_pairs(v.select(F.col("t").alias("l")), v.select(F.col("t").alias("r")), 0.68)
    return pairs.select("l", "r", F.round("score", 6).alias("score"))


@query("coverage", f"""
    WITH lab AS (SELECT t.k, {norm_sql('a.label')} AS l FROM tgt_head t JOIN tgt_row a ON a.k = t.k),
    ch AS (SELECT k, {norm_sql('label')} AS r FROM src_row WHERE k >= 0),
    best AS (SELECT lab.k, l, max({soft_sql('l', 'r')}) AS b FROM lab JOIN ch ON ch.k = lab.k GROUP BY lab.k, l)
    SELECT k, round(avg(CASE WHEN b >= 0.68 THEN 1.0 ELSE 0.0 END), 6) AS covered FROM best GROUP BY k""")
def coverage_query(r):
    t = r.role("tgt_row").groupBy("k").agg(F.collect_set(norm_label("label")).alias("ls"))
    s = r.role("src_row").groupBy("k").agg(F.collect_set(norm_label("label")).alias("rs"))
    return t.join(s, "k").select("k", F.round(coverage("ls", "rs"), 6).alias("covered"))


@query("label_jaccard", f"""
    WITH a AS (SELECT DISTINCT k, {norm_sql('label', plus=False)} AS l FROM tgt_row), b AS (SELECT DISTINCT k, {norm_sql('label', plus=False)} AS l FROM src_row WHERE k >= 0),
    n AS (SELECT coalesce(a.k, b.k) AS k, count(*) FILTER (a.l IS NOT NULL AND b.l IS NOT NULL) AS both_n, count(*) AS all_n FROM a FULL JOIN b ON a.k = b.k AND a.l = b.l GROUP BY 1)
    SELECT k, round(CAST(both_n AS DOUBLE) / all_n, 6) AS overlap FROM n WHERE k IN (SELECT k FROM b)""")
def label_jaccard(r):
    t = r.role("tgt_row").groupBy("k").agg(F.collect_set(norm_label("label", plus=False)).alias("ls"))
    s = r.role("src_row").groupBy("k").agg(F.collect_set(norm_label("label", plus=False)).alias("rs"))
    return s.where("k >= 0").join(t, "k").select("k", F.round(jaccard("ls", "rs"), 6).alias("overlap"))


# --- candidate edges -----------------------------------------------------------------

EDGES_SQL = f"""
    tf AS (SELECT target_id, block_id, target_ix, object_type, table_width, target_id AS key1, shape_name AS key2, {norm_sql('nearby_text')} AS nearby,
              {norm_sql("array_to_string(list_concat([target_id, shape_name, nearby_text], categories, series, cell_texts), ' ')")} AS context, categories, series
           FROM target WHERE object_type IN ('chart', 'table')),
    sf AS (SELECT table_id, block_id, table_ix, source_id, graph_id, categories, series, regexp_extract_all(title || chr(10) || graph_id, '(?i)obj[_\\s]*([0-9]{{4,}})', 1) AS obj,
              {norm_sql("regexp_replace(regexp_extract(file_name, '[^/]*$'), '\\.[^.]*$', '')")} AS stem,
              {norm_sql("array_to_string(list_concat([regexp_replace(regexp_extract(file_name, '[^/]*$'), '\\.[^.]*$', ''), title, graph_id], categories, series), ' ')")} AS context FROM source_table),
    tlab AS (SELECT target_id, axis, label, count(*) AS w FROM (SELECT target_id, 'c' AS axis, {norm_sql('unnest(categories)')} AS label FROM tf WHERE object_type = 'chart'
              UNION ALL SELECT target_id, 's', {norm_sql('unnest(series)')} FROM tf WHERE object_type = 'chart') x WHERE label <> '' GROUP BY ALL),
    slab AS (SELECT DISTINCT table_id, axis, label FROM (SELECT table_id, 'c' AS axis, {norm_sql('unnest(categories)')} AS label FROM sf UNION ALL SELECT table_id, 's', {norm_sql('unnest(series)')} FROM sf) x WHERE label <> ''),
    lp AS (SELECT l, r FROM (SELECT DISTINCT label AS l FROM tlab) a, (SELECT DISTINCT label AS r FROM slab) b WHERE {soft_sql('l', 'r')} >= 0.68),
    pr AS (SELECT t.target_id, s.table_id, t.block_id, t.target_ix, t.object_type, s.table_ix,
              CASE WHEN list_contains(s.obj, key1) OR list_contains(s.obj, key2) THEN 1 ELSE 0 END AS oh,
              CASE WHEN s.source_id <> '' AND s.source_id IN (key1, key2) THEN 1 ELSE 0 END AS sh, CASE WHEN s.graph_id <> '' AND s.graph_id IN (key1, key2) THEN 1 ELSE 0 END AS mh,
              CASE WHEN len(s.stem) > 2 THEN greatest({soft_sql('s.stem', 't.context')}, {soft_sql('s.stem', 't.nearby')}, {soft_sql('t.nearby', 's.context')}) ELSE 0 END AS fs,
              CASE WHEN t.object_type = 'table' AND t.table_width > 0 AND t.table_width = len(s.categories) THEN 1 ELSE 0 END AS wh
           FROM tf t JOIN sf s ON s.block_id = t.block_id OR s.block_id IS NULL),
    hit AS (SELECT p.target_id, p.table_id, tl.axis AS ta, sl.axis AS sa, tl.label, max(tl.w) AS w FROM pr p JOIN tlab tl ON tl.target_id = p.target_id JOIN lp ON lp.l = tl.label
              JOIN slab sl ON sl.table_id = p.table_id AND sl.label = lp.r GROUP BY ALL),
    cov AS (SELECT target_id, table_id, sum(w) FILTER (ta = 'c' AND sa = 'c') AS cc, sum(w) FILTER (ta = 'c' AND sa = 's') AS cs, sum(w) FILTER (ta = 's' AND sa = 's') AS ss, sum(w) FILTER (ta = 's' AND sa = 'c') AS sc FROM hit GROUP BY ALL),
    cnt AS (SELECT target_id, sum(w) FILTER (axis = 'c') AS nc, sum(w) FILTER (axis = 's') AS ns, count(*) FILTER (axis = 's' AND contains(label, 'COMP')) AS comp FROM tlab GROUP BY target_id),
    ax AS (SELECT p.*, coalesce(CAST(greatest(coalesce(cc, 0), coalesce(cs, 0)) AS DOUBLE) / nullif(nc, 0), 0) AS cat, coalesce(CAST(greatest(coalesce(ss, 0), coalesce(sc, 0)) AS DOUBLE) / nullif(ns, 0), 0) AS ser,
              coalesce(comp, 0) >= 2 AS comp FROM pr p LEFT JOIN cov USING (target_id, table_id) LEFT JOIN cnt USING (target_id)),
    sc AS (SELECT *, oh + sh + mh > 0 AS strong, greatest(0.0, least(1.0, oh * 0.95 + sh * 0.72 + mh * 0.2 + CASE WHEN fs >= 0.55 THEN 0.18 * fs ELSE 0 END
              + CASE WHEN object_type <> 'chart' THEN 0 WHEN least(cat, ser) >= 0.45 THEN 0.35 * cat + 0.3 * ser ELSE 0.18 * cat + 0.16 * ser END
              + CASE WHEN object_type = 'chart' AND oh + sh + mh = 0 AND comp AND ser < 0.8 THEN -0.25 ELSE 0 END + wh * 0.18)) AS score FROM ax),
    edge AS (SELECT * FROM sc WHERE score > 0)"""


@query("candidate_edges", f"""
    WITH {EDGES_SQL} SELECT block_id, target_id, table_id, round(score, 6) AS score, strong FROM edge""")
def candidate_edges(r):
    edges = candidates.candidate_edges(r.targets(), r.source_tables())
    return edges.select("block_id", "target_id", "table_id", F.round("score", 6).alias("score"), "strong")

# --- ranking and assignment -------------------------------------------------------------


def edges_of(r):
    """The edges of one scale, written once per session and used by many queries."""
    return r.kept("edges", lambda: candidates.candidate_edges(r.targets(), r.source_tables()))


@query("composite_score", f"""
    WITH {EDGES_SQL} SELECT target_id, table_id, round(score, 6) AS score, round(cat, 6) AS cat_score, round(ser, 6) AS ser_score,
        array_to_string(list_filter([CASE WHEN oh > 0 THEN 'object id' END, CASE WHEN sh > 0 THEN 'source id' END, CASE WHEN mh > 0 THEN 'metadata id' END,
            CASE WHEN fs >= 0.55 THEN 'file name ' || CAST(CAST(round_even(fs * 100, 0) AS INT) AS VARCHAR) || '%' END,
            CASE WHEN object_type = 'chart' AND oh + sh + mh = 0 AND comp AND ser < 0.8 THEN 'comparison series incomplete' END,
            CASE WHEN object_type = 'chart' THEN 'categories ' || CAST(CAST(round_even(cat * 100, 0) AS INT) AS VARCHAR) || '%, series ' || CAST(CAST(round_even(ser * 100, 0) AS INT) AS VARCHAR) || '%' END,
            CASE WHEN wh > 0 THEN 'table width' END], lambda v: v IS NOT NULL), '; ') AS reasons FROM edge""")
def composite_score(r):
    return edges_of(r).select("target_id", "table_id", F.round("score", 6).alias("score"), F.round("cat_score", 6).alias("cat_score"),
                              F.round("ser_score", 6).alias("ser_score"), F.array_join("reasons", "; ").alias("reasons"))


@query("relevant_sources", f"""
    WITH {EDGES_SQL}, best AS (SELECT block_id, table_id FROM edge QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY round(score, 9) DESC, table_ix) <= 4),
    b AS (SELECT DISTINCT block_id FROM tf)
    SELECT DISTINCT block_id, table_id, 'scored' AS scope FROM best
    UNION ALL SELECT b.block_id, sf.table_id, 'own' FROM b LEFT JOIN sf USING (block_id) WHERE b.block_id NOT IN (SELECT block_id FROM best)""")
def relevant_sources(r):
    """Sources worth sending to a reviewer of each block."""
    edges = edges_of(r).withColumn("score", F.round("score", 9))
    return candidates.relevant_sources(edges, r.targets(), r.source_tables(), 4)


@query("topk_candidates", f"""
    WITH {EDGES_SQL} SELECT target_id, table_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY target_id ORDER BY round(score, 9) DESC, table_ix) AS INT) AS rank
    FROM edge QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY round(score, 9) DESC, table_ix) <= 4""")
def topk_candidates(r):
    edges = edges_of(r).withColumn("score", F.round("score", 9))
    return candidates.top_candidates(edges, 4).select("target_id", "table_id", F.round("score", 6).alias("score"), "rank")


@query("confidence", f"""
    WITH {EDGES_SQL},
    top AS (SELECT target_id, target_ix, object_type, table_id, table_ix, round(score, 9) AS score, strong FROM edge QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY round(score, 9) DESC, table_ix) = 1),
    sec AS (SELECT t.*, coalesce((SELECT max(round(e.score, 9)) FROM edge e WHERE e.target_id = t.target_id AND e.table_id <> t.table_id), 0) AS second FROM top t)
    SELECT target_id, table_id, round(score - second, 6) AS margin, NOT strong AND round(score - second, 9) >= 0.12 AND score >= 0.5 AS clear,
        round(CASE WHEN strong THEN least(1, greatest(score, 0.9)) WHEN score >= 0.5 AND round(score - second, 9) >= 0.12 THEN least(1, score + (score - second) + 0.15) ELSE least(1, score) END, 6) AS confidence,
        score >= CASE WHEN strong OR object_type = 'table' THEN 0.35 ELSE 0.45 END AS accepted FROM sec""")
def confidence(r):
    edges = edges_of(r).withColumn("score", F.round("score", 9))
    top = candidates.top_candidates(edges, 1)
    pairs = assignment.runner_up(edges, top)
    kept = assignment.accepted(pairs).select("target_id", F.lit(True).alias("ok"))
    return pairs.join(kept, "target_id", "left").select(
        "target_id", "table_id", F.round(F.col("score") - F.col("second_best"), 6).alias("margin"), assignment.clear_winner().alias("clear"),
        F.round(assignment.confidence(), 6).alias("confidence"), F.coalesce("ok", F.lit(False)).alias("accepted"))


@query("assign_optimal", f"""
    WITH RECURSIVE {EDGES_SQL},
    ti AS (SELECT block_id, target_ix, dense_rank() OVER (PARTITION BY block_id ORDER BY target_ix) AS i FROM (SELECT DISTINCT block_id, target_ix FROM edge) x),
    si AS (SELECT block_id, table_ix, dense_rank() OVER (PARTITION BY block_id ORDER BY table_ix) - 1 AS j FROM (SELECT DISTINCT block_id, table_ix FROM edge) x),
    e AS (SELECT block_id, i, CAST(j AS INT) AS j, round(score, 6) AS w FROM edge JOIN ti USING (block_id, target_ix) JOIN si USING (block_id, table_ix)),
    dp AS (SELECT DISTINCT block_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS mask, CAST(0 AS DOUBLE) AS total FROM e
        UNION ALL
        SELECT block_id, i, mask, max(total) FROM (
            SELECT d.block_id, d.i + 1 AS i, d.mask | CASE WHEN x.j < 0 THEN 0 ELSE (CAST(1 AS BIGINT) << x.j) END AS mask, d.total + x.w AS total
            FROM dp d JOIN (SELECT block_id, i, j, w FROM e UNION ALL SELECT DISTINCT block_id, i, -1, 0 FROM e) x
                ON x.block_id = d.block_id AND x.i = d.i + 1 AND (x.j < 0 OR (d.mask & (CAST(1 AS BIGINT) << x.j)) = 0)) n GROUP BY block_id, i, mask)
    SELECT block_id, round(max(total), 4) AS total FROM dp GROUP BY block_id""")
def assign_optimal(r):
    edges = edges_of(r).withColumn("score", F.round("score", 6))
    chosen = assignment.assign_optimal(edges)
    return chosen.join(edges, ["block_id", "target_ix", "table_ix"]).groupBy("block_id").agg(F.round(F.sum("score"), 4).alias("total"))


GREEDY_SQL = """
    rk AS (SELECT block_id, target_id, table_id, w, row_number() OVER (PARTITION BY block_id ORDER BY w DESC, target_ix, table_ix) AS rn FROM e),
    g AS (SELECT DISTINCT block_id, CAST(0 AS BIGINT) AS rn, CAST([] AS VARCHAR[]) AS ut, CAST([] AS VARCHAR[]) AS us, CAST(NULL AS VARCHAR) AS target_id, CAST(NULL AS VARCHAR) AS table_id, CAST(NULL AS DOUBLE) AS w FROM rk
        UNION ALL
        SELECT g.block_id, k.rn, CASE WHEN ok THEN list_append(ut, k.target_id) ELSE ut END, CASE WHEN ok THEN list_append(us, k.table_id) ELSE us END,
            CASE WHEN ok THEN k.target_id END, CASE WHEN ok THEN k.table_id END, k.w
        FROM (SELECT g.block_id, g.ut, g.us, k.rn, k.target_id, k.table_id, k.w, NOT list_contains(g.ut, k.target_id) AND NOT list_contains(g.us, k.table_id) AS ok
              FROM g JOIN rk k ON k.block_id = g.block_id AND k.rn = g.rn + 1) k JOIN (SELECT 1 AS one) z ON true JOIN (SELECT DISTINCT block_id FROM rk) g ON g.block_id = k.block_id)
    SELECT target_id, table_id, round(w, 6) AS score FROM g WHERE target_id IS NOT NULL"""


@query("assign_greedy", f"""
    WITH RECURSIVE {EDGES_SQL}, e AS (SELECT block_id, target_id, table_id, target_ix, table_ix, round(score, 9) AS w FROM edge WHERE score >= 0.45), {GREEDY_SQL}""")
def assign_greedy(r):
    edges = edges_of(r).where("score >= 0.45").withColumn("score", F.round("score", 9))
    picks = assignment.assign_greedy(edges, ["block_id", "target_id"], ["block_id", "table_id"], [-F.col("score"), F.col("target_ix"), F.col("table_ix")])
    return picks.select("target_id", "table_id", F.round("score", 6).alias("score"))
