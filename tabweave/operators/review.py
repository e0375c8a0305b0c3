"""Review decisions: routing, precedence, ambiguity, batches and summaries."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.scores import coverage, soft_score
from ..functions.text import norm_label

# The levels decisions switch at.
PLAUSIBLE, REVIEW_BELOW, BLOCK_BELOW = 0.30, 0.80, 0.82
AMBIGUOUS_GAP, MATCH_FLOOR = 0.08, 0.68
SUGGESTION_LOW, SUGGESTION_SURE = 0.72, 0.85
BATCH_SIZE, MAX_BATCHES, WORK_FLOOR = 10, 12, 0.25
LEGACY_WEIGHTS = {"header": 0.44, "row": 0.34, "variable": 0.14, "opening": 0.05, "metadata": 0.03}
MISSING_NAMED = 6
QUALITY_LEVELS = {"rows_ok": 70, "cols_ok": 80, "filled": 70, "confidence": 72}


def legacy_score(header, row, variable, opening, metadata, same_id=None) -> Column:
    """Weighted score of five parts; an equal id is a full match."""
    parts = {"header": header, "row": row, "variable": variable, "opening": opening, "metadata": metadata}
    total = F.lit(0.0)
    for name, column in parts.items():
        total = total + LEGACY_WEIGHTS[name] * F.col(column)
    total = F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))
    return total if same_id is None else F.when(F.col(same_id), 1.0).otherwise(total)


def legacy_parts(pairs: DataFrame) -> DataFrame:
    """``pairs`` with the five parts of the legacy score (header, row, variable, opening, metadata) and ``same_id``, measured from texts.

    Arrays of labels: headers, rows, source_headers, source_rows.  Texts: variable, hints, opening, opening_hints (of the mapping), target_text, question,
    source_text.  Names: graph_id (of the mapping), target_graph_id, source_graph_id, '' where unknown.  Labels and texts are compared by the legacy rule;
    an axis counts with the mean of its labels' best scores."""
    normed = lambda c: F.transform(c, lambda v: norm_label(v, plus=False))
    like = lambda a, b: soft_score(norm_label(a, plus=False), norm_label(b, plus=False), "legacy", rules=False)
    heads = F.array_join("source_headers", " ")
    known = F.col("source_graph_id") != ""
    return pairs.withColumns({
        "header": coverage(normed("headers"), normed("source_headers"), "legacy"), "row": coverage(normed("rows"), normed("source_rows"), "legacy"),
        "variable_part": F.greatest(like("variable", "question"), like("hints", "source_text"), like("target_text", "source_text") * 0.7),
        "opening_part": F.greatest(like("opening", heads), like("opening_hints", heads)),
        "metadata": F.when(known & F.col("source_graph_id").isin(F.col("graph_id"), F.col("target_graph_id")), 1.0).otherwise(0.0),
        "same_id": known & (F.col("graph_id") == F.col("source_graph_id")),
    })


def ambiguity(edges: DataFrame, floor: float = MATCH_FLOOR, gap: float = AMBIGUOUS_GAP) -> DataFrame:
    """Per contract: matched, ambiguous_source or missing_source, from the best two
    scores.  The two are kept by aggregates that merge before the shuffle."""
    best = edges.groupBy("target_id").agg(F.max(F.struct("score", -F.col("table_ix"), "table_id")).alias("b"))
    rest = edges.join(best, "target_id").where(F.col("table_id") != F.col("b.table_id"))
    second = rest.groupBy("target_id").agg(F.max("score").alias("second"))
    s, margin = F.col("b.score"), F.col("b.score") - F.coalesce("second", F.lit(0.0))
    status = F.when(s < floor, "missing_source").when(margin >= gap, "matched").otherwise("ambiguous_source")
    return best.join(second, "target_id", "left").select("target_id", F.col("b.table_id").alias("table_id"), status.alias("status"))


def review_route(targets: DataFrame, plans: DataFrame, best: DataFrame) -> DataFrame:
    """Where a contract goes next: ok, low_confidence, unmatched or no_source."""
    route = (
        F.when(F.col("confidence").isNull() & (F.coalesce("best_score", F.lit(0.0)) < PLAUSIBLE), "no_source")
        .when(F.col("confidence").isNull(), "unmatched").when(F.col("confidence") < REVIEW_BELOW, "low_confidence").otherwise("ok")
    )
    return targets.join(plans, "target_id", "left").join(best, "target_id", "left").select("target_id", route.alias("route"))


def block_review(jobs: DataFrame) -> DataFrame:
    """Per block whether it needs review and the first reason that applies."""
    counts = jobs.groupBy("block_id").agg(
        F.count_if(F.col("score").isNull()).alias("missing"), F.count_if(F.col("score") < BLOCK_BELOW).alias("low"),
        F.count_if(F.col("warned") == 1).alias("warned"))
    reason = (
        F.when(F.col("missing") > 0, F.concat(F.col("missing").cast("string"), F.lit(" without source")))
        .when(F.col("low") > 0, F.concat(F.col("low").cast("string"), F.lit(" below confidence")))
        .when(F.col("warned") > 0, F.concat(F.col("warned").cast("string"), F.lit(" with warnings"))).otherwise("all matched")
    )
    return counts.select("block_id", ((F.col("missing") + F.col("low") + F.col("warned")) > 0).alias("needs_review"), reason.alias("reason"))


def work_batches(pending: DataFrame, score: str = "score", order: str = "target_ix", size: int = BATCH_SIZE, batches: int = MAX_BATCHES) -> DataFrame:
    """The work of one run, plausible items first and best first, in numbered
    batches.  The cap is the feature: sort and limit become a top-k, so the rank is
    computed over at most ``size * batches`` rows."""
    plausible = (F.col(score) >= WORK_FLOOR).cast("int")
    head = pending.withColumn("_p", plausible).orderBy(F.desc("_p"), F.desc(score), order).limit(size * batches)
    rank = F.row_number().over(W.orderBy(F.desc("_p"), F.desc(score), order))
    return head.withColumn("batch", F.floor((rank - 1) / size).cast("int")).drop("_p")


def duplicate_contracts(targets: DataFrame, signature: list) -> DataFrame:
    """Contracts of one block that ask for the same thing: (block_id, signature, n)."""
    return targets.groupBy("block_id", *signature).agg(F.count("*").alias("n")).where("n > 1")


def choice_precedence(rows: DataFrame) -> DataFrame:
    """The source to use: manual, else suggested, else found, else first candidate;
    with the alerts and whether it is used by default."""
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    suggested = filled("suggested").isNotNull()
    differs = suggested & filled("found").isNotNull() & (F.col("suggested") != F.col("found"))
    low = suggested & (F.col("confidence") < SUGGESTION_LOW)
    alert = F.concat_ws("; ", F.when(differs, "suggestion differs"), F.when(low, "low confidence"))
    use = filled("manual").isNotNull() | (F.col("ok") & ~low & ~(differs & (F.col("confidence") < SUGGESTION_SURE)))
    return rows.withColumn("choice", F.coalesce(filled("manual"), filled("suggested"), filled("found"), filled("first"), F.lit(""))).withColumn(
        "alert", alert).withColumn("use", F.coalesce(use, F.lit(False)))


def reviewed_selection(rows: DataFrame, targets: DataFrame, tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows marked for use that name a known contract and source, and the others."""
    t = targets.select("target_id").distinct().withColumn("_t", F.lit(1))
    s = tables.select("table_id").distinct().withColumn("_s", F.lit(1))
    known = rows.where("use").join(t, "target_id", "left").join(s, "table_id", "left").withColumn("_ok", F.col("_t").isNotNull() & F.col("_s").isNotNull()).drop("_t", "_s")
    return known.where("_ok").drop("_ok"), known.where("not _ok").drop("_ok")


def match_records(targets: DataFrame, ranked: DataFrame) -> DataFrame:
    """One JSON record per block: its contracts with their ranked candidates."""
    candidates = ranked.groupBy("target_id").agg(F.array_sort(F.collect_list(F.struct("rank", "table_id", "score"))).alias("candidates"))
    items = targets.join(candidates, "target_id", "left").groupBy("block_id").agg(
        F.count("*").alias("n_targets"), F.array_sort(F.collect_list(F.struct("target_id", "object_type", "candidates"))).alias("objects"))
    return items.select("block_id", "n_targets", F.to_json(F.struct("block_id", "objects")).alias("record"))


def quality_measures(jobs: DataFrame, fill: DataFrame, named: int = MISSING_NAMED) -> DataFrame:
    """Per plan the percentages rows_ok, cols_ok and filled (0 to 100, one decimal), with the first ``named`` labels not found.

    ``jobs``: target_id, the arrays rows, headers, source_rows, source_headers, and further columns that stay; ``fill``: target_id, n_values,
    n_filled of its matrix.  A label is found when its review score with any label of the source reaches the match floor; blank labels are
    not asked for.  Without labels or values the percentage is 0."""
    out = jobs.join(fill, "target_id", "left")
    for name, own, other in (("rows", "rows", "source_rows"), ("cols", "headers", "source_headers")):
        empty = F.array().cast("array<string>")
        asked = F.transform(F.coalesce(F.col(own), empty), lambda v: F.struct(v.alias("label"), norm_label(v, plus=False).alias("key")))
        choices = F.array_distinct(F.transform(F.coalesce(F.col(other), empty), lambda v: norm_label(v, plus=False)))
        out = out.withColumn("_asked", F.filter(asked, lambda v: v["key"] != "")).withColumn("_choices", choices)
        lost = F.filter("_asked", lambda v: ~F.exists("_choices", lambda c: soft_score(v["key"], c, "review") >= MATCH_FLOOR))
        out = out.withColumn("_lost", F.transform(lost, lambda v: v["label"]))
        share = F.when(F.size("_asked") > 0, (F.size("_asked") - F.size("_lost")) * 100 / F.size("_asked")).otherwise(0.0)
        out = out.withColumn(f"{name}_ok", F.bround(share, 1)).withColumn(f"{name}_missing", F.array_join(F.slice("_lost", 1, named), ", "))
    filled = F.when(F.col("n_values") > 0, F.col("n_filled") * 100 / F.col("n_values")).otherwise(0.0)
    return out.withColumn("filled", F.bround(filled, 1)).drop("_asked", "_choices", "_lost", "n_values", "n_filled", "rows", "headers", "source_rows", "source_headers")


def quality_report(rows: DataFrame) -> DataFrame:
    """Verdict of percentages rows_ok, cols_ok, filled and confidence (0 to 100)."""
    below = lambda c: F.col(c) < QUALITY_LEVELS[c]
    alerts = F.array_compact(F.array(
        F.when(below("rows_ok"), "rows"), F.when(below("cols_ok"), "columns"), F.when(below("filled"), "empty values"), F.when(below("confidence"), "confidence")))
    return rows.withColumn("alerts", F.array_join(alerts, "; ")).withColumn("verdict", F.when(F.size(alerts) > 0, "Review").otherwise("OK"))


def reading_order(targets: DataFrame) -> DataFrame:
    """Contracts by block, top and left; missing positions last."""
    last = lambda c: F.coalesce(c, F.lit(9999))
    return targets.orderBy(last("block_id"), last("top_in"), last("left_in"), "target_id")


def stable_ids(targets: DataFrame) -> DataFrame:
    """An id per contract: a well-formed name only one contract has stays; others
    are numbered in reading order inside their block, past the names that earlier
    contracts keep.

    Only blocks whose numbers could meet a kept name are numbered one after the other, streamed in order; what is
    held are the kept names of one block."""
    valid = F.col("shape_name").rlike(r"^S\d{3}_T\d{3}_[A-Z0-9_]+$")
    names = targets.where(valid).groupBy("shape_name").agg(F.count("*").alias("_n"))
    order = [F.round("top_in", 3), F.round("left_in", 3), F.col("shape_id"), F.col("object_type"), F.col("shape_name")]
    kind = F.upper(F.regexp_replace(F.regexp_replace("object_type", "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))
    t = targets.join(names, "shape_name", "left").withColumn("_kept", F.coalesce(F.col("_n") == 1, F.lit(False))).withColumn("_kind", kind).drop("_n")
    block = F.substring("shape_name", 2, 3).try_cast("int")
    kept = t.where("_kept").where(block >= F.col("block_id")).select("shape_name", F.col("block_id").alias("_own"), block.cast(t.schema["block_id"].dataType).alias("block_id"))
    met = kept.select("block_id").distinct()

    made = F.format_string("S%03d_T%03d_%s", F.col("block_id"), F.row_number().over(W.partitionBy("block_id").orderBy(*order)), F.col("_kind"))
    free = t.join(met, "block_id", "left_anti").withColumn("stable_id", F.when(F.col("_kept"), F.col("shape_name")).otherwise(made))

    rows = t.join(met, "block_id", "left_semi").withColumn("_first", F.lit(1))
    # names kept in earlier blocks come before the rows of the block they look like
    ahead = kept.where("_own < block_id").drop("_own").withColumn("_first", F.lit(0))
    stream = rows.unionByName(ahead, allowMissingColumns=True).repartition("block_id").sortWithinPartitions("block_id", "_first", *order)
    numbered = stream.mapInArrow(_number, StructType([*stream.schema.fields, StructField("stable_id", StringType())]))
    return free.unionByName(numbered.drop("_first")).drop("_kept", "_kind")


def _number(batches):
    """Rows in order with their ids; rows with ``_first`` 0 only name what is taken."""
    block, ordinal, taken = None, 0, set()
    for batch in batches:
        ids, rows = [], []
        columns = (batch.column(c).to_pylist() for c in ("block_id", "_first", "_kept", "shape_name", "_kind"))
        for at, (b, first, kept, name, kind) in enumerate(zip(*columns)):
            if b != block:
                block, ordinal, taken = b, 0, set()
            if first == 0:
                taken.add(name)
                continue
            ordinal += 1
            if kept:
                taken.add(name)
            else:
                while f"S{b:03d}_T{ordinal:03d}_{kind}" in taken:
                    ordinal += 1
            rows.append(at)
            ids.append(name if kept else f"S{b:03d}_T{ordinal:03d}_{kind}")
        out = batch.take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(ids, pa.string())], names=[*out.schema.names, "stable_id"])
