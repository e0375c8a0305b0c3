"""Joins with a rule: first alias wins, unique keys, cascades, ranges, upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import base_name, join_unique
from ..session import cut_lineage


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key under a total order (not an arbitrary one)."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def chart_jobs(mapping: DataFrame, targets: DataFrame, sources: DataFrame) -> DataFrame:
    """Each mapping row with its contract and source by exact id, and a status."""
    t = targets.select("id", F.lit(True).alias("_t"))
    s = sources.select("id", "table_id")
    status = (
        F.when(~F.col("update"), "skipped").when(F.col("table_id").isNull(), "missing_source")
        .when(F.col("_t").isNull(), "missing_target").otherwise("ok")
    )
    return mapping.join(t, "id", "left").join(s, "id", "left").withColumn("status", status).drop("_t")


def alias_join(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """entries(entry_ix, names array) to aliases(alias, target_id, target_ix): the
    first of an entry's names that is known wins, and for a name several contracts
    carry the earliest contract."""
    known = first_by(aliases.select("alias", "target_id", "target_ix"), ["alias"], "target_ix")
    hits = entries.select("entry_ix", F.posexplode("names").alias("_p", "alias")).join(known, "alias")
    return first_by(hits, ["entry_ix"], "_p").select("entry_ix", "target_id")


def unique_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Join only on keys that exactly one right row has."""
    others = [F.first(c).alias(c) for c in right.columns if c != key]
    once = right.where(F.col(key) != "").groupBy(key).agg(F.count("*").alias("_n"), *others).where("_n = 1").drop("_n")
    return left.join(once, key)


def basename_join(left: DataFrame, files: DataFrame, left_name: str, file_name: str, order: str) -> DataFrame:
    """Join on the lower-case base name; of files that share one the first wins."""
    named = first_by(files.withColumn("_b", F.lower(base_name(file_name))), ["_b"], order)
    return left.withColumn("_b", F.lower(base_name(left_name))).where("_b <> ''").join(named, "_b").drop("_b")


def cascade_join(steps: list[DataFrame], key: list[str], *order) -> DataFrame:
    """Candidates of several joins, best step first: one row per key."""
    tagged = [s.withColumn("step", F.lit(i)) for i, s in enumerate(steps)]
    return first_by(reduce(lambda a, b: a.unionByName(b), tagged), key, "step", *order)


def fallback_scope(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """(block_id, scope): which files a block looks at: its ``own``; without any, the
    ``general`` ones; when there are no general files either, ``all``.  The lists
    themselves are ``scope_files``, once each, not once a block."""
    owners = files.where("block_id is not null").select("block_id", F.lit("own").alias("scope")).distinct()
    shared = "all" if files.where("block_id is null").limit(1).count() == 0 else "general"
    return blocks.join(owners, "block_id", "left").select("block_id", F.coalesce("scope", F.lit(shared)).alias("scope"))


def scope_files(files: DataFrame) -> DataFrame:
    """Files with the scope they are listed in: ``own`` below their block, ``general``
    without one, and every file once more below ``all`` when none is general."""
    known = files.withColumn("scope", F.when(F.col("block_id").isNull(), "general").otherwise("own"))
    if files.where("block_id is null").limit(1).count() == 0:
        known = known.unionByName(files.withColumn("block_id", F.lit(None).cast(files.schema["block_id"].dataType)).withColumn("scope", F.lit("all")))
    return known


def _level(lo: str, hi: str):
    """The power of two that an interval's length needs: at this level or a higher one it reaches into two bins at most."""
    length = F.col(hi).cast("bigint") - F.col(lo).cast("bigint")
    return F.when(length <= 0, 0).otherwise(F.length(F.bin(length)))


def _in_bins(df: DataFrame, spans: list[tuple[str, str]], others: list[list[int]], side: str) -> DataFrame:
    """Rows once for each bin they reach, in each dimension at their own level and at the higher levels of the other side."""
    for d, ((lo, hi), levels) in enumerate(zip(spans, others, strict=True)):
        own, grid, bin_ = f"_{side}{d}", f"_level{d}", f"_bin{d}"
        known = F.array(*[F.lit(x) for x in levels]).cast("array<int>")
        df = df.withColumn(own, _level(lo, hi)).withColumn(grid, F.explode(F.array_union(F.array(F.col(own)), F.filter(known, lambda x: x > F.col(own)))))
        ends = [F.expr(f"shiftright(cast(`{c}` as bigint), `{grid}`)") for c in (lo, hi)]
        df = df.withColumn(bin_, F.explode(F.sequence(*ends)))
    return df


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], *spans: tuple[str, str, str, str]) -> DataFrame:
    """Rows of both sides with equal keys whose intervals [l0, l1] and [r0, r1] meet in every dimension of ``spans`` (l0, l1, r0, r1).

    Two intervals meet in a bin of the larger one's level, a power of two as wide as the interval at least.  So each side is cut at its own level and at
    the higher ones that occur on the other side (at most 64, read first), and both sides share key, levels and bins.  A pair is kept in the first
    bin that both reach, so it appears once."""
    mine, theirs = [(a, b) for a, b, _, _ in spans], [(c, d) for _, _, c, d in spans]
    seen = lambda df, ends: [sorted(df.agg(F.collect_set(_level(lo, hi))).first()[0]) for lo, hi in ends]
    lb = _in_bins(left, mine, seen(right, theirs), "l")
    rb = _in_bins(right, theirs, seen(left, mine), "r")
    own = [f"_{x}{d}" for d in range(len(spans)) for x in ("level", "bin")]
    meet = F.lit(True)
    for d, (l0, l1, r0, r1) in enumerate(spans):
        meet = meet & (F.col(f"_level{d}") == F.greatest(f"_l{d}", f"_r{d}")) & (F.col(l0) <= F.col(r1)) & (F.col(r0) <= F.col(l1))
        meet = meet & (F.col(f"_bin{d}") == F.expr(f"shiftright(greatest(cast(`{l0}` as bigint), cast(`{r0}` as bigint)), `_level{d}`)"))
    return lb.join(rb, [*keys, *own]).where(meet).drop(*own, *[f"_{x}{d}" for d in range(len(spans)) for x in "lr"])


# --- boxes on a page -----------------------------------------------------------------


def overlap_ratio(left_a, width_a, left_b, width_b) -> Column:
    """Shared horizontal extent over the narrower width."""
    a, wa, b, wb = (F.col(c) if isinstance(c, str) else c for c in (left_a, width_a, left_b, width_b))
    shared = F.greatest(F.lit(0.0), F.least(a + wa, b + wb) - F.greatest(a, b))
    narrow = F.least(wa, wb)
    return F.when(narrow != 0, shared / narrow).otherwise(0.0)


def _boxes(boxes: DataFrame) -> DataFrame:
    return boxes.select("block_id", "box_ix", "text", *[F.col(c).alias(f"b_{c}") for c in ("left_in", "top_in", "width_in", "height_in")])


# How much overlap and nearness shorten a distance.
OVERLAP_FACTOR, NEAR_FACTOR, OVERLAP_MIN, NEAR_GAP, BELOW_SLACK = 0.45, 0.7, 0.2, 0.35, 0.5


def _weighted(distance):
    vertical = F.least(
        F.abs(F.col("b_top_in") + F.col("b_height_in") - F.col("top_in")),
        F.abs(F.col("top_in") + F.col("height_in") - F.col("b_top_in")),
    )
    bottom = F.col("top_in") + F.col("height_in")
    beside = (overlap_ratio("left_in", "width_in", "b_left_in", "b_width_in") >= OVERLAP_MIN) & (
        F.col("b_top_in") <= bottom) & (F.col("b_top_in") + F.col("b_height_in") <= bottom + BELOW_SLACK)
    return distance * F.when(beside, OVERLAP_FACTOR).otherwise(1.0) * F.when(vertical <= NEAR_GAP, NEAR_FACTOR).otherwise(1.0)


def nearest_text(targets: DataFrame, boxes: DataFrame, k: int = 8, radius: float = 4.0) -> DataFrame:
    """Texts of the ``k`` nearest boxes of each contract, by weighted distance.

    Boxes are searched on a grid of cells as wide as the radius.  A contract is
    done when its k-th weighted distance cannot be beaten from outside the radius;
    the others go on with twice the radius."""
    cx = lambda p: F.col(f"{p}left_in") + F.col(f"{p}width_in") / 2
    cy = lambda p: F.col(f"{p}top_in") + F.col(f"{p}height_in") / 2
    b = _boxes(boxes).withColumn("_bx", cx("b_")).withColumn("_by", cy("b_"))
    t = targets.select("block_id", "target_id", "left_in", "top_in", "width_in", "height_in").withColumn("_tx", cx("")).withColumn("_ty", cy(""))
    span = b.select("block_id", F.col("_bx").alias("x"), F.col("_by").alias("y")).unionByName(t.select("block_id", F.col("_tx").alias("x"), F.col("_ty").alias("y")))
    span = span.groupBy("block_id").agg((F.max("x") - F.min("x") + F.max("y") - F.min("y")).alias("span"))
    rest = t.join(span, "block_id").join(b.select("block_id").distinct(), "block_id", "left_semi")
    done = None
    order = W.partitionBy("target_id").orderBy("d", "box_ix")
    least_factor = OVERLAP_FACTOR * NEAR_FACTOR
    while True:
        cell = lambda v: F.floor(v / radius)
        around = F.array(F.lit(-1), F.lit(0), F.lit(1))
        probe = rest.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around)).withColumn(
            "_cx", cell(F.col("_tx")) + F.col("_dx")).withColumn("_cy", cell(F.col("_ty")) + F.col("_dy"))
        raw = F.abs(F.col("_tx") - F.col("_bx")) + F.abs(F.col("_ty") - F.col("_by"))
        near = (
            probe.join(b.withColumn("_cx", cell(F.col("_bx"))).withColumn("_cy", cell(F.col("_by"))), ["block_id", "_cx", "_cy"])
            .where(raw <= radius).withColumn("d", _weighted(raw))
            .withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
        )
        found = near.groupBy("target_id").agg(
            F.array_sort(F.collect_list(F.struct("n", "text"))).alias("hits"), F.max("n").alias("n"), F.max("d").alias("worst"))
        state = rest.join(found, "target_id", "left").withColumn(
            "_done", (F.col("span") <= radius) | ((F.coalesce("n", F.lit(0)) == k) & (F.col("worst") <= least_factor * radius)))
        state = cut_lineage(state, "near")
        ready = state.where("_done").select("target_id", "hits")
        done = ready if done is None else done.unionByName(ready)
        rest = state.where("not _done").drop("hits", "n", "worst", "_done")
        if rest.limit(1).count() == 0:
            break
        radius *= 2
    return done.select("target_id", join_unique(F.transform("hits", lambda h: h["text"])).alias("nearby_text"))


# Where a title may sit above its contract.
TITLE_OVERLAP, TITLE_GAP_MIN, TITLE_GAP_MAX, TITLE_LENGTH = 0.3, -0.15, 2.5, 160


def nearest_title(targets: DataFrame, boxes: DataFrame) -> DataFrame:
    """The closest box above each contract, joined on bins of vertical position."""
    width = TITLE_GAP_MAX - TITLE_GAP_MIN
    b = _boxes(boxes).where("trim(text) <> ''").withColumn("_bottom", F.col("b_top_in") + F.col("b_height_in"))
    t = targets.select("block_id", "target_id", "left_in", "top_in", "width_in")
    low = F.floor((F.col("top_in") - TITLE_GAP_MAX) / width)
    probe = t.withColumn("_bin", F.explode(F.array(low, low + 1)))
    gap = F.col("top_in") - F.col("_bottom")
    hits = (
        probe.join(b.withColumn("_bin", F.floor(F.col("_bottom") / width)), ["block_id", "_bin"])
        .where(gap.between(TITLE_GAP_MIN, TITLE_GAP_MAX) & (overlap_ratio("left_in", "width_in", "b_left_in", "b_width_in") >= TITLE_OVERLAP))
    )
    best = hits.groupBy("target_id").agg(F.min_by("text", F.struct(F.abs(gap), "box_ix")).alias("text"))
    return best.select("target_id", F.left(F.trim(F.split_part(F.trim("text"), F.lit(" | "), F.lit(1))), F.lit(TITLE_LENGTH)).alias("title"))


# --- upserts, reconciliation -------------------------------------------------------------


def override_upsert(base: DataFrame, overrides: DataFrame, key: str, replace_flag: str | None = None) -> DataFrame:
    """Base rows replaced by their override, new ones added.  With a flag column an
    override replaces an existing row only where the flag is true.  ``origin`` says
    which side a row came from."""
    values = [c for c in base.columns if c != key]
    flag = F.col(f"o.{replace_flag}") if replace_flag else F.lit(True)
    joined = base.alias("b").withColumn("_b", F.lit(True)).alias("b").join(
        overrides.withColumn("_o", F.lit(True)).alias("o"), key, "full")
    use = F.coalesce(F.col("_o"), F.lit(False)) & (F.col("_b").isNull() | F.coalesce(flag, F.lit(False)))
    return joined.select(
        key, *[F.when(use, F.col(f"o.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in values],
        F.when(use & F.col("_b").isNull(), "added").when(use, "replaced").otherwise("kept").alias("origin"))


def id_reconcile(expected: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """Ids only one side knows: 'unknown' was given but not expected, 'missing' the
    other way round."""
    e, g = expected.select(key).distinct(), given.select(key).distinct()
    return g.join(e, key, "left_anti").withColumn("issue", F.lit("unknown")).unionByName(
        e.join(g, key, "left_anti").withColumn("issue", F.lit("missing")))


def match_index(targets: DataFrame) -> DataFrame:
    """Source row of each contract label, from normalized ``label``, ``choices`` and
    the label's own position ``ix``: equal, then containing, then all longer words
    present, then the same position."""
    words = F.filter(F.split("label", " "), lambda w: F.length(w) > 2)

    def at(test):
        """1-based position of the first choice passing the test; null if none."""
        return F.nullif(F.array_position(F.transform("choices", test), True), F.lit(0))

    equal = at(lambda c: c == F.col("label"))
    inside = at(lambda c: c.contains(F.col("label")) | F.col("label").contains(c))
    spoken = F.when(F.size(words) > 0, at(lambda c: F.forall(words, lambda w: c.contains(w))))
    same = F.when(F.col("ix") < F.size("choices"), F.col("ix") + 1)
    named = F.when(F.col("label") != "", F.coalesce(equal, inside, spoken))
    return targets.withColumn("source_ix", (F.coalesce(named, same) - 1).cast("int")).withColumn(
        "how", F.when(F.col("label") == "", F.lit(None)).when(equal.isNotNull(), "equal").when(inside.isNotNull(), "contained")
        .when(spoken.isNotNull(), "words"))


def incremental_pending(eligible: DataFrame, answered: DataFrame, batch: int, key: str = "target_id", order: str = "target_ix") -> DataFrame:
    """The next batch of work: eligible rows not answered yet, in order."""
    return eligible.join(answered.select(key).distinct(), key, "left_anti").orderBy(order).limit(batch)


def with_defaults(asked: DataFrame, answers: DataFrame, defaults: dict, key: str = "target_id") -> DataFrame:
    """Answers of a batch, and a default row for everything that got none."""
    silent = asked.select(key).join(answers.select(key).distinct(), key, "left_anti")
    for column, value in defaults.items():
        silent = silent.withColumn(column, F.lit(value).cast(answers.schema[column].dataType))
    return answers.join(asked.select(key).distinct(), key, "left_semi").unionByName(silent)
