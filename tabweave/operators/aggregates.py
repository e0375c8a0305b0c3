"""Range functions, counts and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.choices import criteria
from ..functions.numbers import lenient_number

PERCENT_DONE = 100


def range_aggregates(value, blank_as_zero: bool = True) -> list[Column]:
    """Sum, average, min, max, count and counta of a cell column.  By default a
    blank counts as 0 in all of them; otherwise blanks are left out."""
    c = F.col(value) if isinstance(value, str) else value
    text = F.coalesce(c.cast("string"), F.lit(""))
    n = lenient_number(text)
    if not blank_as_zero:
        n = F.when(text != "", n)
    zero = lambda a: F.coalesce(a, F.lit(0.0))
    return [
        zero(F.sum(n)).alias("total"), zero(F.avg(n)).alias("average"), zero(F.min(n)).alias("lowest"), zero(F.max(n)).alias("highest"),
        F.count(n).alias("n"), (F.count(n)).alias("n_filled"),
    ]


def sumif(criteria_value, rule: str, sum_value) -> Column:
    return F.coalesce(F.sum(F.when(criteria(criteria_value, rule), lenient_number(sum_value))), F.lit(0.0))


def countif(criteria_value, rule: str) -> Column:
    return F.count_if(criteria(criteria_value, rule))


def sumproduct(left: DataFrame, right: DataFrame, keys: list[str], position: str, a: str, b: str) -> DataFrame:
    """Sum of products of two ranges joined on position: the shorter one decides."""
    product = lenient_number(F.col(a)) * lenient_number(F.col(b))
    return left.join(right, [*keys, position]).groupBy(*keys).agg(F.sum(product).alias("product"))


def margin_of_error(n, share: float = 0.25, z: float = 1.96) -> Column:
    """Half width in percentage points of the interval around a share."""
    c = F.col(n) if isinstance(n, str) else n
    return z * F.sqrt(F.lit(share) / c) * 100


def nps(promoters, detractors) -> Column:
    p, d = (F.col(c) if isinstance(c, str) else c for c in (promoters, detractors))
    return (p - d) * 100


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """All keys that occur more than once."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def sheets_per_file(tables: DataFrame, top: int = 6) -> DataFrame:
    return tables.groupBy("file_name").agg(F.count("*").alias("n_sheets")).orderBy(F.desc("n_sheets"), "file_name").limit(top)


def analysis_warnings(tables: DataFrame, targets: DataFrame, plans: DataFrame) -> DataFrame:
    """(warning, n): sheets with several blocks, contracts without a plan, and
    whether nothing was matched at all."""
    multi = tables.where("table_blocks > 1").agg(F.count("*").alias("n")).select(F.lit("several blocks in one sheet").alias("warning"), "n")
    open_ = targets.join(plans.select("target_id").distinct().withColumn("_p", F.lit(1)), "target_id", "left").agg(
        F.count_if(F.col("_p").isNull()).alias("unmapped"), F.count_if(F.col("_p").isNotNull()).alias("mapped"))
    rows = open_.select(F.inline(F.array(
        F.struct(F.lit("contracts without source").alias("warning"), F.when(F.col("mapped") > 0, F.col("unmapped")).otherwise(0).alias("n")),
        F.struct(F.lit("nothing matched").alias("warning"), F.when(F.col("mapped") == 0, F.col("unmapped")).otherwise(0).alias("n")))))
    return multi.unionByName(rows).where("n > 0")


def status_rollup(jobs: DataFrame) -> DataFrame:
    """Counts per block and in total (null block) from one pass."""
    mapped = F.col("table_id").isNotNull()
    return jobs.rollup("block_id").agg(
        F.count("*").alias("targets"), F.count_if(mapped).alias("mapped"), F.count_if(~mapped).alias("unmapped"),
        F.count_if("manual").alias("manual"), F.count_if("ai").alias("ai"))


def object_inventory(targets: DataFrame) -> DataFrame:
    is_ = lambda t: F.count_if(F.col("object_type") == t)
    return targets.groupBy("block_id").agg(is_("chart").alias("charts"), is_("table").alias("tables"), F.count("*").alias("objects"))


def usage_cost(calls: DataFrame, rates: list[tuple[str, float, float, float]], keys: list[str]) -> DataFrame:
    """Calls, tokens and cost per key.  ``rates`` lists (model prefix, input, cached,
    output) per million tokens; the first prefix that fits prices a call, and calls
    of an unlisted model have no cost."""
    model = F.lower(F.trim("model"))
    price = F.lit(None).cast("array<double>")
    for prefix, *amounts in reversed(rates):
        price = F.when(model.startswith(prefix), F.array(*[F.lit(float(x)) for x in amounts])).otherwise(price)
    none_negative = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))
    i, c, o = (none_negative(F.col(x)) for x in ("input_tokens", "cached_input_tokens", "output_tokens"))
    cost = (F.greatest(i - c, F.lit(0)) * price[0] + c * price[1] + o * price[2]) / 1_000_000
    total = F.when(none_negative(F.col("total_tokens")) > 0, F.col("total_tokens")).otherwise(i + o)
    # whole units of 1e-8, so sums do not depend on the order of addition
    units = F.round(cost * 100_000_000).cast("bigint")
    priced = calls.withColumn("_i", i).withColumn("_c", c).withColumn("_o", o).withColumn("_t", total).withColumn("_u", units)
    return priced.groupBy(*keys).agg(
        F.count("*").alias("calls"), F.count_if(F.col("status") == "error").alias("errors"), F.sum("_i").alias("input_tokens"), F.sum("_c").alias("cached_input_tokens"),
        F.sum("_o").alias("output_tokens"), F.sum("_t").alias("total_tokens"), (F.sum("_u") / 100_000_000).alias("cost"))


def issue_report(issues: DataFrame) -> DataFrame:
    """One row per package: issues by level, and ok when there is no error."""
    level = lambda v: F.count_if(F.col("level") == v)
    return issues.agg(level("ERROR").alias("errors"), level("REVIEW").alias("reviews"), level("WARNING").alias("warnings")).withColumn("ok", F.col("errors") == 0)


def review_progress(blocks: DataFrame) -> DataFrame:
    """Step states from per-block counts of outputs, skips and questions."""
    sums = blocks.agg(
        F.count_if(F.col("outputs") > 0).alias("with_outputs"), F.count_if("skipped").alias("skipped"), F.sum("questions").alias("questions"), F.sum("unmapped").alias("unmapped"))
    state = F.when((F.col("questions") > 0) | (F.col("unmapped") > 0), "warn").otherwise("active")
    return sums.withColumn("mapping", F.when(F.col("unmapped") > 0, "warn").otherwise("done")).withColumn(
        "assist", F.when((F.col("with_outputs") > 0) | (F.col("skipped") > 0), "done").otherwise("active")).withColumn("review", state)


def input_signature(inputs: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Order-free signature of each key's rows.  Row hashes are added up in two
    128-bit halves, so a key's rows are never gathered in one place."""
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    half = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")
    return inputs.groupBy(*keys).agg(F.sha2(F.concat_ws(
        ":", F.count("*").cast("string"), *[(F.sum(half(at)) % F.lit("1" + "0" * 30).cast("decimal(38,0)")).cast("string") for at in (1, 16, 31, 46)]), 256).alias("signature"))


def stale_outputs(stored: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Outputs whose inputs are not the ones they were made from."""
    return stored.select(key, F.col("signature").alias("_s")).join(current.select(key, F.col("signature").alias("_c")), key, "left").select(
        key, (~F.col("_s").eqNullSafe(F.col("_c"))).alias("stale"))


def template_summary(entries: DataFrame, targets: DataFrame, tables: DataFrame) -> DataFrame:
    """matched, missing_sources and new_targets of a template against a package."""
    t = targets.select("target_id").distinct()
    matched = entries.join(t, "target_id", "left_semi")
    missing = matched.join(tables.select("table_id").distinct(), "table_id", "left_anti")
    new = t.join(entries.select("target_id").distinct(), "target_id", "left_anti")
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return count(matched, "matched").unionByName(count(missing, "missing_sources")).unionByName(count(new, "new_targets"))


def headline_counts(jobs: DataFrame) -> DataFrame:
    ready = F.col("table_id").isNotNull()
    return jobs.agg(
        F.count("*").alias("total"), F.count_if(ready).alias("ready"), F.count_if(~ready).alias("pending"),
        F.count_distinct(F.when(ready, F.col("block_id"))).alias("blocks"), F.count_if(~ready | ((F.col("score") != 0) & (F.col("score") < 0.8))).alias("to_review"))


def percent_done(done, total, complete) -> Column:
    """Percent of the objects plus one closing step; 100 only when complete."""
    share = F.bround(100 * F.greatest(F.col(done), F.lit(0)) / F.greatest(F.greatest(F.col(total), F.lit(0)) + 1, F.lit(1)), 0).cast("int")
    return F.when(complete, PERCENT_DONE).otherwise(F.least(F.greatest(share, F.lit(0)), F.lit(100)))


def progress_percent(log: DataFrame, job: str = "job_id", seq: str = "seq") -> DataFrame:
    """Running count and percent of each job's records, in order."""
    w = W.partitionBy(job).orderBy(seq)
    running = log.withColumn("done", F.count("*").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return running.withColumn("percent", percent_done("done", "total", F.col("phase") == "complete"))


def latest_state(log: DataFrame, job: str = "job_id", seq: str = "seq") -> DataFrame:
    """Newest record of each job: one aggregate that merges before the shuffle."""
    last = log.groupBy(job).agg(F.max_by(F.struct("phase", "completed", "total"), seq).alias("s"), F.max(seq).alias(seq))
    return last.select(job, seq, "s.*").withColumn("percent", percent_done("completed", "total", F.col("phase") == "complete"))
