"""The logs as streams, run to completion over files and compared with batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import base_name
from ..operators import learning
from ..operators.learning import ENTRIES
from ..sources.keyed import KeyedTable
from ..sources.logs import stream_events
from ..streaming import logs as streaming
from .registry import query
from .joining import ALIASES, EXISTING, LEARNED_SQL, ORDERED_SQL, RUN, remembered_sources, with_renamed
from .reporting import PRICED_SQL, RATES, USAGE_SQL
from .scalars import scratch


def _as_stream(r, df, name: str, split: str, order: str | None = None):
    """The rows of ``df`` written as several JSON files and read as a stream.
    ``order`` keeps arrival close to event time, as a log does."""
    path = scratch(r, name)
    files = df.repartitionByRange(4, order) if order else df.repartition(4, split)
    files.write.json(path)
    return stream_events(r.spark, path, df.schema)


@query("stream_usage_hourly", f"""
    SELECT date_trunc('hour', returned_at) AS hour, operation, {USAGE_SQL} FROM ({PRICED_SQL}) p WHERE returned_at < TIMESTAMP '2025-01-01' GROUP BY 1, operation""")
def stream_usage_hourly(r):
    calls = r.role("usage").withColumn("returned_at", F.col("returned_at").cast("timestamp"))
    # a closing record far ahead moves the watermark past the last real hour
    closing = calls.limit(1).withColumn("returned_at", F.lit("2030-01-01").cast("timestamp"))
    stream = _as_stream(r, calls.unionByName(closing), "usage-log", "call_id")
    out = scratch(r, "usage-hourly")
    streaming.run_available(streaming.usage_hourly(stream, RATES), out, scratch(r, "usage-ckpt"))
    return r.spark.read.parquet(out).where("hour < '2025-01-01'").withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("stream_job_state", """
    SELECT job_id, seq, phase, completed, total, CAST(CASE WHEN phase = 'complete' THEN 100 ELSE round_even(100.0 * completed / (total + 1), 0) END AS INT) AS percent
    FROM progress QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) = 1""")
def stream_job_state(r):
    stream = _as_stream(r, r.role("progress"), "progress-log", "seq")
    out = scratch(r, "job-state")

    def keep(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(out)

    state = streaming.job_state(stream)
    (state.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", scratch(r, "job-ckpt"))
     .trigger(availableNow=True).start().awaitTermination())
    # an updated row replaces the one of an earlier batch
    newest = r.spark.read.parquet(out).groupBy("job_id").agg(F.max_by(F.struct(*state.columns), F.struct("seq", "batch")).alias("s"))
    return newest.select("s.*")


@query("stream_audit", """SELECT DISTINCT event_id, tenant, actor, action, actor <> '' AS identified FROM audit""")
def stream_audit(r):
    entries = r.role("audit").withColumn("at", F.col("at").cast("timestamp"))
    stream = _as_stream(r, entries, "audit-log", "event_id")
    out = scratch(r, "audit")
    streaming.run_available(streaming.audit_stream(stream, "60 days"), out, scratch(r, "audit-ckpt"), ["tenant"])
    return r.spark.read.parquet(out).select("event_id", "tenant", "actor", "action", "identified")


STORED = """SELECT entry_id, table_id, fingerprint, confidence, cell_range, range_mode, updated_at, CAST(entry_ix AS BIGINT) AS entry_ix,
    CAST(NULL AS ARRAY<STRING>) AS aliases, CAST(NULL AS STRING) AS basename, CAST(NULL AS STRING) AS signature, CAST(NULL AS ARRAY<STRING>) AS cats, CAST(NULL AS ARRAY<STRING>) AS sers FROM ({})"""


@query("stream_learn", f"""
    WITH old AS ({EXISTING}), run AS ({RUN})
    SELECT entry_id, table_id, confidence FROM old WHERE entry_id NOT IN (SELECT target_id FROM run) UNION ALL SELECT target_id, table_id, round(confidence, 4) FROM run""")
def stream_learn(r):
    store = KeyedTable(scratch(r, "learned"), "entry_id", ENTRIES)
    store.upsert(r.sql(STORED.format(EXISTING)), -1)
    stream = _as_stream(r, r.sql(RUN), "plans-log", "target_id")
    streaming.learn_stream(stream, store, scratch(r, "learn-ckpt")).awaitTermination()
    return store.read(r.spark).select("entry_id", "table_id", "confidence")


LOOP_RUN = "SELECT k, target_id FROM job WHERE score >= 0.4"


@query("learning_loop", f"""
    WITH RECURSIVE {LEARNED_SQL.replace('FROM learned l JOIN st s ON s.k = l.entry_ix', "FROM (SELECT k AS entry_ix, target_id, '' AS basename FROM job WHERE score >= 0.4) l JOIN st s ON s.k = l.entry_ix")
        .replace('e.basename)', "regexp_extract((SELECT table_id FROM st WHERE st.k = e.entry_ix), '[^/]*$'))")},
    tg AS (SELECT k AS entry_ix, target_id FROM job WHERE score >= 0.4), {ORDERED_SQL.format(edges='cand JOIN tg USING (entry_ix)')}
    SELECT target_id, table_id, CAST(step AS INT) AS step FROM g WHERE ok""")
def learning_loop(r):
    """A run is learned into a table of entries, sources are renamed, and the entries are read back to find them."""
    src, prints = remembered_sources(r)
    run = r.sql(LOOP_RUN).join(src.drop("table_ix"), "k").join(prints.select("k", "fingerprint"), "k").select(
        "target_id", "table_id", "fingerprint", F.lit(0.5).alias("confidence"), F.col("k").cast("long").alias("plan_ix"), F.array("target_id").alias("aliases"),
        base_name("table_id").alias("basename"), "signature", "cats", "sers")
    store = KeyedTable(scratch(r, "loop"), "entry_id", ENTRIES)
    store.upsert(learning.learned_rows(store.read(r.spark), run, "2024"), 0)
    renamed = with_renamed(src)
    out = learning.resolve_learned(learning.as_entries(store.read(r.spark)), r.sql(ALIASES), prints.select("target_id", "fingerprint"), renamed)
    return out.select("target_id", "table_id", "step")
