"""Registered queries that run a stream over a whole table and return what it stored."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators.mutations import latest_rows
from pagemill.plans.queries_scoring import SNAPSHOT_SQL
from pagemill.plans.registry import query
from pagemill.session import scratch_dir
from pagemill.sources import standins as s
from pagemill.streaming import chunks as tc
from pagemill.streaming import completions as tcomp
from pagemill.streaming import feeds as tf
from pagemill.streaming import snapshots as ts
from pagemill.streaming import stream_rows as tr
from pagemill.streaming import tables as tt
from pagemill.streaming import upserts as tu


def _paths(spark, name):
    base = scratch_dir(spark, name)
    return f"{base}/table", f"{base}/checkpoint"


@query("""
SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def followed_jobs(spark, sf_dir):
    """Newest row per key of a change feed."""
    path, checkpoint = _paths(spark, "follow")
    keys, version = ["o_custkey"], ["o_orderdate", "o_orderkey"]
    stream = s.stream_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    tf.follow_rows(stream, keys, version, path, checkpoint).awaitTermination()
    return tf.followed_rows(spark, keys, version, path)


@query("SELECT job_id, page_num, method, processing_time, completed_at, ocr_text, merge_text, is_done FROM v_pages "
       "WHERE job_id IN (SELECT job_id FROM v_jobs)")
def page_upsert_stream(spark, sf_dir):
    """S8 as a stream: page writes in four micro-batches, upserted into a bucketed table."""
    path, checkpoint = _paths(spark, "upserts")
    keys = ["job_id", "page_num"]
    changes = s.split_rows(s.page_changes(spark, sf_dir), ["version"], 4)
    known = s.jobs(spark, sf_dir).select("job_id")
    tu.write_upserts(changes, path, checkpoint, keys, F.col("version"), s.PAGE_COLUMNS, known, buckets=16).awaitTermination()
    return tu.upserted_rows(spark, path, keys)


_CHUNKS = """
SELECT conv_id AS job_id, 1 AS page_num, 0::BIGINT AS part, string_agg(text, '' ORDER BY turn) AS text, count(*) AS chunks,
  count(*) AS tokens FROM conversations GROUP BY 1"""


@query(_CHUNKS)
def reassembled_text(spark, sf_dir):
    """T2 batch form."""
    return tc.reassemble(s.chunks(spark, sf_dir))


@query(_CHUNKS)
def reassembled_stream(spark, sf_dir):
    """T2 as a stream."""
    path, checkpoint = _paths(spark, "chunks")
    text = tc.reassemble_chunks(s.chunks(spark, sf_dir, s.stream_table))
    tt.write_updates(text, path, checkpoint, mode="update").awaitTermination()
    return tt.current_rows(spark, path, tc.KEYS)


@query(SNAPSHOT_SQL)
def text_snapshot_stream(spark, sf_dir):
    """T3 as a stream."""
    path, checkpoint = _paths(spark, "snapshots")
    snapshots = ts.throttle_snapshot_stream(s.line_chunks(spark, sf_dir, s.stream_table), ms=100, tokens=4)
    tt.write_updates(snapshots, path, checkpoint).awaitTermination()
    return tt.stored_rows(spark, path)


_STREAM_ROWS = """
WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY job_id, page_num ORDER BY order_no) AS n FROM v_commands),
f AS (SELECT job_id, page_num, n, kind IN ('snapshot', 'stage') AS live, stage, CASE kind WHEN 'snapshot' THEN snapshot_text ELSE '' END AS snapshot_text,
    CASE kind WHEN 'snapshot' THEN 1 ELSE 0 END AS seq, coalesce(kind = 'snapshot' AND is_final, false) AS is_final, NULL::VARCHAR AS error, updated_at
  FROM c WHERE n = 1
  UNION ALL
  SELECT c.job_id, c.page_num, c.n, f.live OR c.kind IN ('snapshot', 'stage'),
    CASE c.kind WHEN 'complete' THEN 'complete' WHEN 'failed' THEN 'failed' ELSE c.stage END,
    CASE WHEN c.kind = 'snapshot' THEN c.snapshot_text WHEN NOT f.live THEN '' WHEN c.kind = 'complete' THEN c.snapshot_text ELSE f.snapshot_text END,
    CASE WHEN f.live THEN f.seq + 1 WHEN c.kind = 'snapshot' THEN 1 ELSE 0 END,
    CASE WHEN c.kind = 'snapshot' THEN c.is_final WHEN NOT f.live THEN false WHEN c.kind IN ('complete', 'failed') THEN true ELSE f.is_final END,
    CASE WHEN c.kind = 'snapshot' THEN NULL WHEN NOT f.live THEN NULL WHEN c.kind = 'failed' THEN c.error ELSE f.error END, c.updated_at
  FROM f JOIN c ON c.job_id = f.job_id AND c.page_num = f.page_num AND c.n = f.n + 1)
SELECT job_id, page_num, stage, snapshot_text, CAST(seq AS BIGINT) AS seq, is_final, error, updated_at FROM f
WHERE live QUALIFY n = max(n) OVER (PARTITION BY job_id, page_num)"""


@query(_STREAM_ROWS)
def stream_rows(spark, sf_dir):
    """U9."""
    return tr.apply_stream_commands(None, s.stream_commands(spark, sf_dir))


@query(_STREAM_ROWS)
def stream_rows_resumed(spark, sf_dir):
    """U9 in two steps: commands applied to rows stored before."""
    commands = s.stream_commands(spark, sf_dir)
    early = F.col("updated_at") < F.lit("2024-01-15").cast("timestamp_ntz")
    stored = tr.apply_stream_commands(None, commands.where(early))
    return tr.apply_stream_commands(stored, commands.where(~early))


@query(_STREAM_ROWS)
def stream_rows_live(spark, sf_dir):
    """T4: a row of state per page, folded per micro-batch; the sink keeps the greatest seq."""
    path, checkpoint = _paths(spark, "rows")
    tr.write_stream_rows(s.stream_commands(spark, sf_dir, s.stream_table), path, checkpoint).awaitTermination()
    return tt.current_rows(spark, path, tr.KEYS, ["seq"])


@query(_STREAM_ROWS)
def stream_rows_recovered(spark, sf_dir):
    """T4 after a lost checkpoint: a new stream goes on from the rows that the first one stored, into the same table."""
    base = scratch_dir(spark, "recovered")
    path = f"{base}/table"
    commands = s.stream_commands(spark, sf_dir)
    early = F.col("updated_at") < F.lit("2024-01-15").cast("timestamp_ntz")
    first = s.micro_batches([commands.where(early)], tr.KEYS)
    tr.write_stream_rows(first, path, f"{base}/first").awaitTermination()
    stored = stored_snapshot(tt.current_rows(spark, path, tr.KEYS, ["seq"]), f"{base}/initial")
    rest = s.micro_batches(_by_time(commands.where(~early), ["2024-01-20", "2024-01-25"]), tr.KEYS)
    tr.write_stream_rows(rest, path, f"{base}/second", initial=stored).awaitTermination()
    return tt.current_rows(spark, path, tr.KEYS, ["seq"])


def stored_snapshot(df, path):
    """The rows as of now: a table that is still written to can't be read along with the stream that writes it."""
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _by_time(commands, days):
    """Commands in order of time, cut at the given days."""
    cuts = [F.lit(d).cast("timestamp_ntz") for d in days]
    at = F.col("updated_at")
    ranges = [at < cuts[0], *[(at >= a) & (at < b) for a, b in zip(cuts, cuts[1:])], at >= cuts[-1]]
    return [commands.where(r) for r in ranges]


_FINISHED = "SELECT c_custkey FROM customer WHERE c_acctbal > 5000"


@query(f"SELECT job_id, count(*) AS removed FROM ({_STREAM_ROWS}) WHERE job_id IN ({_FINISHED}) GROUP BY 1")
def cleared_streams(spark, sf_dir):
    """T5: rows removed per finished job."""
    rows = tr.apply_stream_commands(None, s.stream_commands(spark, sf_dir))
    finished = s.table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("job_id"))
    _, removed = tr.clear_streams(rows, finished)
    return removed


@query(f"SELECT job_id, CAST(count(*) AS BIGINT) AS removed FROM ({_STREAM_ROWS}) WHERE job_id IN ({_FINISHED}) GROUP BY 1")
def cleared_streams_live(spark, sf_dir):
    """T5 as a stream: commands in three micro-batches, then the ends of jobs in the same stream."""
    path, checkpoint = _paths(spark, "cleared")
    commands = s.stream_commands(spark, sf_dir)
    ends = s.table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(
        F.col("c_custkey").alias("job_id"), F.lit("finish").alias("kind"), F.lit(1 << 62).alias("order_no")
    )
    others = [F.lit(None).cast(t).alias(c) for c, t in commands.dtypes if c not in ends.columns]
    ends = ends.select("*", *others).select([F.col(c).cast(t).alias(c) for c, t in commands.dtypes])
    stream = s.micro_batches([*_by_time(commands, ["2024-01-10", "2024-01-20"]), ends], tr.KEYS)
    tr.write_cleared(stream, path, checkpoint).awaitTermination()
    removed = tt.stored_rows(spark, path).groupBy("job_id").agg(F.sum("removed").alias("removed"))
    return removed.where("removed > 0")


@query("""
SELECT job_id, event_id, timestamp, cpu_percent FROM v_log
QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY timestamp DESC, event_id DESC) = 1""")
def live_metrics(spark, sf_dir):
    """T6."""
    path, checkpoint = _paths(spark, "live")
    log = s.log(spark, sf_dir, s.stream_table).select("job_id", "event_id", "timestamp", "cpu_percent")
    tf.live_latest(log, path, checkpoint, every_s=None).awaitTermination()
    return tt.current_rows(spark, path, ["job_id"], ["timestamp", "event_id"])


def _page_events(spark, sf_dir, read):
    done = F.col("is_done")
    return (
        s.page_changes(spark, sf_dir, read)
        .where(done)
        .select("job_id", F.lit("merge").alias("stage"), "page_num", F.col("completed_at").alias("timestamp"))
    )


def _streamed_counts(spark, sf_dir):
    path, checkpoint = _paths(spark, "pages")
    tf.page_increments(_page_events(spark, sf_dir, s.stream_table), path, checkpoint).awaitTermination()
    return tf.stage_counts(spark, path)


def _job_totals(spark, sf_dir):
    totals = (
        s.page_changes(spark, sf_dir).groupBy("job_id").agg(F.count_distinct("page_num").alias("total_pages"))
    )
    return s.jobs(spark, sf_dir).select("job_id", "parent_batch_id").join(totals, "job_id")


_JOB_PROGRESS = """
(SELECT job_id, parent_batch_id, CASE WHEN done >= total THEN 'completed' WHEN done > 0 THEN 'processing' ELSE 'queued' END AS status,
  done * 100.0::DOUBLE / total AS progress_pct, done, total FROM (
  SELECT j.job_id, j.parent_batch_id, count(DISTINCT page_num) AS total, count(DISTINCT page_num) FILTER (is_done) AS done
  FROM v_jobs j JOIN v_changes USING (job_id) GROUP BY 1, 2))"""


@query(f"""
SELECT job_id, parent_batch_id, status, round(progress_pct, 6) AS progress_pct, done AS pages_completed, total AS total_pages FROM {_JOB_PROGRESS}""")
def job_progress_feed(spark, sf_dir):
    """T7, job level."""
    job, _ = tf.progress_feed(_streamed_counts(spark, sf_dir), _job_totals(spark, sf_dir))
    return job.withColumn("progress_pct", F.round("progress_pct", 6))


@query(f"""
SELECT parent_batch_id, count(*) FILTER (status = 'completed') AS documents_completed, count(*) AS total_documents,
  round(sum(CASE status WHEN 'completed' THEN 1 WHEN 'processing' THEN progress_pct / 100 ELSE 0 END) * 100 / count(*), 6) AS overall_progress_pct,
  greatest(0, count(*) - count(*) FILTER (status IN ('completed', 'processing'))) AS failed_files, 0::BIGINT AS truly_failed
FROM {_JOB_PROGRESS} GROUP BY 1""")
def batch_progress_feed(spark, sf_dir):
    """T7, batch level."""
    _, batch = tf.progress_feed(_streamed_counts(spark, sf_dir), _job_totals(spark, sf_dir))
    return batch.withColumn("overall_progress_pct", F.round("overall_progress_pct", 6))


@query(f"""
SELECT job_id, 'merge' AS stage, ts AS timestamp, unnest(['stage_complete', 'job_complete']) AS event FROM {_JOB_PROGRESS} JOIN (
  SELECT job_id, max(completed_at) AS ts FROM (SELECT job_id, page_num, max(completed_at) AS completed_at FROM v_changes
    WHERE is_done GROUP BY 1, 2) GROUP BY 1) USING (job_id) WHERE done >= total""")
def completion_events(spark, sf_dir):
    """T8, job level. A page counts with its newest completion here, as one batch holds them all."""
    path, checkpoint = _paths(spark, "complete")
    events = latest_rows(_page_events(spark, sf_dir, s.table), ["job_id", "stage", "page_num"], ["timestamp"])
    staged = scratch_dir(spark, "complete-source")
    events.write.parquet(staged)
    stream = spark.readStream.schema(events.schema).parquet(staged)
    tf.page_increments(stream, path, checkpoint).awaitTermination()
    return tf.completion_events(tf.stage_counts(spark, path), _job_totals(spark, sf_dir))


@query(f"""
SELECT job_id, 'merge' AS stage, ts AS timestamp, unnest(['stage_complete', 'job_complete']) AS event FROM {_JOB_PROGRESS} JOIN (
  SELECT job_id, max(completed_at) AS ts FROM (SELECT job_id, page_num, max(completed_at) AS completed_at FROM v_changes
    WHERE is_done GROUP BY 1, 2) GROUP BY 1) USING (job_id) WHERE done >= total""")
def completion_stream(spark, sf_dir):
    """T8 as a stream, job level: pages and totals in several micro-batches, each completion given out once."""
    path, checkpoint = _paths(spark, "completions")
    events = latest_rows(_page_events(spark, sf_dir, s.table), ["job_id", "stage", "page_num"], ["timestamp"])
    pages = s.split_rows(events, ["job_id", "page_num"], 3)
    totals = s.split_rows(_job_totals(spark, sf_dir).select("job_id", "total_pages"), ["job_id"], 2)
    tcomp.write_completions(pages, totals, path, checkpoint).awaitTermination()
    return tt.stored_rows(spark, path)


@query("""
SELECT job_id, page_num, stage, model, event, CASE event WHEN 'inference_start' THEN timestamp - to_microseconds(CAST(s * 1000000 AS BIGINT)) ELSE timestamp END AS timestamp,
  CASE WHEN event LIKE '%page_complete' THEN text END AS text, CASE WHEN event <> 'inference_start' THEN s END AS duration_seconds
FROM (SELECT job_id, page_number AS page_num, stage, 'm' AS model, timestamp, page_duration_s AS s, 'page ' || event_id AS text,
  unnest(['inference_start', 'inference_complete', stage || '_page_complete']) AS event FROM v_log WHERE stage IS NOT NULL)""")
def page_result_events(spark, sf_dir):
    """T8, page level, as a stream."""
    path, checkpoint = _paths(spark, "results")
    pages = s.log(spark, sf_dir, s.stream_table).where("stage IS NOT NULL").select(
        "job_id",
        F.col("page_number").alias("page_num"),
        "stage",
        F.lit("m").alias("model"),
        "timestamp",
        F.col("page_duration_s").alias("processing_time"),
        F.concat(F.lit("page "), "event_id").alias("text"),
    )
    tt.write_updates(tf.page_result_events(pages), path, checkpoint).awaitTermination()
    return tt.stored_rows(spark, path)


@query("""
SELECT job_id, 1 AS page_num, 'merge_chunk' AS event, chunk_text AS chunk, is_final, created_at AS timestamp FROM v_line_chunks""")
def chunk_events(spark, sf_dir):
    """T8, chunk level, as a stream."""
    path, checkpoint = _paths(spark, "chunk-events")
    events = tf.merge_chunk_events(s.line_chunks(spark, sf_dir, s.stream_table))
    tt.write_updates(events, path, checkpoint).awaitTermination()
    return tt.stored_rows(spark, path)
