"""Change feeds, live metrics, progress and result events.

All state here is kept by built-in streaming operators on the JVM side, which
combine map-side, so hot jobs do not overload a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagemill.operators.jobs import batch_feed
from pagemill.operators.mutations import latest_rows
from pagemill.streaming.tables import current_rows, read_updates, write_updates


def follow_rows(
    stream: DataFrame, keys: Sequence[str], version: Sequence[str], path: str, checkpoint: str, every_s: float | None = None
) -> StreamingQuery:
    """Keeps the newest row per key of a changing table. Filter the stream to follow one job.

    Every micro-batch is reduced to one row per key before it is stored.
    """
    return write_updates(
        stream, path, checkpoint, every_s=every_s, reduce=lambda batch: latest_rows(batch, keys, version)
    )


def followed_rows(spark: SparkSession, keys: Sequence[str], version: Sequence[str], path: str) -> DataFrame:
    """The table as of now."""
    return current_rows(spark, path, keys, version)


def live_latest(
    log_stream: DataFrame, path: str, checkpoint: str, every_s: float | None = 2
) -> StreamingQuery:
    """Newest log row per job, refreshed every ``every_s`` seconds (1 to 30)."""
    if every_s is not None and not 1 <= every_s <= 30:
        raise ValueError("the refresh interval must be between 1 and 30 seconds")
    rest = [c for c in log_stream.columns if c != "job_id"]
    newest = F.max_by(F.struct(*rest), F.struct("timestamp", "event_id")).alias("__row")
    latest = log_stream.groupBy("job_id").agg(newest).select("job_id", "__row.*")
    return write_updates(latest, path, checkpoint, mode="update", every_s=every_s)


def page_increments(
    page_events: DataFrame, path: str, checkpoint: str, every_s: float | None = None, watermark: str | None = None
) -> StreamingQuery:
    """T7/T8 state: counts each completed (job, stage, page) once and stores increments per job and stage.

    ``page_events`` is a stream of (job_id, stage, page_num, timestamp).
    Repeated completions are dropped by the state store; with ``watermark`` (such
    as "1 day") only repeats within that time are, which bounds the state.
    """
    keys = ["job_id", "stage", "page_num"]
    if watermark:
        first = page_events.withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark(keys)
    else:
        first = page_events.dropDuplicates(keys)

    def counts(batch: DataFrame) -> DataFrame:
        return batch.groupBy("job_id", "stage").agg(
            F.count(F.lit(1)).alias("pages"), F.max("timestamp").alias("timestamp")
        )

    return write_updates(first, path, checkpoint, every_s=every_s, reduce=counts)


def stage_counts(spark: SparkSession, path: str) -> DataFrame:
    """Pages done so far per job and stage, summed over the increments."""
    return (
        read_updates(spark, path)
        .groupBy("job_id", "stage")
        .agg(F.sum("pages").alias("pages_completed"), F.max("timestamp").alias("timestamp"))
    )


def progress_feed(counts: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Job and batch progress events from page counts.

    ``counts`` is (job_id, pages_completed) over all stages still counted;
    ``jobs`` is (job_id, parent_batch_id, total_pages). A job is completed when
    all its pages are, running once it has one, else queued.
    """
    done = F.coalesce("pages_completed", F.lit(0))
    total = F.col("total_pages")
    status = F.when((total > 0) & (done >= total), "completed").when(done > 0, "processing").otherwise("queued")
    pct = F.coalesce(F.try_divide(done * 100.0, total), F.lit(0.0))
    job = jobs.join(counts.select("job_id", "pages_completed"), "job_id", "left").select(
        "job_id",
        "parent_batch_id",
        status.alias("status"),
        pct.alias("progress_pct"),
        done.alias("pages_completed"),
        "total_pages",
    )
    return job, batch_feed(job)


def page_result_events(pages: DataFrame) -> DataFrame:
    """T8, page level: inference_start, inference_complete and the page's completion event.

    Works on a static or streaming frame of (job_id, page_num, stage, text,
    model, processing_time, timestamp); one row in, three rows out, no shuffle.
    """
    seconds = F.make_dt_interval(secs=F.coalesce("processing_time", F.lit(0.0)).cast("decimal(18,6)"))
    none = F.lit(None)

    def event(name: Column, at: Column, text: Column, duration: Column) -> Column:
        return F.struct(
            name.alias("event"),
            at.cast("timestamp_ntz").alias("timestamp"),
            text.cast("string").alias("text"),
            duration.cast("double").alias("duration_seconds"),
        )

    at = F.col("timestamp")
    finished = F.concat(F.col("stage"), F.lit("_page_complete"))
    events = F.array(
        event(F.lit("inference_start"), at - seconds, none, none),
        event(F.lit("inference_complete"), at, none, F.col("processing_time")),
        event(finished, at, F.col("text"), F.col("processing_time")),
    )
    return pages.select("job_id", "page_num", "stage", "model", F.explode(events).alias("e")).select(
        "job_id", "page_num", "stage", "model", "e.*"
    )


def merge_chunk_events(chunks: DataFrame) -> DataFrame:
    """One merge_chunk event per text chunk of a static or streaming frame."""
    return chunks.select(
        "job_id",
        "page_num",
        F.lit("merge_chunk").alias("event"),
        F.col("chunk_text").alias("chunk"),
        "is_final",
        F.col("created_at").alias("timestamp"),
    )


def completion_events(counts: DataFrame, totals: DataFrame, last_stage: str = "merge") -> DataFrame:
    """T8, job level: stage_complete once all pages of a stage are in, job_complete after the last stage.

    ``counts`` is (job_id, stage, pages_completed, timestamp); ``totals`` is
    (job_id, total_pages).
    """
    full = counts.join(totals.select("job_id", "total_pages"), "job_id").where(
        F.col("pages_completed") >= F.col("total_pages")
    )
    names = F.when(
        F.col("stage") == last_stage, F.array(F.lit("stage_complete"), F.lit("job_complete"))
    ).otherwise(F.array(F.lit("stage_complete")))
    return full.select("job_id", "stage", "timestamp", F.explode(names).alias("event"))
