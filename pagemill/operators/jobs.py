"""Job and batch roll-ups. Batches are aggregated map-side; no window over a batch."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.times import moment
from pagemill.functions import progress as fp
from pagemill.operators.blocked import id_block, row_numbers
from pagemill.schemas import JOB_STATUSES, TERMINAL_STATUSES

#: Rows that one task may sort for a top-k.
SORTED_ROWS = 10_000


def method_summary(pages: DataFrame) -> DataFrame:
    """A1: pages and time per job and extraction method."""
    return pages.groupBy("job_id", "method").agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum("processing_time").alias("total_time"),
        F.avg("processing_time").alias("avg_time"),
    )


def document_summary(pages: DataFrame) -> DataFrame:
    """A1 as one row per job: page count, count per method, total and mean time."""
    method = F.col("method")
    return pages.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("pages"),
        *[F.count_if(method == m).alias(f"{m}_pages") for m in ("embedded", "ocr", "hybrid")],
        F.sum("processing_time").alias("total_time"),
        F.avg("processing_time").alias("avg_time"),
    )


def stage_summary(pages: DataFrame) -> DataFrame:
    """A2: pages, total time and mean page time per job and stage; no pages give null."""
    return pages.groupBy("job_id", "stage").agg(
        F.count("page_num").alias("pages"),
        F.sum("processing_time").alias("total_time"),
        F.try_divide(F.sum("processing_time"), F.count("page_num")).alias("avg_page_time"),
        F.max("model").alias("model"),
    )


def _status_counts() -> list[Column]:
    status = F.col("status")
    return [
        F.count("job_id").alias("total"),
        F.count_if(status == "completed").alias("completed"),
        F.count_if(status == "failed").alias("failed"),
        F.count_if(status == "processing").alias("active"),
        F.count_if(status == "cancelled").alias("cancelled"),
    ]


def _with_final_status(counts: DataFrame, is_cancelled: Column) -> DataFrame:
    """Adds status, is_partial and error_message to status counts."""
    total, done, failed = F.col("total"), F.col("completed"), F.col("failed")
    status = (
        F.when(is_cancelled, "cancelled")
        .when(done == total, "completed")
        .when(done == 0, "failed")
        .otherwise("completed")
    )
    message = F.concat(failed.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" documents failed"))
    return counts.withColumns(
        {
            "status": status,
            "is_partial": ~is_cancelled & (done > 0) & (done < total),
            "error_message": F.when(~is_cancelled & (done == 0) & (total > 0), message),
        }
    )


STATUS_COLUMNS = ["parent_batch_id", "total", "completed", "failed", "status", "is_partial", "error_message"]


def batch_status(jobs: DataFrame, cancelled: DataFrame | None = None) -> DataFrame:
    """A3: final status of each batch of jobs.

    All completed: completed. None completed: failed with a message. Some
    completed: completed, flagged partial. ``cancelled`` (parent_batch_id)
    lists batches whose cancellation was asked for; it overrides the rest.
    """
    counts = jobs.groupBy("parent_batch_id").agg(*_status_counts())
    is_cancelled = F.lit(False)
    if cancelled is not None:
        asked = cancelled.select("parent_batch_id").distinct().withColumn("__cancel", F.lit(True))
        counts = counts.join(asked, "parent_batch_id", "left")
        is_cancelled = F.coalesce("__cancel", F.lit(False))
    return _with_final_status(counts, is_cancelled).select(*STATUS_COLUMNS)


def progress_share(status: Column, pct: Column) -> Column:
    """What one job adds to its batch: a whole when completed, its share while running."""
    return F.when(status == "completed", 1.0).when(status == "processing", pct / 100.0).otherwise(0.0)


def _progress_figures() -> list[Column]:
    share = progress_share(F.col("status"), F.col("progress_pct"))
    return [
        F.count_if(F.col("status") == "completed").alias("documents_completed"),
        F.count("job_id").alias("total_documents"),
        F.coalesce(F.try_divide(F.sum(share) * 100, F.count("job_id")), F.lit(0.0)).alias("overall_progress_pct"),
    ]


def _failure_figures() -> list[Column]:
    status = F.col("status")
    idle = F.count("job_id") - F.count_if(status == "completed") - F.count_if(status == "processing")
    return [
        F.greatest(F.lit(0), idle).alias("failed_files"),
        F.count_if(status == "failed").alias("truly_failed"),
    ]


def _wall_seconds() -> Column:
    wall = fp.elapsed_seconds(F.min("started_at"), F.max("completed_at"))
    return wall.alias("overall_processing_time_seconds")


def batch_progress(jobs: DataFrame) -> DataFrame:
    """A4: percent of each batch, counting the shares of all running jobs."""
    return jobs.groupBy("parent_batch_id").agg(*_progress_figures())


def batch_feed(jobs: DataFrame) -> DataFrame:
    """A4 and A6 in one pass, as shown while a batch runs."""
    return jobs.groupBy("parent_batch_id").agg(*_progress_figures(), *_failure_figures())


def batch_report(jobs: DataFrame) -> DataFrame:
    """A3, A4, A6 and A8 of every batch from one scan and one shuffle of the jobs."""
    figures = jobs.groupBy("parent_batch_id").agg(
        *_status_counts(), *_progress_figures(), *_failure_figures(), _wall_seconds()
    )
    return _with_final_status(figures, F.lit(False)).select(
        *STATUS_COLUMNS, "overall_progress_pct", "overall_processing_time_seconds", "failed_files"
    )


def active_jobs(jobs: DataFrame) -> DataFrame:
    """A5: running jobs per batch; batches without any show 0."""
    return jobs.groupBy("parent_batch_id").agg(
        F.count_if(F.col("status") == "processing").alias("active_files")
    )


def batch_failures(jobs: DataFrame) -> DataFrame:
    """The displayed failure figure (neither completed nor running) next to true failures."""
    return jobs.groupBy("parent_batch_id").agg(*_failure_figures())


def queue_stats(jobs: DataFrame) -> DataFrame:
    """One row with the number of jobs in each of the five statuses."""
    return jobs.agg(*[F.count_if(F.col("status") == s).alias(s) for s in JOB_STATUSES])


def batch_stats(jobs: DataFrame) -> DataFrame:
    """Completion figures of each batch; wall time from first start to last end."""
    return jobs.groupBy("parent_batch_id").agg(
        F.count("job_id").alias("total_documents"),
        F.count_if(F.col("status") == "completed").alias("documents_completed"),
        F.count_if(F.col("status") != "completed").alias("documents_failed"),
        _wall_seconds(),
    )


def batch_documents(batches: DataFrame, jobs: DataFrame) -> DataFrame:
    """The jobs of each batch."""
    docs = jobs.select(
        F.col("parent_batch_id").alias("batch_job_id"),
        "job_id",
        "file_id",
        F.col("status").alias("job_status"),
        "progress_pct",
    )
    return batches.join(docs, "batch_job_id")


def finished_documents(jobs: DataFrame, docs: DataFrame, on: str = "job_id") -> DataFrame:
    """A9 as rows: finished jobs with their content part by part, or their error.

    ``docs`` is (job_id, part, content). Other statuses are left out. Where jobs share contents, hand these in once, as (file_id, part, content) or
    by whatever column of the jobs ``on`` names: each is then shuffled once and not once per job.
    """
    head = ["parent_batch_id", "job_id", "filename", "status"]
    none = F.lit(None).cast("string")
    completed = (
        jobs.where(F.col("status") == "completed")
        .join(docs.select(on, "part", "content"), on)
        .select(*head, "part", "content", none.alias("error"))
    )
    failed = jobs.where(F.col("status") == "failed").select(
        *head, F.lit(0).cast("bigint").alias("part"), none.alias("content"), F.col("error_message").alias("error")
    )
    return completed.unionByName(failed)


def batch_results(jobs: DataFrame, list_size: int = 256) -> DataFrame:
    """Finished jobs of each batch as ordered lists of structs.

    A list holds at most ``list_size`` jobs; a larger batch has several lists,
    numbered from 0. Contents stay in the document table under the job id.
    """
    ended = jobs.where(F.col("status").isin("completed", "failed")).select(
        "parent_batch_id", "job_id", "filename", "status", "error_message"
    )
    numbered = row_numbers(
        ended, ["parent_batch_id"], id_block(ended, "job_id", ["parent_batch_id"]), ["job_id"], "__n"
    )
    entry = F.struct(
        "job_id",
        "filename",
        "status",
        F.when(F.col("status") == "failed", F.col("error_message")).alias("error"),
    )
    return numbered.groupBy("parent_batch_id", F.floor((F.col("__n") - 1) / list_size).alias("list_no")).agg(
        F.array_sort(F.collect_list(entry)).alias("results")
    )


def group_by_filename(results: DataFrame) -> DataFrame:
    """Number of results per batch and file name; nameless ones count as unknown."""
    return results.groupBy(
        "parent_batch_id", F.coalesce("filename", F.lit("unknown")).alias("filename")
    ).agg(
        F.count(F.lit(1)).alias("results"),
        F.count_if(F.col("status") == "completed").alias("completed"),
    )


def job_result(jobs: DataFrame, docs: DataFrame, page_keys: DataFrame | None = None) -> DataFrame:
    """A10: result envelope of each completed job, one row per document part.

    ``docs`` is (job_id, part, content, pages). Pages are counted from
    ``page_keys`` (job_id, page_num), which may repeat, where given: counting
    them from ``docs`` assembles a document that is not stored a second time.
    """
    if page_keys is None:
        totals = docs.groupBy("job_id").agg(F.sum("pages").alias("total_pages"))
    else:
        totals = page_keys.select("job_id", "page_num").distinct().groupBy("job_id").agg(F.count(F.lit(1)).alias("total_pages"))
    return (
        jobs.where(F.col("status") == "completed")
        .join(totals, "job_id")
        .join(docs.select("job_id", "part", "content"), "job_id")
        .select(
            "job_id",
            "part",
            F.col("output_format").alias("format"),
            "content",
            "total_pages",
            fp.elapsed_seconds(F.col("started_at"), F.col("completed_at")).alias("processing_time_seconds"),
            F.col("model").alias("model_used"),
            F.coalesce("dpi", F.lit(300)).alias("dpi"),
            F.coalesce("method", F.lit("auto")).alias("method"),
            F.concat(F.lit("/api/v1/process/jobs/"), F.col("job_id"), F.lit("/original")).alias("original_file_url"),
        )
    )


def with_eta(jobs: DataFrame, now: datetime) -> DataFrame:
    """Adds ``estimated_remaining_seconds``."""
    return jobs.withColumn(
        "estimated_remaining_seconds",
        fp.eta_seconds(F.col("status"), F.col("progress_pct"), F.col("started_at"), moment(now)),
    )


def newest_rows(df: DataFrame, ts: str, row_id: str, keep: int, exact: int = SORTED_ROWS, ranges: int = 4096) -> DataFrame:
    """The ``keep`` newest rows by (``ts``, ``row_id``), rows without a time last. ``row_id`` is unique and not null.

    The time of the last row is narrowed down by counts over ``ranges`` equal spans, each combined before the shuffle, until at most ``exact`` rows
    are in doubt. Newer rows need a filter only; those in doubt are sorted. More rows than that at one instant, or without a
    time, are numbered by id in blocks. No task sorts or holds more than ``exact`` rows.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    if keep <= 0:
        return df.where("false")
    if keep <= exact:
        return df.orderBy(F.desc(ts), F.desc(row_id)).limit(keep)
    lo, hi, rows, timed = df.agg(F.min(at), F.max(at), F.count(F.lit(1)), F.count(at)).first()
    if keep >= rows:
        return df
    if keep > timed:
        newer, doubt, count, rest = at.isNotNull(), at.isNull(), rows - timed, keep - timed
    else:
        count, rest = timed, keep
        while count > exact and lo < hi:
            width = (hi - lo) // ranges + 1
            spans = df.where(at.between(lo, hi)).groupBy(F.floor((at - lo) / width).alias("span")).count().collect()
            for span, count in sorted(spans, reverse=True):
                if rest <= count:
                    break
                rest -= count
            lo, hi = lo + span * width, min(hi, lo + (span + 1) * width - 1)
        newer, doubt = at > hi, at.between(lo, hi)
    doubtful = df.where(doubt)
    if count <= exact:
        last = doubtful.orderBy(F.desc(ts), F.desc(row_id)).limit(rest)
    else:
        numbered = row_numbers(doubtful, [], id_block(doubtful, row_id), [row_id], "__n")
        last = numbered.where(F.col("__n") > count - rest).drop("__n")
    return df.where(newer).unionByName(last)


def evict_old_batches(batches: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """(remaining, evicted) when only terminal batches beyond the newest ``keep`` go.

    The rank counts all batches. The newest are found by a top-k, or beyond
    ``SORTED_ROWS`` by narrowing counts (``newest_rows``), and an anti join does
    the rest; no global window, however many are kept.
    """
    newest = newest_rows(batches.select("batch_job_id", "created_at"), "created_at", "batch_job_id", keep)
    newest = newest.select("batch_job_id")
    evicted = batches.where(F.col("status").isin(*TERMINAL_STATUSES)).join(newest, "batch_job_id", "left_anti")
    return batches.join(evicted.select("batch_job_id"), "batch_job_id", "left_anti"), evicted


# The model of each named strategy.
STRATEGIES = {
    "quality": "qwen3-vl-8b",
    "intermediate": "qwen3-vl-4b",
    "speed": "qwen3-vl-2b",
    "balanced": "deepseek-ocr",
    "ocr_specialized": "deepseek-ocr",
}


def choose_model(jobs: DataFrame, prefer_quality: Column | bool = True, strategy: Column | None = None) -> DataFrame:
    """M9: adds the merge-stage model, that of the named strategy where there is one."""
    flag = F.lit(prefer_quality) if isinstance(prefer_quality, bool) else prefer_quality
    chosen = F.when(flag, STRATEGIES["quality"]).otherwise(STRATEGIES["intermediate"])
    if strategy is not None:
        named = F.create_map(*[F.lit(x) for pair in STRATEGIES.items() for x in pair])
        chosen = F.coalesce(F.try_element_at(named, strategy), chosen)
    return jobs.withColumn("merge_model", chosen)
