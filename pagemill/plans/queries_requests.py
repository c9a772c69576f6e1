"""Registered queries for whole requests."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from pagemill.operators import jobs as oj
from pagemill.operators import prompts as op
from pagemill.plans import requests as rq
from pagemill.plans.registry import query
from pagemill.sources import standins as s

NOW = datetime(2024, 1, 1, 12, 0, 0)

_REQUESTS = """
(SELECT job_id, file_id, CASE WHEN output_format = 'text' THEN 'ocr' ELSE 'merge' END AS prompt_type,
  CASE model WHEN 'qwen3-vl-8b' THEN 'Read {image} now' END AS custom_prompt, model <> 'qwen3-vl-4b' AS prefer_quality,
  dpi * 2 AS dpi, method, 1 AS start_page, CAST(user_id % 9 AS INTEGER) AS end_page FROM v_jobs)"""


def _requests(spark, sf_dir):
    return s.jobs(spark, sf_dir).select(
        "job_id",
        "file_id",
        F.when(F.col("output_format") == "text", "ocr").otherwise("merge").alias("prompt_type"),
        F.when(F.col("model") == "qwen3-vl-8b", "Read {image} now").alias("custom_prompt"),
        (F.col("model") != "qwen3-vl-4b").alias("prefer_quality"),
        (F.col("dpi") * 2).alias("dpi"),
        "method",
        F.lit(1).alias("start_page"),
        (F.col("user_id") % 9).cast("int").alias("end_page"),
    )


def _submitted(spark, sf_dir):
    return rq.submit_jobs(_requests(spark, sf_dir), s.files(spark, sf_dir), op.model_catalog(spark), NOW)


_FILE_OK = "(f.deleted_at IS NULL AND NOT TIMESTAMP '2024-01-01 12:00:00' > f.expires_at)"
_OPTIONS_OK = "coalesce(r.dpi BETWEEN 72 AND 600, true) AND r.end_page >= r.start_page"
_PROMPT_OK = "(r.custom_prompt IS NULL OR r.prompt_type = 'ocr')"


@query(f"""
SELECT r.job_id, r.file_id, f.filename, 'queued' AS status, CASE WHEN r.prefer_quality THEN 'qwen3-vl-8b' ELSE 'qwen3-vl-4b' END AS model,
  r.prompt_type, coalesce(r.dpi, 300) AS dpi, coalesce(r.method, 'auto') AS method, r.start_page, r.end_page,
  TIMESTAMP '2024-01-01 12:00:00' AS created_at,
  CASE WHEN r.custom_prompt IS NOT NULL THEN r.custom_prompt WHEN r.prompt_type = 'ocr' THEN 'ocr default' ELSE 'merge default' END AS prompt
FROM {_REQUESTS} r JOIN v_files f USING (file_id) WHERE {_FILE_OK} AND {_OPTIONS_OK} AND {_PROMPT_OK}""")
def submitted_jobs(spark, sf_dir):
    """Requests that become queued jobs: F13, X12, X22, M9, M10."""
    queued, _ = _submitted(spark, sf_dir)
    shown = F.when(F.col("prompt").startswith("<|im_start|>user\n<image>\nExtract all text"), "ocr default").when(
        F.col("prompt").contains("{embedded_text}"), "merge default"
    )
    return queued.withColumn("prompt", F.coalesce(shown, "prompt"))


@query(f"""
SELECT r.job_id, r.file_id, array_to_string(list_filter([
  CASE WHEN NOT r.dpi BETWEEN 72 AND 600 THEN 'dpi must be between 72 and 600' END,
  CASE WHEN r.end_page < r.start_page THEN 'end_page must not be before start_page' END,
  CASE WHEN f.file_id IS NULL OR NOT {_FILE_OK} THEN 'File not found' END,
  CASE WHEN NOT {_PROMPT_OK} THEN 'Missing required variables: embedded_text, ocr_text' END], lambda x: x IS NOT NULL), '; ') AS errors
FROM {_REQUESTS} r LEFT JOIN v_files f USING (file_id)
WHERE NOT coalesce({_FILE_OK} AND {_OPTIONS_OK} AND {_PROMPT_OK}, false)""")
def rejected_requests(spark, sf_dir):
    """Requests turned down, with every reason."""
    _, rejected = _submitted(spark, sf_dir)
    return rejected.withColumn("errors", F.array_join("errors", "; "))


@query("""
SELECT j.job_id, j.status, j.progress_pct, coalesce(p.pages, 0) AS pages, p.embedded_pages, p.ocr_pages, p.hybrid_pages,
  CASE WHEN status = 'processing' AND progress_pct > 0 THEN CAST(trunc(e / (progress_pct / 100.0::DOUBLE) - e) AS BIGINT) END AS estimated_remaining_seconds
FROM (SELECT *, (epoch_us(TIMESTAMP '2001-08-02') - epoch_us(started_at)) / 1e6::DOUBLE AS e FROM v_jobs) j LEFT JOIN (
  SELECT job_id, count(*) AS pages, count(*) FILTER (method = 'embedded') AS embedded_pages,
    count(*) FILTER (method = 'ocr') AS ocr_pages, count(*) FILTER (method = 'hybrid') AS hybrid_pages FROM v_pages GROUP BY 1) p USING (job_id)""")
def job_status(spark, sf_dir):
    """F1, A1, X16 for all jobs."""
    df = rq.job_status(s.jobs(spark, sf_dir), s.page_results(spark, sf_dir), datetime(2001, 8, 2))
    return df.select(
        "job_id", "status", "progress_pct", "pages", "embedded_pages", "ocr_pages", "hybrid_pages",
        "estimated_remaining_seconds",
    )


@query("""
SELECT job_id, count(*) FILTER (event_type = 'page_completion') AS pages_completed, count(*) FILTER (event_type = 'error') AS errors,
  min(timestamp) AS start_time, max(timestamp) AS last_update,
  round_even((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6::DOUBLE, 1) AS duration_seconds,
  count(*) FILTER (event_type = 'stage_transition') AS stage_transitions FROM v_log GROUP BY 1""")
def monitoring_overview(spark, sf_dir):
    """A16, A17, F15 for all jobs."""
    none = F.lit(None)
    log = s.log(spark, sf_dir).withColumns(
        {
            "active_stage": F.col("stage"),
            "stage_page": F.col("page_number"),
            "stage_total_pages": none.cast("int"),
            "overall_progress_pct": F.col("progress_pct"),
            "model_type": none.cast("string"),
        }
    )
    return rq.monitoring_overview(log)


@query("""
SELECT parent_batch_id, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed,
  CASE WHEN count(*) FILTER (status = 'completed') = 0 THEN 'failed' ELSE 'completed' END AS status,
  count(*) FILTER (status = 'completed') BETWEEN 1 AND count(*) - 1 AS is_partial,
  CASE WHEN count(*) FILTER (status = 'completed') = 0 THEN count(*) FILTER (status = 'failed') || ' of ' || count(*) || ' documents failed' END AS error_message,
  round(sum(CASE status WHEN 'completed' THEN 1.0::DOUBLE WHEN 'processing' THEN progress_pct / 100 ELSE 0 END) / count(*) * 100, 6) AS overall_progress_pct,
  coalesce(epoch_us(max(completed_at)) - epoch_us(min(started_at)), 0) / 1e6::DOUBLE AS overall_processing_time_seconds,
  count(*) FILTER (status NOT IN ('completed', 'processing')) AS failed_files
FROM v_jobs GROUP BY 1""")
def batch_report(spark, sf_dir):
    """A3, A4, A6, A8 for all batches."""
    df = oj.batch_report(s.jobs(spark, sf_dir))
    return df.withColumn("overall_progress_pct", F.round("overall_progress_pct", 6))
