"""What a caller asks for, as compositions of the operators.

Each function answers one kind of request for any number of jobs at once.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import files as ff
from pagemill.functions import prompts as fp
from pagemill.functions.times import moment
from pagemill.operators import catalog as oc
from pagemill.operators import jobs as oj
from pagemill.operators import monitoring as om
from pagemill.operators import prompts as op


def submit_jobs(
    requests: DataFrame, files: DataFrame, catalog: DataFrame, now: datetime
) -> tuple[DataFrame, DataFrame]:
    """Queued job rows for valid requests, and the rejected ones with their errors.

    ``requests`` has job_id, file_id, prompt_type, custom_prompt, prefer_quality,
    dpi, method, start_page and end_page. A request is rejected when its file is
    unknown, deleted or expired, an option is out of range or its prompt lacks a
    variable (F13, X12, X22, M9, M10).
    """
    live = files.where(F.col("deleted_at").isNull() & ~ff.is_expired(F.col("expires_at"), moment(now)))
    known = oc.option_errors(requests).join(
        live.select("file_id", "filename").withColumn("__found", F.lit(True)), "file_id", "left"
    )
    missing = fp.missing_variables(F.col("custom_prompt"), F.col("prompt_type"))
    prompt_error = F.when(
        F.col("custom_prompt").isNotNull() & (F.size(missing) > 0),
        F.concat(F.lit("Missing required variables: "), F.array_join(missing, ", ")),
    )
    file_error = F.when(F.col("__found").isNull(), "File not found")
    checked = known.withColumn(
        "errors", F.concat(F.col("errors"), F.array_compact(F.array(file_error, prompt_error)))
    ).drop("__found")
    accepted = oj.choose_model(checked.where(F.size("errors") == 0), F.coalesce("prefer_quality", F.lit(True)))
    queued = op.resolve_prompts(accepted.withColumnRenamed("merge_model", "model"), catalog).select(
        "job_id",
        "file_id",
        "filename",
        F.lit("queued").alias("status"),
        "model",
        "prompt_type",
        "prompt",
        F.coalesce("dpi", F.lit(300)).alias("dpi"),
        F.coalesce("method", F.lit("auto")).alias("method"),
        "start_page",
        "end_page",
        moment(now).alias("created_at"),
    )
    return queued, checked.where(F.size("errors") > 0).select("job_id", "file_id", "errors")


def job_status(jobs: DataFrame, pages: DataFrame, now: datetime) -> DataFrame:
    """Status, page count, methods and remaining time of each job."""
    summary = oj.document_summary(pages)
    return oj.with_eta(jobs, now).join(summary, "job_id", "left").withColumn(
        "pages", F.coalesce("pages", F.lit(0).cast("bigint"))
    )


def monitoring_overview(log: DataFrame) -> DataFrame:
    """Per job the span of its log, its transitions, completed pages and errors."""
    figures = log.groupBy("job_id").agg(
        F.count_if(F.col("event_type") == "page_completion").alias("pages_completed"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
    )
    spans = om.job_summary(log).select(
        "job_id", "start_time", "last_update", "duration_seconds", "stage_transitions"
    )
    return figures.join(spans, "job_id", "left")
