"""Analytics over the monitoring log.

A log row has job_id, event_id (tie-break), timestamp, event_type and, by type,
stage, page_number, page_duration_s, cpu_percent, ram_percent, gpu_id, ...
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from pagemill.functions.times import micros, moment
from pagemill.functions import progress as fp
from pagemill.operators.blocked import fitted_block, fitted_time_block, previous, row_numbers, time_blocks
from pagemill.operators.mutations import latest_rows

ORDER = ["timestamp", "event_id"]
#: Spark's default for spark.sql.optimizer.windowGroupLimitThreshold.
GROUP_LIMIT = 1000


def with_event_time(log: DataFrame) -> DataFrame:
    """Parses the ISO-8601 ``timestamp`` text of a log; unreadable ones become null."""
    return log.withColumn("timestamp", F.try_to_timestamp("timestamp"))


def metrics_history(
    log: DataFrame, now: datetime, minutes: int = 60, job_id=None, event_type: str | None = None
) -> DataFrame:
    """rows of the last ``minutes``; rows without a timestamp are kept."""
    cutoff = moment(now) - F.expr(f"INTERVAL {int(minutes)} MINUTES")
    rows = log.where(F.col("timestamp").isNull() | (F.col("timestamp") >= cutoff))
    if job_id is not None:
        rows = rows.where(F.col("job_id") == job_id)
    if event_type:
        rows = rows.where(F.col("event_type") == event_type)
    return rows


def page_completions(log: DataFrame, job_id=None, stage: str | None = None) -> DataFrame:
    """page completion events."""
    rows = log.where(F.col("event_type") == "page_completion")
    if job_id is not None:
        rows = rows.where(F.col("job_id") == job_id)
    if stage:
        rows = rows.where(F.col("stage") == stage)
    return rows


def latest_metrics(log: DataFrame) -> DataFrame:
    """Newest row of each job."""
    return latest_rows(log, ["job_id"], ORDER)


def latest_overall(log: DataFrame) -> DataFrame:
    """W1 without a job: the newest row of all."""
    return log.orderBy(F.desc("timestamp"), F.desc("event_id")).limit(1)


def last_n(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """Newest ``n`` rows of each key, oldest first.

    Up to ``GROUP_LIMIT`` the rank filter becomes a window group limit: every
    task keeps at most ``n`` rows per key before the shuffle. Spark has no such
    limit for more rows, so these are numbered in blocks, counted from the
    newest end; the rows are the same either way.
    """
    newest = [F.desc(c) for c in order]
    if n <= GROUP_LIMIT:
        ranked = df.withColumn("__rank", F.row_number().over(W.partitionBy(key).orderBy(*newest)))
    else:
        whole = isinstance(df.schema[order[0]].dataType, IntegralType)
        fine = [F.floor(F.col(order[0]) / 4096), F.col(order[0])] if whole else time_blocks(order[0])
        blocks = [F.coalesce(-b, F.lit(1 << 62)) for b in fine]
        ranked = row_numbers(df, [key], fitted_block(df, [key], blocks), newest, "__rank")
    return ranked.where(F.col("__rank") <= n).drop("__rank").orderBy(key, *order)


def metric_delta(
    log: DataFrame, key: str, value: str = "memory_used_mb", seconds_per_block: int | None = None
) -> DataFrame:
    """Adds ``delta`` to the preceding sample of the key; null on the first."""
    rows = previous(log, [key], fitted_time_block(log, [key], *ORDER, seconds_per_block), ORDER, value, "__before")
    return rows.withColumn("delta", F.col(value) - F.col("__before")).drop("__before")


def with_seq(events: DataFrame, seconds_per_block: int | None = None) -> DataFrame:
    """seq = 1, 2, 3, ... of the updates of each (job, page) in event order."""
    keys = ["job_id", "page_number"]
    return row_numbers(events, keys, fitted_time_block(events, keys, *ORDER, seconds_per_block), ORDER, "seq")


def progress_violations(events: DataFrame, seconds_per_block: int | None = None) -> DataFrame:
    """Rows whose percent is below that of the preceding row of the job."""
    block = fitted_time_block(events, ["job_id"], *ORDER, seconds_per_block)
    rows = previous(events, ["job_id"], block, ORDER, "progress_pct", "previous_pct")
    return rows.where(F.col("progress_pct") < F.col("previous_pct"))


def metric_value(metric: str) -> Column:
    """The plotted value of a metric; one decimal except for temperatures."""
    used = F.try_divide(F.col("memory_used_mb"), F.col("memory_total_mb")) * 100
    return {
        "gpu_memory": F.round(used, 1),
        "gpu_temp": F.col("temperature_c"),
        "cpu": F.round(F.coalesce(F.col("cpu_percent"), F.lit(0.0)), 1),
        "ram": F.round(F.coalesce(F.col("ram_percent"), F.lit(0.0)), 1),
    }[metric]


def timeline(log: DataFrame, metric: str, keys: tuple[str, ...] = (), seconds_per_block: int | None = None) -> DataFrame:
    """(index, timestamp, value) points of one metric with its alert thresholds.

    The index counts all samples in order from 0; points without a value are
    dropped afterwards.
    """
    warn, error = (
        (fp.WARN_CELSIUS, fp.ERROR_CELSIUS) if metric == "gpu_temp" else (fp.WARN_PERCENT, fp.ERROR_PERCENT)
    )
    rows = row_numbers(log, list(keys), fitted_time_block(log, list(keys), *ORDER, seconds_per_block), ORDER, "__n")
    return rows.select(
        *keys,
        (F.col("__n") - 1).alias("index"),
        "timestamp",
        metric_value(metric).alias("value"),
        F.lit(warn).alias("warn_at"),
        F.lit(error).alias("error_at"),
    ).where(F.col("value").isNotNull())


def job_summary(log: DataFrame) -> DataFrame:
    """First and last sample of each job, duration and last stage fields.

    Stage transitions are counted here and listed by ``stage_transitions``, as
    their number has no bound.
    """
    at = F.struct(*ORDER)
    last = F.max_by(
        F.struct("active_stage", "stage_page", "stage_total_pages", "overall_progress_pct", "model_type"), at
    )
    # Rows without a timestamp carry no position and cannot be first or last.
    return (
        log.where(F.col("timestamp").isNotNull())
        .groupBy("job_id")
        .agg(
            F.min("timestamp").alias("start_time"),
            F.max("timestamp").alias("last_update"),
            F.count_if(F.col("event_type") == "stage_transition").alias("stage_transitions"),
            last.alias("__last"),
        )
        .withColumn(
            "duration_seconds",
            F.bround((micros(F.col("last_update")) - micros(F.col("start_time"))) / 1e6, 1),
        )
        .select("job_id", "start_time", "last_update", "duration_seconds", "stage_transitions", "__last.*")
    )


def stage_transitions(log: DataFrame, seconds_per_block: int | None = None) -> DataFrame:
    """The stage transitions of each job numbered in event order."""
    rows = log.where(F.col("event_type") == "stage_transition")
    numbered = row_numbers(
        rows, ["job_id"], fitted_time_block(rows, ["job_id"], *ORDER, seconds_per_block), ORDER, "transition_no"
    )
    return numbered.select("job_id", "transition_no", "timestamp", "from_stage", "to_stage")


def logged_jobs(log: DataFrame) -> DataFrame:
    """Ids of jobs that have log rows, sorted."""
    return log.select("job_id").distinct().orderBy("job_id")


def metrics_time_range(log: DataFrame) -> DataFrame:
    """Start, end and number of samples; the figure called duration is the sample count."""
    return log.agg(
        F.min("timestamp").alias("start"),
        F.max("timestamp").alias("end"),
        F.count(F.lit(1)).alias("duration_seconds"),
    )


def dashboard_averages(log: DataFrame) -> DataFrame:
    """Mean CPU and memory percent (missing samples count as 0), and the number of devices."""
    zero = F.lit(0.0)
    return log.agg(
        F.count_distinct("gpu_id").alias("total_gpus"),
        F.round(F.avg(F.coalesce("cpu_percent", zero)), 1).alias("avg_cpu"),
        F.round(F.avg(F.coalesce("ram_percent", zero)), 1).alias("avg_ram"),
    )


def request_telemetry(requests: DataFrame) -> DataFrame:
    """Per model the finished requests, errors and mean time of the finished ones (0 when none)."""
    ok = ~F.col("is_error")
    return requests.groupBy("model").agg(
        F.count_if(ok).alias("request_count"),
        F.count_if("is_error").alias("error_count"),
        F.coalesce(F.avg(F.when(ok, F.col("elapsed_s"))), F.lit(0.0)).alias("avg_time"),
    )


def profile_report(profiles: DataFrame) -> DataFrame:
    """Per-model memory profile figures; the row without a model is the total.

    The forecast error is (forecast - actual) / actual in percent; more than 5
    off counts as under- or overestimated. Two plain aggregates, so the rows
    are not multiplied as grouping sets would.
    """
    error = F.try_divide(F.col("forecast_gb") - F.col("peak_gb"), F.col("peak_gb")) * 100
    rows = profiles.withColumn("__error", error)
    figures = [
        F.count(F.lit(1)).alias("profiles"),
        F.count_distinct("dpi").alias("dpi_settings"),
        F.min("created_at").alias("oldest"),
        F.max("created_at").alias("newest"),
        F.avg("peak_gb").alias("avg_peak_gb"),
        F.max("peak_gb").alias("max_peak_gb"),
        F.min("peak_gb").alias("min_peak_gb"),
        F.avg(F.abs("__error")).alias("avg_error_pct"),
        F.max(F.abs("__error")).alias("max_error_pct"),
        F.min(F.abs("__error")).alias("min_error_pct"),
        F.stddev_pop("__error").alias("std_dev_pct"),
        F.count_if(F.col("__error") < -5).alias("underestimated"),
        F.count_if(F.col("__error") > 5).alias("overestimated"),
    ]
    per_model = rows.groupBy("model").agg(*figures)
    total = rows.agg(*figures).withColumn("model", F.lit(None).cast("string"))
    return per_model.unionByName(total)


def alerts(log: DataFrame) -> DataFrame:
    """One row per alert of each sample, devices first."""
    found = fp.host_alerts(F.col("cpu_percent"), F.col("ram_percent"))
    if "gpus" in log.columns:
        found = F.coalesce(F.concat(fp.gpu_alerts(F.col("gpus")), found), found)
    return log.select("job_id", "event_id", "timestamp", F.posexplode(found).alias("alert_no", "alert")).select(
        "job_id", "event_id", "timestamp", "alert_no", "alert.type", "alert.message"
    )


def order_alerts(rows: DataFrame) -> DataFrame:
    """Errors first, otherwise in order of appearance."""
    return rows.orderBy(F.when(F.col("type") == "error", 0).otherwise(1), "event_id", "alert_no")


def job_events(events: DataFrame, job_id, limit: int | None = None) -> DataFrame:
    """O2: oldest events of a job."""
    ordered = events.where(F.col("job_id") == job_id).orderBy("created_at", "event_id")
    return ordered if limit is None else ordered.limit(limit)
