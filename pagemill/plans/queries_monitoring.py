"""Registered queries over the monitoring log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from pagemill.functions import messages as fm
from pagemill.functions import progress as fp
from pagemill.functions import text as ft
from pagemill.functions.times import moment
from pagemill.operators import monitoring as om
from pagemill.operators import rollups as ro
from pagemill.plans.registry import query
from pagemill.session import scratch_dir
from pagemill.sources import clustered as cl
from pagemill.sources import files as sf
from pagemill.sources import logs as sl
from pagemill.sources import standins as s

NOW = datetime(2024, 1, 20, 12, 0, 0)


@query("""
SELECT event_id, job_id, timestamp, event_type FROM v_log
WHERE timestamp >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 600 MINUTE AND event_type = 'stage_transition'""")
def metrics_history(spark, sf_dir):
    """F14."""
    rows = om.metrics_history(s.log(spark, sf_dir), NOW, 600, event_type="stage_transition")
    return rows.select("event_id", "job_id", "timestamp", "event_type")


@query("""
SELECT event_id, job_id, timestamp, event_type FROM v_log
WHERE timestamp >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 600 MINUTE AND event_type = 'stage_transition'""")
def recent_log(spark, sf_dir):
    """The log stored by day; the bound on time leaves out the folders of earlier days."""
    path = scratch_dir(spark, "log-by-day")
    cl.write_log_by_day(s.log(spark, sf_dir), path)
    log = cl.read_log_since(spark, path, cl.history_cutoff(NOW, 600))
    return om.metrics_history(log, NOW, 600, event_type="stage_transition").select("event_id", "job_id", "timestamp", "event_type")


@query("""
SELECT event_id, job_id, event_type, timestamp AS created_at FROM v_log WHERE job_id = 7 ORDER BY created_at, event_id LIMIT 100""")
def events_of_job_clustered(spark, sf_dir):
    """O2, S3: events stored by job; the filter reads the row groups of the job."""
    path = scratch_dir(spark, "events-by-job")
    events = s.log(spark, sf_dir).select("event_id", "job_id", "event_type", F.col("timestamp").alias("created_at"))
    cl.write_clustered(events, path, ["job_id", "created_at", "event_id"])
    return om.job_events(cl.lookup(spark, path, "job_id", [7]), 7, limit=100)


@query("""
SELECT event_id, job_id, timestamp, page_number, page_duration_s FROM v_log
WHERE event_type = 'page_completion' AND stage = 'merge'""")
def page_completions(spark, sf_dir):
    """F15."""
    rows = om.page_completions(s.log(spark, sf_dir), stage="merge")
    return rows.select("event_id", "job_id", "timestamp", "page_number", "page_duration_s")


@query("SELECT * FROM v_log QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY timestamp DESC, event_id DESC) = 1")
def latest_metrics(spark, sf_dir):
    """W1."""
    return om.latest_metrics(s.log(spark, sf_dir))


@query("SELECT * FROM v_log ORDER BY timestamp DESC, event_id DESC LIMIT 1")
def latest_overall(spark, sf_dir):
    """W1 over all jobs."""
    return om.latest_overall(s.log(spark, sf_dir))


@query("""
SELECT event_id, job_id, timestamp, cpu_percent FROM v_log
QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY timestamp DESC, event_id DESC) <= 20""")
def last_samples(spark, sf_dir):
    """W2 with 20 slots."""
    log = s.log(spark, sf_dir).select("event_id", "job_id", "timestamp", "cpu_percent")
    return om.last_n(log, "job_id", om.ORDER, 20)


@query("""
SELECT event_id, gpu_id, memory_used_mb, round(memory_used_mb - lag(memory_used_mb) OVER (
  PARTITION BY gpu_id ORDER BY timestamp, event_id), 6) AS delta FROM v_log""")
def memory_deltas(spark, sf_dir):
    """W3 on two devices."""
    log = s.log(spark, sf_dir).select("event_id", "timestamp", "gpu_id", "memory_used_mb")
    return om.metric_delta(log, "gpu_id").withColumn("delta", F.round("delta", 6)).drop("timestamp")


@query("""
SELECT event_id, job_id, page_number, row_number() OVER (PARTITION BY job_id, page_number ORDER BY timestamp, event_id) AS seq
FROM v_log""")
def update_sequence(spark, sf_dir):
    """W6."""
    log = s.log(spark, sf_dir).select("event_id", "job_id", "page_number", "timestamp")
    return om.with_seq(log).drop("timestamp")


@query("""
SELECT event_id, job_id, progress_pct, previous_pct FROM (SELECT *, lag(progress_pct) OVER (
  PARTITION BY job_id ORDER BY timestamp, event_id) AS previous_pct FROM v_log) WHERE progress_pct < previous_pct""")
def progress_violations(spark, sf_dir):
    """W7."""
    log = s.log(spark, sf_dir).select("event_id", "job_id", "timestamp", "progress_pct")
    return om.progress_violations(log).drop("timestamp")


@query("""
SELECT row_number() OVER (ORDER BY timestamp, event_id) - 1 AS index, timestamp, round(cpu_percent, 1) AS value,
  85 AS warn_at, 95 AS error_at FROM v_log""")
def cpu_timeline(spark, sf_dir):
    """W11 over the whole log."""
    return om.timeline(s.log(spark, sf_dir).select("event_id", "timestamp", "cpu_percent"), "cpu")


@query("""
SELECT gpu_id, row_number() OVER (PARTITION BY gpu_id ORDER BY timestamp, event_id) - 1 AS index, timestamp,
  round(memory_used_mb / memory_total_mb * 100, 1) AS value, 85 AS warn_at, 95 AS error_at FROM v_log""")
def gpu_timeline(spark, sf_dir):
    """W11 per device."""
    log = s.log(spark, sf_dir).select("event_id", "timestamp", "gpu_id", "memory_used_mb", "memory_total_mb")
    return om.timeline(log, "gpu_memory", keys=("gpu_id",))


@query("""
SELECT job_id, min(timestamp) AS start_time, max(timestamp) AS last_update,
  count(*) FILTER (event_type = 'stage_transition') AS stage_transitions,
  arg_max(stage, timestamp) FILTER (true) AS active_stage_text,
  round_even((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6::DOUBLE, 1) AS duration_seconds,
  arg_max(page_number, timestamp) AS stage_page, arg_max(progress_pct, timestamp) AS overall_progress_pct
FROM (SELECT * REPLACE (coalesce(stage, 'none') AS stage) FROM v_log) GROUP BY 1""")
def job_log_summary(spark, sf_dir):
    """A16."""
    log = s.log(spark, sf_dir).select(
        "job_id",
        "event_id",
        "timestamp",
        "event_type",
        F.coalesce("stage", F.lit("none")).alias("active_stage"),
        F.col("page_number").alias("stage_page"),
        F.lit(7).alias("stage_total_pages"),
        F.col("progress_pct").alias("overall_progress_pct"),
        F.lit(None).cast("string").alias("model_type"),
    )
    return om.job_summary(log).withColumnRenamed("active_stage", "active_stage_text").drop(
        "stage_total_pages", "model_type"
    )


@query("""
SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY timestamp, event_id) AS transition_no, timestamp,
  'ocr' AS from_stage, CASE WHEN page_number > 50 THEN 'merge' ELSE 'completed' END AS to_stage
FROM v_log WHERE event_type = 'stage_transition'""")
def stage_transitions(spark, sf_dir):
    """A16, listed transitions."""
    log = s.log(spark, sf_dir).withColumns(
        {
            "from_stage": F.lit("ocr"),
            "to_stage": F.when(F.col("page_number") > 50, "merge").otherwise("completed"),
        }
    )
    return om.stage_transitions(log)


@query("SELECT DISTINCT job_id FROM v_log")
def logged_jobs(spark, sf_dir):
    """A17."""
    return om.logged_jobs(s.log(spark, sf_dir))


@query("SELECT min(timestamp) AS start, max(timestamp) AS \"end\", count(*) AS duration_seconds FROM v_log")
def metrics_time_range(spark, sf_dir):
    """A18."""
    return om.metrics_time_range(s.log(spark, sf_dir))


@query("""
SELECT count(DISTINCT gpu_id) AS total_gpus, round(avg(cpu_percent), 1) AS avg_cpu, round(avg(ram_percent), 1) AS avg_ram
FROM v_log""")
def dashboard_averages(spark, sf_dir):
    """A20."""
    return om.dashboard_averages(s.log(spark, sf_dir))


@query("""
SELECT coalesce(stage, 'other') AS model, count(*) FILTER (event_type <> 'error') AS request_count,
  count(*) FILTER (event_type = 'error') AS error_count,
  round(coalesce(avg(page_duration_s) FILTER (event_type <> 'error'), 0), 6) AS avg_time FROM v_log GROUP BY 1""")
def request_telemetry(spark, sf_dir):
    """A15."""
    requests = s.log(spark, sf_dir).select(
        F.coalesce("stage", F.lit("other")).alias("model"),
        (F.col("event_type") == "error").alias("is_error"),
        F.col("page_duration_s").alias("elapsed_s"),
    )
    return om.request_telemetry(requests).withColumn("avg_time", F.round("avg_time", 6))


def _rollup(spark, sf_dir):
    """The log rolled up in two runs, each with whole days."""
    path = scratch_dir(spark, "rollup")
    log = s.log(spark, sf_dir)
    early = F.col("timestamp") < F.lit("2024-01-12").cast("timestamp_ntz")
    ro.write_rollup(log.where(early), path)
    ro.write_rollup(log.where(~F.coalesce(early, F.lit(False))), path)
    return ro.read_rollup(spark, path)


@query("""
SELECT coalesce(stage, 'other') AS model, count(*) FILTER (event_type <> 'error') AS request_count,
  count(*) FILTER (event_type = 'error') AS error_count,
  round(coalesce(avg(page_duration_s) FILTER (event_type <> 'error'), 0), 6) AS avg_time FROM v_log GROUP BY 1""")
def rolled_up_telemetry(spark, sf_dir):
    """A15 from daily partials."""
    return ro.telemetry(_rollup(spark, sf_dir)).withColumn("avg_time", F.round("avg_time", 6))


@query("""
SELECT count(DISTINCT gpu_id) AS total_gpus, round(avg(cpu_percent), 1) AS avg_cpu, round(avg(ram_percent), 1) AS avg_ram
FROM v_log""")
def rolled_up_dashboard(spark, sf_dir):
    """A20 from daily partials."""
    return ro.averages(_rollup(spark, sf_dir)).drop("about_jobs")


@query("SELECT min(timestamp) AS start, max(timestamp) AS \"end\", count(*) AS duration_seconds FROM v_log")
def rolled_up_time_range(spark, sf_dir):
    """A18 from daily partials."""
    return ro.time_range(_rollup(spark, sf_dir))


@query("""
WITH p AS (SELECT coalesce(stage, 'other') AS model, page_number % 3 AS dpi, page_duration_s AS peak,
    progress_pct AS forecast, timestamp FROM v_log),
e AS (SELECT *, (forecast - peak) / nullif(peak, 0) * 100 AS err FROM p),
f AS (SELECT model, * EXCLUDE (model) FROM e UNION ALL SELECT NULL, * EXCLUDE (model) FROM e)
SELECT model, count(*) AS profiles, count(DISTINCT dpi) AS dpi_settings, min(timestamp) AS oldest, max(timestamp) AS newest,
  round(avg(peak), 6) AS avg_peak_gb, max(peak) AS max_peak_gb, min(peak) AS min_peak_gb,
  round(avg(abs(err)), 6) AS avg_error_pct, round(max(abs(err)), 6) AS max_error_pct,
  round(min(abs(err)), 6) AS min_error_pct, round(stddev_pop(err), 6) AS std_dev_pct,
  count(*) FILTER (err < -5) AS underestimated, count(*) FILTER (err > 5) AS overestimated FROM f GROUP BY 1""")
def profile_report(spark, sf_dir):
    """A21."""
    profiles = s.log(spark, sf_dir).select(
        F.coalesce("stage", F.lit("other")).alias("model"),
        (F.col("page_number") % 3).alias("dpi"),
        F.col("page_duration_s").alias("peak_gb"),
        F.col("progress_pct").alias("forecast_gb"),
        F.col("timestamp").alias("created_at"),
    )
    df = om.profile_report(profiles)
    rounded = ["avg_peak_gb", "avg_error_pct", "max_error_pct", "min_error_pct", "std_dev_pct"]
    return df.withColumns({c: F.round(c, 6) for c in rounded})


_ALERTS = """
(SELECT job_id, event_id, timestamp, CASE WHEN v >= 95 THEN 'error' ELSE 'warning' END AS type,
  what || ' usage ' || CASE WHEN v >= 95 THEN 'critical' ELSE 'high' END || ': ' || printf('%.1f', v) || '%' AS message,
  rank FROM (SELECT job_id, event_id, timestamp, round(cpu_percent) AS v, 'CPU' AS what, 0 AS rank FROM v_log
    UNION ALL SELECT job_id, event_id, timestamp, round(ram_percent), 'RAM', 1 FROM v_log) WHERE v >= 85)"""


def _alerts(spark, sf_dir):
    log = s.log(spark, sf_dir)
    return om.alerts(log.withColumns({c: F.round(c) for c in ("cpu_percent", "ram_percent")}))


@query(f"SELECT job_id, event_id, timestamp, type, message FROM {_ALERTS}")
def metric_alerts(spark, sf_dir):
    """X19."""
    return _alerts(spark, sf_dir).drop("alert_no")


@query(f"SELECT event_id, type, message FROM {_ALERTS}")
def ordered_alerts(spark, sf_dir):
    """O4."""
    return om.order_alerts(_alerts(spark, sf_dir)).select("event_id", "type", "message")


@query("""
SELECT event_id, job_id, event_type, timestamp AS created_at FROM v_log WHERE job_id = 7
ORDER BY created_at, event_id LIMIT 100""")
def events_of_job(spark, sf_dir):
    """O2."""
    events = s.log(spark, sf_dir).select("event_id", "job_id", "event_type", F.col("timestamp").alias("created_at"))
    return om.job_events(events, 7, limit=100)


@query("""
SELECT event_id, CASE WHEN v > 1 THEN v ELSE v * 100 END AS pct, CASE WHEN v > 1 THEN v / 100 ELSE v END AS frac,
  round_even(CAST(page_number + 1 AS DOUBLE) / 70 * 100, 1) AS stage_pct
FROM (SELECT event_id, page_number, CASE WHEN gpu_id = 0 THEN cpu_percent / 100 ELSE cpu_percent END AS v FROM v_log)""")
def normalised_percents(spark, sf_dir):
    """X20, X21."""
    v = F.when(F.col("gpu_id") == 0, F.col("cpu_percent") / 100).otherwise(F.col("cpu_percent"))
    return s.log(spark, sf_dir).select(
        "event_id",
        fp.percent(v).alias("pct"),
        fp.fraction(v).alias("frac"),
        fp.stage_percent(F.col("page_number"), F.lit(70)).alias("stage_pct"),
    )


@query("""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, 300 AS dpi, 'auto' AS method FROM events""")
def json_options(spark, sf_dir):
    """X24."""
    props = F.col("props")
    return s.table(spark, sf_dir, "events").select(
        "event_id",
        fm.json_option(props, "k", "int", 0).alias("k"),
        fm.json_option(props, "dpi", "int", 300).alias("dpi"),
        fm.json_option(props, "method", "string", "auto").alias("method"),
    )


@query("""
SELECT event_id, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS params,
  event_type = 'click' AS emptied FROM events""")
def cleaned_params(spark, sf_dir):
    """F16: null parameters dropped; a map left empty becomes null."""
    kind = F.col("event_type")
    params = F.create_map(
        F.lit("kind"),
        F.when(kind != "click", kind),
        F.lit("value"),
        F.when(kind == "error", F.col("value").cast("string")),
    )
    kept = fm.drop_nulls(params)
    return s.table(spark, sf_dir, "events").select(
        "event_id",
        F.coalesce(F.size(kept), F.lit(1)).alias("params"),
        kept.isNull().alias("emptied"),
    )


@query("""
SELECT event_id, wide, narrow FROM (SELECT event_id, event_type IN ('error', 'signup') AS wide, event_type = 'error' AS narrow
FROM events)""")
def memory_errors(spark, sf_dir):
    """X28."""
    kind = F.col("event_type")
    message = F.when(kind == "error", "CUDA error: Out of Memory").when(kind == "signup", "killed by OOM").otherwise("timeout")
    return s.table(spark, sf_dir, "events").select(
        "event_id",
        ft.is_out_of_memory(message).alias("wide"),
        ft.is_out_of_memory(message, wide=False).alias("narrow"),
    )


@query("""
SELECT event_id, CASE WHEN age < 60 THEN 'Just now'
  WHEN age < 3600 THEN (age // 60) || ' minute' || CASE WHEN age // 60 > 1 THEN 's' ELSE '' END || ' ago'
  WHEN CAST(timestamp AS DATE) = DATE '2024-01-30' THEN strftime(timestamp, '%-I:%M %p')
  WHEN age < 604800 THEN (age // 86400) || ' day' || CASE WHEN age // 86400 > 1 THEN 's' ELSE '' END || ' ago'
  ELSE strftime(timestamp, '%b %-d') END AS label
FROM (SELECT event_id, timestamp, epoch(TIMESTAMP '2024-01-30 23:59:00')::BIGINT - floor(epoch(timestamp))::BIGINT AS age
  FROM v_log)""")
def event_ages(spark, sf_dir):
    """X18 relative time."""
    now = moment(datetime(2024, 1, 30, 23, 59, 0))
    return s.log(spark, sf_dir).select("event_id", ft.relative_time(F.col("timestamp"), now).alias("label"))


@query("""
SELECT event_id, job_id, event_type, cpu_percent FROM v_log""")
def log_round_trip(spark, sf_dir):
    """The log written as JSON lines and read back."""
    path = scratch_dir(spark, "log")
    log = s.log(spark, sf_dir).select(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.col("job_id").cast("string").alias("job_id"),
        "event_type",
        F.col("event_id").cast("int").alias("stage_page"),
        F.struct(F.lit(None).cast("double").alias("ram_percent"), "cpu_percent").alias("system"),
    )
    sl.write_metrics_log(log, path)
    read = om.with_event_time(sl.read_metrics_log(spark, path))
    return read.select(
        F.col("stage_page").cast("bigint").alias("event_id"),
        F.col("job_id").cast("bigint").alias("job_id"),
        "event_type",
        F.col("system.cpu_percent").alias("cpu_percent"),
    )


@query("SELECT event_id, job_id, event_type, timestamp AS created_at FROM v_log")
def audit_events(spark, sf_dir):
    """Events appended in two writes."""
    path = scratch_dir(spark, "events")
    events = s.log(spark, sf_dir).select("event_id", "job_id", "event_type", F.col("timestamp").alias("created_at"))
    sf.append_job_events(events.where("event_type = 'error'"), path)
    sf.append_job_events(events.where("event_type <> 'error'"), path)
    return spark.read.parquet(path)


@query(f"""
SELECT 'summary' AS kind, 1::BIGINT AS rows, count(*) FILTER (false) AS errors FROM v_log
UNION ALL SELECT 'history', count(*), 0 FROM v_log
UNION ALL SELECT 'alert', count(*), count(*) FILTER (type = 'error') FROM {_ALERTS}""")
def metrics_export(spark, sf_dir):
    """Lines of the export by kind."""
    log = s.log(spark, sf_dir)
    export = sl.export_metrics(log, _alerts(spark, sf_dir), NOW)
    is_error = (F.col("kind") == "alert") & (F.get_json_object("json", "$.type") == "error")
    return export.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.count_if(is_error).alias("errors"))
