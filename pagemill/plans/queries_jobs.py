"""Registered queries over jobs, batches and the catalog."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from pagemill.functions import files as ff
from pagemill.functions import progress as fp
from pagemill.functions import text as ft
from pagemill.functions.times import moment
from pagemill.operators import catalog as oc
from pagemill.operators import documents as od
from pagemill.operators import jobs as oj
from pagemill.operators import mutations as om
from pagemill.plans.registry import query
from pagemill.session import scratch_dir
from pagemill.sources import clustered as cl
from pagemill.sources import standins as s

NOW = datetime(2024, 1, 1, 12, 0, 0)
JOBS_NOW = datetime(2001, 8, 2)


# Point reads and lists


@query("SELECT * FROM v_jobs WHERE job_id = 77")
def job_by_id(spark, sf_dir):
    """F1."""
    return oc.get_by_id(s.jobs(spark, sf_dir), "job_id", 77)


@query("SELECT * FROM v_jobs WHERE job_id = 77")
def job_by_id_clustered(spark, sf_dir):
    """F1, S3: jobs stored by their id; the lookup reads one row group."""
    path = scratch_dir(spark, "jobs-by-id")
    cl.write_clustered(s.jobs(spark, sf_dir), path, ["job_id"])
    return oc.get_by_id(cl.lookup(spark, path, "job_id", [77]), "job_id", 77)


@query("""
SELECT * FROM v_jobs WHERE status = 'completed' AND model = 'qwen3-vl-8b' ORDER BY job_id LIMIT 100""")
def filtered_jobs(spark, sf_dir):
    """F2."""
    filters = {"status": "completed", "model": "qwen3-vl-8b"}
    return oc.list_all(s.jobs(spark, sf_dir), filters, limit=100, order=["job_id"])


@query("""
SELECT * FROM v_files WHERE user_id = 'src3' AND deleted_at IS NULL
ORDER BY uploaded_at DESC, file_id DESC LIMIT 100""")
def files_of_user(spark, sf_dir):
    """F3."""
    return oc.list_files_by_user(s.files(spark, sf_dir), "src3", limit=100)


@query("""
SELECT * FROM v_files WHERE expires_at < TIMESTAMP '2024-01-01 12:00:00' AND deleted_at IS NULL
ORDER BY expires_at, file_id LIMIT 100""")
def expired_files(spark, sf_dir):
    """F4."""
    return oc.list_expired_files(s.files(spark, sf_dir), NOW, limit=100)


@query("""
SELECT file_id, expires_at, TIMESTAMP '2024-01-01 12:00:00' > expires_at AS expired FROM v_files""")
def file_expiry(spark, sf_dir):
    """X22."""
    up = s.files(spark, sf_dir)
    expiry = ff.expires_at(F.col("uploaded_at"), 6)
    return up.select(
        "file_id", expiry.alias("expires_at"), ff.is_expired(expiry, moment(NOW)).alias("expired")
    )


@query("SELECT * FROM v_jobs WHERE user_id = 42 ORDER BY created_at DESC, job_id DESC LIMIT 100")
def jobs_of_user(spark, sf_dir):
    """F5."""
    return oc.jobs_by_user(s.jobs(spark, sf_dir), 42, limit=100)


@query("""
SELECT * FROM v_batches WHERE status = 'processing' ORDER BY created_at DESC, batch_job_id DESC LIMIT 100""")
def batches_in_status(spark, sf_dir):
    """F5."""
    return oc.batches_by_status(s.batches(spark, sf_dir), "processing", limit=100)


# Validation


@query("""
SELECT file_id, CASE WHEN size_bytes > 0.01 * 1024 * 1024 THEN 'size'
  WHEN lower(regexp_extract(filename, '\\.[^.]*$')) NOT IN ('.jpg', '.jpeg', '.png', '.pdf', '.tiff', '.tif')
  THEN 'Unsupported file type: ' || lower(regexp_extract(filename, '\\.[^.]*$')) END AS error FROM v_files""")
def file_validity(spark, sf_dir):
    """F10; size messages are shortened as the two engines format decimals differently."""
    df = oc.file_errors(s.files(spark, sf_dir), max_mb=0.01)
    error = F.when(F.col("error").startswith("File too large"), "size").otherwise(F.col("error"))
    return df.select("file_id", error.alias("error"))


@query("""
SELECT file_id, mime_type, CASE WHEN mime_type NOT IN ('application/pdf', 'image/png', 'image/jpeg', 'image/jpg',
    'image/tiff', 'image/bmp')
  THEN 'Invalid file type: ' || mime_type || '. Allowed types: PDF, PNG, JPEG, TIFF, BMP' END AS error
FROM (SELECT file_id, coalesce(content_type, CASE lower(regexp_extract(filename, '\\.[^.]*$'))
  WHEN '.pdf' THEN 'application/pdf' WHEN '.png' THEN 'image/png' WHEN '.jpeg' THEN 'image/jpeg' END,
  'application/octet-stream') AS mime_type FROM v_files)""")
def mime_validity(spark, sf_dir):
    """F11, X23."""
    return oc.mime_errors(s.files(spark, sf_dir)).select("file_id", "mime_type", "error")


@query("""
SELECT file_id, filename || ': Not a PDF file (type: ' || coalesce(content_type,
  CASE lower(regexp_extract(filename, '\\.[^.]*$')) WHEN '.png' THEN 'image/png' WHEN '.jpeg' THEN 'image/jpeg' END,
  'unknown') || ')' AS error FROM v_files WHERE NOT filename LIKE '%.pdf'""")
def pdf_batch_errors(spark, sf_dir):
    """F12."""
    return oc.pdf_batch_errors(s.files(spark, sf_dir)).select("file_id", "error")


@query("""
SELECT job_id, array_to_string(list_filter([
  CASE WHEN dpi NOT BETWEEN 72 AND 600 THEN 'dpi must be between 72 and 600' END,
  CASE WHEN method NOT IN ('auto', 'extract', 'ocr', 'hybrid') THEN 'method must be auto, extract, ocr or hybrid' END,
  CASE WHEN start_page < 1 THEN 'start_page must be at least 1' END,
  CASE WHEN end_page < start_page THEN 'end_page must not be before start_page' END], lambda x: x IS NOT NULL), '; ') AS errors
FROM (SELECT job_id, dpi * 2 - 150 AS dpi, CASE WHEN output_format = 'text' THEN 'scan' ELSE method END AS method,
  CAST(file_id % 5 AS INTEGER) AS start_page, CAST(user_id % 7 AS INTEGER) AS end_page FROM v_jobs)""")
def option_validity(spark, sf_dir):
    """F13."""
    options = s.jobs(spark, sf_dir).select(
        "job_id",
        (F.col("dpi") * 2 - 150).alias("dpi"),
        F.when(F.col("output_format") == "text", "scan").otherwise(F.col("method")).alias("method"),
        (F.col("file_id") % 5).cast("int").alias("start_page"),
        (F.col("user_id") % 7).cast("int").alias("end_page"),
    )
    return oc.option_errors(options).select("job_id", F.array_join("errors", "; ").alias("errors"))


# Relations


@query("""
SELECT job_id, page_num, completed_at FROM v_pages WHERE job_id IN (SELECT job_id FROM v_jobs WHERE user_id = 42)""")
def pages_of_user(spark, sf_dir):
    """J3."""
    # The user's page writes alone are upserted: a write of another job changes no page of theirs. Their jobs are written first, so that
    # Spark knows how many they are and shuffles the page writes only if they are too many to broadcast.
    path = scratch_dir(spark, "jobs-of-user")
    s.jobs(spark, sf_dir).where("user_id = 42").select("job_id", "user_id").write.parquet(path)
    changes = oc.rows_for_user(s.page_changes(spark, sf_dir), spark.read.parquet(path), 42)
    pages = om.upsert(None, changes, ["job_id", "page_num"], F.col("version"), s.PAGE_COLUMNS)
    return pages.select("job_id", "page_num", "completed_at")


def _directories(spark, sf_dir):
    """Files grouped by their length class; only some groups hold PDFs alone."""
    grouped = s.files(spark, sf_dir).withColumn(
        "folder", F.concat_ws("-", "user_id", F.floor(F.col("size_bytes") / 500))
    )
    return grouped, *oc.ingest_directories(grouped, "folder", NOW)


_GROUPED = "(SELECT *, user_id || '-' || CAST(size_bytes // 500 AS VARCHAR) AS folder FROM v_files)"
_GOOD = f"""(SELECT * FROM {_GROUPED} WHERE folder NOT IN (
  SELECT folder FROM {_GROUPED} WHERE NOT filename LIKE '%.pdf'))"""


@query(f"""
SELECT folder AS directory_id, folder AS name, CAST(sum(size_bytes) AS BIGINT) AS total_size, count(*) AS file_count,
  TIMESTAMP '2024-01-01 12:00:00' AS uploaded_at FROM {_GOOD} GROUP BY 1""")
def ingested_directories(spark, sf_dir):
    """Directories that passed."""
    _, directories, _ = _directories(spark, sf_dir)
    return directories


@query(f"""
SELECT folder AS directory_id, file_id, row_number() OVER (PARTITION BY folder ORDER BY file_id) AS sequence_num
FROM {_GOOD}""")
def ingested_directory_files(spark, sf_dir):
    """Their numbered files."""
    _, _, numbered = _directories(spark, sf_dir)
    return numbered


@query(f"""
SELECT directory_id, directory_id AS name, sequence_num, file_id, filename, size_bytes FROM (
  SELECT folder AS directory_id, row_number() OVER (PARTITION BY folder ORDER BY file_id) AS sequence_num, *
  FROM {_GOOD}) WHERE deleted_at IS NULL AND NOT TIMESTAMP '2024-01-01 12:00:00' > expires_at""")
def directory_listing(spark, sf_dir):
    """J4."""
    grouped, directories, numbered = _directories(spark, sf_dir)
    live = grouped.drop("folder")
    return oc.directory_listing(directories.select("directory_id", "name"), numbered, live, NOW)


@query("SELECT user_id, count(*) AS file_count, CAST(sum(size_bytes) AS BIGINT) AS total_size FROM v_files GROUP BY 1")
def directory_totals(spark, sf_dir):
    """A25."""
    return oc.directory_totals(s.files(spark, sf_dir), "user_id")


@query("""
SELECT count(*) FILTER (kind = 'upload') AS uploads_deleted, count(*) FILTER (kind = 'cache') AS caches_deleted,
  CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes_freed FROM (
  SELECT 'upload' AS kind, size_bytes FROM v_files
    WHERE expires_at < TIMESTAMP '2024-01-01 12:00:00' AND deleted_at IS NULL
  UNION ALL SELECT 'cache', length(text) FROM v_lines JOIN v_files ON file_id = job_id
    WHERE uploaded_at < TIMESTAMP '2024-01-01 10:00:00')""")
def cleanup_totals(spark, sf_dir):
    """A24 over F4 and U8 victims."""
    files = s.files(spark, sf_dir)
    uploads = oc.expired_files(files, NOW).select(F.lit("upload").alias("kind"), "size_bytes")
    cached = s.document_pages(spark, sf_dir).select(
        F.col("job_id").alias("file_id"), F.length("text").cast("bigint").alias("cached_size")
    )
    caches = (
        om.older_than(files, NOW, 2, modified="uploaded_at")
        .join(cached, "file_id")
        .select(F.lit("cache").alias("kind"), F.col("cached_size").alias("size_bytes"))
    )
    return oc.cleanup_stats(uploads.unionByName(caches))


@query("""
SELECT b.batch_job_id, b.status, b.created_at, b.total_documents, j.job_id, j.file_id, j.status AS job_status,
  j.progress_pct FROM v_batches b JOIN v_jobs j ON j.parent_batch_id = b.batch_job_id""")
def batch_documents(spark, sf_dir):
    """J5."""
    return oj.batch_documents(s.batches(spark, sf_dir), s.jobs(spark, sf_dir))


@query("""
SELECT j.job_id, j.file_id, f.filename, f.size_bytes, CASE lower(regexp_extract(filename, '\\.[^.]*$'))
  WHEN '.pdf' THEN 'application/pdf' WHEN '.png' THEN 'image/png' WHEN '.jpeg' THEN 'image/jpeg'
  ELSE 'application/octet-stream' END AS media_type,
  regexp_replace(f.filename, '\\.[^.]*$', '') || '.' || j.output_format AS download_name,
  CASE j.output_format WHEN 'markdown' THEN 'text/markdown' ELSE 'text/plain' END AS result_type
FROM v_jobs j JOIN v_files f USING (file_id)""")
def original_files(spark, sf_dir):
    """J6, X11."""
    df = oc.job_files(s.jobs(spark, sf_dir), s.files(spark, sf_dir))
    return df.select(
        "job_id",
        "file_id",
        "filename",
        "size_bytes",
        "media_type",
        ff.download_name(F.col("filename"), F.col("output_format")).alias("download_name"),
        ff.format_media_type(F.col("output_format")).alias("result_type"),
    )


_VERSIONS = """
(SELECT job_id, user_id, file_id, created_at,
  row_number() OVER (PARTITION BY user_id, file_id ORDER BY created_at, job_id) AS version_number,
  lag(job_id) OVER (PARTITION BY user_id, file_id ORDER BY created_at, job_id) AS parent_job_id,
  first_value(job_id) OVER (PARTITION BY user_id, file_id ORDER BY created_at, job_id) AS root
 FROM (SELECT job_id, user_id // 50 AS user_id, file_id, created_at FROM v_jobs))"""


def _versions(spark, sf_dir):
    jobs = s.jobs(spark, sf_dir).select(
        "job_id", F.floor(F.col("user_id") / 50).alias("user_id"), "file_id", "created_at"
    )
    return oc.numbered_versions(jobs)


@query(f"SELECT job_id, user_id, file_id, created_at, version_number, parent_job_id FROM {_VERSIONS}")
def job_versions(spark, sf_dir):
    """J9 input: version chains."""
    return _versions(spark, sf_dir)


@query(f"""
WITH RECURSIVE v AS (SELECT * FROM {_VERSIONS} WHERE NOT (version_number = 1 AND job_id % 5 = 0)),
t AS (SELECT job_id AS root_job_id, job_id, 0::BIGINT AS depth FROM v
    WHERE parent_job_id IS NULL OR parent_job_id NOT IN (SELECT job_id FROM v)
  UNION ALL SELECT root_job_id, v.job_id, depth + 1 FROM t JOIN v ON v.parent_job_id = t.job_id)
SELECT root_job_id, job_id, depth FROM t""")
def job_lineage(spark, sf_dir):
    """J9; every fifth first version is gone, so its successor is a root."""
    versions = _versions(spark, sf_dir)
    return oc.job_lineage(versions.where(~((F.col("version_number") == 1) & (F.col("job_id") % 5 == 0))))


@query(f"""
SELECT file_id, job_id, user_id, created_at, version_number, parent_job_id FROM (
  SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY version_number DESC, job_id DESC) AS rn FROM {_VERSIONS})
WHERE rn = 1""")
def latest_versions(spark, sf_dir):
    """W10."""
    return oc.latest_version(_versions(spark, sf_dir))


def _cascade(spark, sf_dir):
    """Removes inactive users and everything that hangs on them."""
    jobs, users = s.jobs(spark, sf_dir), s.users(spark, sf_dir)
    tables = {
        "users": users,
        "files": s.files(spark, sf_dir).withColumn("user_id", F.col("file_id") % 97 + 1),
        "batches": s.batches(spark, sf_dir).withColumn("user_id", F.col("batch_job_id")),
        "jobs": jobs,
        "pages": s.page_changes(spark, sf_dir).select("job_id", "page_num").distinct(),
        "events": s.log(spark, sf_dir).select("event_id", "job_id"),
    }
    return oc.cascade_delete(tables, users.where(~F.col("is_active")))


_GONE = """
(SELECT job_id FROM v_jobs WHERE user_id IN (SELECT user_id FROM v_users WHERE NOT is_active)
  OR file_id % 97 + 1 IN (SELECT user_id FROM v_users WHERE NOT is_active))"""


@query(f"""
SELECT 'users' AS entity, count(*) AS remaining FROM v_users WHERE is_active
UNION ALL SELECT 'batches', count(*) FROM v_batches JOIN v_users ON user_id = batch_job_id WHERE is_active
UNION ALL SELECT 'files', count(*) FROM v_files WHERE file_id % 97 + 1 NOT IN (SELECT user_id FROM v_users WHERE NOT is_active)
UNION ALL SELECT 'jobs', count(*) FROM v_jobs WHERE job_id NOT IN {_GONE}
UNION ALL SELECT 'pages', count(*) FROM v_pages WHERE job_id NOT IN {_GONE}
UNION ALL SELECT 'events', count(*) FROM v_log WHERE job_id IS NULL OR job_id NOT IN {_GONE}""")
def cascade_remaining(spark, sf_dir):
    """Rows left per table; events of jobs that never were stay."""
    left = _cascade(spark, sf_dir)
    counts = [
        left[t].agg(F.lit(t).alias("entity"), F.count(F.lit(1)).alias("remaining"))
        for t in ("users", "files", "batches", "jobs", "pages", "events")
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query(f"SELECT job_id, page_num FROM v_pages WHERE job_id NOT IN {_GONE}")
def cascade_pages(spark, sf_dir):
    """The pages left."""
    return _cascade(spark, sf_dir)["pages"]


# Roll-ups


@query("""
SELECT job_id, method, count(*) AS pages, sum(processing_time) AS total_time, round(avg(processing_time), 6) AS avg_time
FROM v_pages GROUP BY 1, 2""")
def method_summary(spark, sf_dir):
    """A1."""
    return oj.method_summary(s.page_results(spark, sf_dir)).withColumn("avg_time", F.round("avg_time", 6))


@query("""
SELECT job_id, CASE WHEN is_done THEN 'merge' ELSE 'ocr' END AS stage, count(*) AS pages,
  sum(processing_time) AS total_time, round(avg(processing_time), 6) AS avg_page_time, max(method) AS model
FROM v_pages GROUP BY 1, 2""")
def stage_summary(spark, sf_dir):
    """A2."""
    pages = s.page_results(spark, sf_dir).select(
        "job_id",
        "page_num",
        "processing_time",
        F.when(F.col("is_done"), "merge").otherwise("ocr").alias("stage"),
        F.col("method").alias("model"),
    )
    return oj.stage_summary(pages).withColumn("avg_page_time", F.round("avg_page_time", 6))


@query("""
SELECT parent_batch_id, total, completed, failed,
  CASE WHEN cancelled THEN 'cancelled' WHEN completed = total THEN 'completed' WHEN completed = 0 THEN 'failed'
    ELSE 'completed' END AS status,
  NOT cancelled AND completed > 0 AND completed < total AS is_partial,
  CASE WHEN NOT cancelled AND completed = 0 THEN failed || ' of ' || total || ' documents failed' END AS error_message
FROM (SELECT parent_batch_id, count(*) AS total, count(*) FILTER (status = 'completed') AS completed,
  count(*) FILTER (status = 'failed') AS failed,
  parent_batch_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AS cancelled FROM v_jobs GROUP BY 1)""")
def batch_status(spark, sf_dir):
    """A3; batches of customers in debt count as cancelled."""
    cancelled = s.table(spark, sf_dir, "customer").where("c_acctbal < 0").select(
        F.col("c_custkey").alias("parent_batch_id")
    )
    return oj.batch_status(s.jobs(spark, sf_dir), cancelled)


@query("""
SELECT parent_batch_id, count(*) FILTER (status = 'completed') AS documents_completed, count(*) AS total_documents,
  round(sum(CASE status WHEN 'completed' THEN 1.0::DOUBLE WHEN 'processing' THEN progress_pct / 100 ELSE 0 END)
    / count(*) * 100, 6) AS overall_progress_pct FROM v_jobs GROUP BY 1""")
def batch_progress(spark, sf_dir):
    """A4."""
    df = oj.batch_progress(s.jobs(spark, sf_dir))
    return df.withColumn("overall_progress_pct", F.round("overall_progress_pct", 6))


@query("SELECT parent_batch_id, count(*) FILTER (status = 'processing') AS active_files FROM v_jobs GROUP BY 1")
def active_jobs(spark, sf_dir):
    """A5."""
    return oj.active_jobs(s.jobs(spark, sf_dir))


@query("""
SELECT parent_batch_id, greatest(0, count(*) - count(*) FILTER (status = 'completed')
  - count(*) FILTER (status = 'processing')) AS failed_files, count(*) FILTER (status = 'failed') AS truly_failed
FROM v_jobs GROUP BY 1""")
def batch_failures(spark, sf_dir):
    """A6."""
    return oj.batch_failures(s.jobs(spark, sf_dir))


@query("""
SELECT count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'processing') AS processing,
  count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed,
  count(*) FILTER (status = 'cancelled') AS cancelled FROM v_jobs""")
def queue_stats(spark, sf_dir):
    """A7."""
    return oj.queue_stats(s.jobs(spark, sf_dir))


@query("""
SELECT parent_batch_id, count(*) AS total_documents, count(*) FILTER (status = 'completed') AS documents_completed,
  count(*) FILTER (status <> 'completed') AS documents_failed,
  coalesce(epoch_us(max(completed_at)) - epoch_us(min(started_at)), 0) / 1e6::DOUBLE AS overall_processing_time_seconds
FROM v_jobs GROUP BY 1""")
def batch_stats(spark, sf_dir):
    """A8."""
    return oj.batch_stats(s.jobs(spark, sf_dir))


@query("""
SELECT parent_batch_id, (rn - 1) // 8 AS list_no, string_agg(job_id || ' ' || filename || ' ' || status || ' '
  || coalesce(error_message, '-'), '; ' ORDER BY job_id) AS results FROM (
  SELECT *, row_number() OVER (PARTITION BY parent_batch_id ORDER BY job_id) AS rn
  FROM v_jobs JOIN v_files USING (file_id) WHERE status IN ('completed', 'failed')) GROUP BY 1, 2""")
def batch_results(spark, sf_dir):
    """A9 with lists of 8; lists are flattened to text for comparison."""
    jobs = oc.job_files(s.jobs(spark, sf_dir), s.files(spark, sf_dir))
    df = oj.batch_results(jobs, list_size=8)
    shown = F.transform(
        "results",
        lambda r: F.concat_ws(" ", r["job_id"], r["filename"], r["status"], F.coalesce(r["error"], F.lit("-"))),
    )
    return df.withColumn("results", F.array_join(shown, "; "))


@query("""
SELECT parent_batch_id, job_id, filename, status, 0::BIGINT AS part, CASE status WHEN 'completed' THEN d.text END AS content,
  CASE status WHEN 'failed' THEN error_message END AS error
FROM v_jobs JOIN v_files USING (file_id) JOIN documents d ON d.doc_id = file_id
WHERE status IN ('completed', 'failed')""")
def batch_result_contents(spark, sf_dir):
    """A9 row form with contents."""
    jobs = oc.job_files(s.jobs(spark, sf_dir), s.files(spark, sf_dir))
    texts = s.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_id"), F.lit(0).cast("bigint").alias("part"), F.col("text").alias("content")
    )
    return oj.finished_documents(jobs, texts, on="file_id")


@query("""
SELECT parent_batch_id, filename, count(*) AS results, count(*) FILTER (status = 'completed') AS completed
FROM v_jobs JOIN v_files USING (file_id) WHERE status IN ('completed', 'failed') GROUP BY 1, 2""")
def results_by_filename(spark, sf_dir):
    """A9 grouped by file name."""
    jobs = oc.job_files(s.jobs(spark, sf_dir), s.files(spark, sf_dir))
    return oj.group_by_filename(jobs.where(F.col("status").isin("completed", "failed")))


@query("""
SELECT j.job_id, d.part, j.output_format AS format, d.content, t.total_pages,
  coalesce((epoch_us(completed_at) - epoch_us(started_at)) / 1e6::DOUBLE, 0.0::DOUBLE) AS processing_time_seconds,
  j.model AS model_used, coalesce(j.dpi, 300) AS dpi, coalesce(j.method, 'auto') AS method,
  '/api/v1/process/jobs/' || j.job_id || '/original' AS original_file_url
FROM v_jobs j JOIN (SELECT job_id, count(*) AS total_pages FROM v_pages GROUP BY 1) t USING (job_id)
JOIN (SELECT job_id, CAST((page_num - 1) // 4 AS BIGINT) AS part, string_agg('<!-- Page ' || page_num || ' | Method: ' || upper(method)
  || ' | Time: ' || printf('%.2f', processing_time) || 's | Chars: ' || length(coalesce(ocr_text, '')) || ' -->' || chr(10)
  || coalesce(ocr_text, '') || chr(10) || chr(10), '' ORDER BY page_num) AS content FROM v_pages GROUP BY 1, 2) d USING (job_id)
WHERE j.status = 'completed'""")
def job_results(spark, sf_dir):
    """A10 on documents of 4-page parts."""
    pages = s.page_results(spark, sf_dir).select(
        "job_id", "page_num", "method", "processing_time", F.col("ocr_text").alias("text")
    )
    docs = od.assemble_documents(pages, pages_per_part=4)
    return oj.job_result(s.jobs(spark, sf_dir), docs, s.page_changes(spark, sf_dir).where("page_num IS NOT NULL"))


@query("""
SELECT job_id, status, CASE WHEN status = 'processing' AND progress_pct > 0 THEN CAST(trunc(
  e / (progress_pct / 100.0::DOUBLE) - e) AS BIGINT) END AS estimated_remaining_seconds
FROM (SELECT *, (epoch_us(TIMESTAMP '2001-08-02') - epoch_us(started_at)) / 1e6::DOUBLE AS e FROM v_jobs)""")
def job_eta(spark, sf_dir):
    """X16."""
    return oj.with_eta(s.jobs(spark, sf_dir), JOBS_NOW).select("job_id", "status", "estimated_remaining_seconds")


@query("""
SELECT job_id, coalesce((epoch_us(completed_at) - epoch_us(started_at)) / 1e6::DOUBLE, 0.0::DOUBLE) AS seconds FROM v_jobs""")
def job_elapsed(spark, sf_dir):
    """X17."""
    return s.jobs(spark, sf_dir).select(
        "job_id", fp.elapsed_seconds(F.col("started_at"), F.col("completed_at")).alias("seconds")
    )


_EVICTED = """
SELECT batch_job_id FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, batch_job_id DESC) AS rn FROM v_batches)
WHERE rn > 50 AND status IN ('completed', 'failed', 'cancelled')"""


@query(f"SELECT * FROM v_batches WHERE batch_job_id IN ({_EVICTED})")
def evicted_batches(spark, sf_dir):
    """W5."""
    _, evicted = oj.evict_old_batches(s.batches(spark, sf_dir), keep=50)
    return evicted


@query(f"SELECT * FROM v_batches WHERE batch_job_id NOT IN ({_EVICTED})")
def remaining_batches(spark, sf_dir):
    """W5."""
    remaining, _ = oj.evict_old_batches(s.batches(spark, sf_dir), keep=50)
    return remaining


@query("""
SELECT job_id, CASE WHEN model = 'qwen3-vl-8b' THEN 'qwen3-vl-8b' ELSE 'qwen3-vl-4b' END AS merge_model FROM v_jobs""")
def chosen_models(spark, sf_dir):
    """M9."""
    return oj.choose_model(s.jobs(spark, sf_dir), F.col("model") == "qwen3-vl-8b").select("job_id", "merge_model")


@query("""
SELECT job_id, CASE job_id % 7 WHEN 0 THEN 'qwen3-vl-8b' WHEN 1 THEN 'qwen3-vl-4b' WHEN 2 THEN 'qwen3-vl-2b' WHEN 3 THEN 'deepseek-ocr'
  WHEN 4 THEN 'deepseek-ocr' ELSE CASE WHEN model = 'qwen3-vl-8b' THEN 'qwen3-vl-8b' ELSE 'qwen3-vl-4b' END END AS merge_model FROM v_jobs""")
def strategy_models(spark, sf_dir):
    """M9 by named strategy; unknown names and none fall back on the preference."""
    names = [*oj.STRATEGIES, "no such strategy"]
    strategy = F.get(F.array(*[F.lit(n) for n in names]), (F.col("job_id") % 7).cast("int"))
    return oj.choose_model(s.jobs(spark, sf_dir), F.col("model") == "qwen3-vl-8b", strategy).select("job_id", "merge_model")


# Mutations


@query("""
SELECT job_id, user_id, parent_batch_id, file_id, CASE WHEN status = 'queued' THEN 'processing' ELSE status END AS status,
  created_at, CASE WHEN status = 'queued' THEN TIMESTAMP '2001-08-02' ELSE started_at END AS started_at, completed_at,
  CASE WHEN status = 'queued' THEN 1.5::DOUBLE ELSE progress_pct END AS progress_pct, error_message, model, output_format,
  dpi, method FROM v_jobs""")
def started_jobs(spark, sf_dir):
    """U4: queued jobs start."""
    jobs = s.jobs(spark, sf_dir)
    changes = jobs.where("status = 'queued'").select(
        "job_id",
        F.lit("processing").alias("status"),
        moment(JOBS_NOW).alias("started_at"),
        F.lit(1.5).alias("progress_pct"),
        F.lit(None).cast("string").alias("model"),
    )
    return om.partial_update(jobs, changes, "job_id")


@query("""
SELECT * REPLACE (CASE WHEN user_id IN ('src1', 'src2') THEN TIMESTAMP '2024-01-01 12:00:00' ELSE deleted_at END AS deleted_at)
FROM v_files""")
def soft_deleted_files(spark, sf_dir):
    """U5."""
    files = s.files(spark, sf_dir)
    return om.soft_delete(files, files.where(F.col("user_id").isin("src1", "src2")).select("file_id"), NOW)


@query("SELECT * FROM v_jobs WHERE status <> 'failed'")
def deleted_jobs(spark, sf_dir):
    """Rows left."""
    jobs = s.jobs(spark, sf_dir)
    rest, _ = om.delete_rows(jobs, jobs.where("status = 'failed'").select("job_id"))
    return rest


@query("SELECT count(*) AS deleted FROM v_jobs WHERE status = 'failed'")
def deleted_job_count(spark, sf_dir):
    """Number of rows that matched."""
    jobs = s.jobs(spark, sf_dir)
    _, n = om.delete_rows(jobs, jobs.where("status = 'failed'").select("job_id"))
    return n


@query("""
SELECT user_id, email, is_active FROM v_users UNION ALL
SELECT o_custkey + 1000 AS user_id, min('new user'), true FROM orders
WHERE o_custkey + 1000 NOT IN (SELECT user_id FROM v_users) GROUP BY 1""")
def inserted_users(spark, sf_dir):
    """U7."""
    rows = s.table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") + 1000).alias("user_id"), F.lit("new user").alias("email"), F.lit(True).alias("is_active")
    )
    return om.insert_absent(s.users(spark, sf_dir), rows, "user_id")


@query("""
SELECT event_id, timestamp FROM v_log WHERE timestamp < TIMESTAMP '2024-01-20' - INTERVAL 24 HOUR""")
def old_events(spark, sf_dir):
    """U8."""
    log = s.log(spark, sf_dir).select("event_id", "timestamp")
    return om.older_than(log, datetime(2024, 1, 20), 24, modified="timestamp")


# Formats


@query("""
SELECT file_id, CASE WHEN size_bytes < 1024 THEN size_bytes || ' B'
  ELSE regexp_replace(printf('%.2f', round(size_bytes / 1024.0::DOUBLE, 2)), '\\.?0+$', '') || ' KB' END AS size_label,
  CASE WHEN length(filename) <= 10 THEN filename ELSE left(filename, 7) || '...' END AS short_name,
  CASE WHEN size_bytes < 60 THEN size_bytes || '.0s' WHEN size_bytes < 3600 THEN (size_bytes // 60) || 'm ' || (size_bytes % 60) || 's'
    ELSE (size_bytes // 3600) || 'h ' || (size_bytes // 60 % 60) || 'm' END AS duration_label
FROM v_files""")
def display_labels(spark, sf_dir):
    """X18."""
    size = F.col("size_bytes")
    kb = F.when(size >= 1024, F.round(size / 1024, 2) * 1024).otherwise(size)
    return (
        s.files(spark, sf_dir)
        .select(
            "file_id",
            ft.format_bytes(kb).alias("size_label"),
            ft.truncate(F.col("filename"), 10).alias("short_name"),
            ft.format_duration(size).alias("duration_label"),
        )
    )


@query("""
SELECT parent_batch_id, CASE status WHEN 'processing' THEN 'Processing (' || done || '/' || total || ')'
  WHEN 'completed' THEN 'Completed' ELSE 'Failed' END AS label FROM (
  SELECT b.batch_job_id AS parent_batch_id, b.status, count(*) FILTER (j.status = 'completed') AS done, count(*) AS total
  FROM v_batches b JOIN v_jobs j ON j.parent_batch_id = b.batch_job_id GROUP BY 1, 2)""")
def batch_labels(spark, sf_dir):
    """X18 batch status label."""
    done = oj.batch_progress(s.jobs(spark, sf_dir)).withColumnRenamed("parent_batch_id", "batch_job_id")
    label = ft.batch_status_label(F.col("status"), F.col("documents_completed"), F.col("total_documents"))
    return (
        s.batches(spark, sf_dir)
        .drop("total_documents")
        .join(done, "batch_job_id")
        .select(F.col("batch_job_id").alias("parent_batch_id"), label.alias("label"))
    )


@query("""
SELECT file_id, CASE WHEN filename LIKE '%.md' THEN 'markdown' ELSE 'text' END AS implied,
  CASE WHEN lang_format <> CASE WHEN filename LIKE '%.md' THEN 'markdown' ELSE 'text' END THEN
    'Format ''' || lang_format || ''' conflicts with output extension ''' || regexp_extract(filename, '\\.[^.]*$')
    || '''. Expected extension ''' || CASE lang_format WHEN 'markdown' THEN '.md' ELSE '.txt' END
    || ''' for format ''' || lang_format || '''.' END AS error
FROM (SELECT file_id, 'out_' || file_id || CASE WHEN size_bytes < 1500 THEN '.md' ELSE '.txt' END AS filename,
  CASE WHEN content_type IS NULL THEN 'markdown' ELSE 'text' END AS lang_format FROM v_files)""")
def format_mismatches(spark, sf_dir):
    """X10."""
    rows = s.files(spark, sf_dir).select(
        "file_id",
        F.concat(F.lit("out_"), "file_id", F.when(F.col("size_bytes") < 1500, ".md").otherwise(".txt")).alias("path"),
        F.when(F.col("content_type").isNull(), "markdown").otherwise("text").alias("fmt"),
    )
    return rows.select(
        "file_id",
        ff.format_of_path(F.col("path")).alias("implied"),
        ff.format_mismatch(F.col("fmt"), F.col("path")).alias("error"),
    )
