"""Catalog of users, files, directories and jobs."""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.times import moment
from pagemill.functions import files as ff
from pagemill.functions.layout import IMAGE_MODES
from pagemill.operators.blocked import fitted_block, id_block, previous, row_numbers, time_block, time_blocks
from pagemill.session import ensure_checkpoint_dir


# Point reads and lists. Every limit stands on a total order.


def first_rows(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


def get_by_id(df: DataFrame, col: str, value) -> DataFrame:
    """the row with this key, or none."""
    return df.where(F.col(col) == value).limit(1)


def list_all(df: DataFrame, filters: Mapping[str, object], limit: int | None = None, order: Sequence[str] | None = None) -> DataFrame:
    """rows equal to every given value, in key order (all columns unless named)."""
    matches = reduce(operator.and_, [F.col(c) == v for c, v in filters.items()], F.lit(True))
    return first_rows(df.where(matches).orderBy(*(order or df.columns)), limit)


def list_files_by_user(files: DataFrame, user_id, limit: int | None = None) -> DataFrame:
    """live files of a user, newest first."""
    live = (F.col("user_id") == user_id) & F.col("deleted_at").isNull()
    return first_rows(files.where(live).orderBy(F.desc("uploaded_at"), F.desc("file_id")), limit)


def expired_files(files: DataFrame, now: datetime) -> DataFrame:
    """F4 without a limit: live files strictly past their expiry."""
    return files.where((F.col("expires_at") < moment(now)) & F.col("deleted_at").isNull())


def list_expired_files(files: DataFrame, now: datetime, limit: int | None = None) -> DataFrame:
    """the longest expired first."""
    return first_rows(expired_files(files, now).orderBy("expires_at", "file_id"), limit)


def jobs_by_user(jobs: DataFrame, user_id, limit: int | None = None) -> DataFrame:
    """newest jobs of a user."""
    return first_rows(jobs.where(F.col("user_id") == user_id).orderBy(F.desc("created_at"), F.desc("job_id")), limit)


def batches_by_status(batches: DataFrame, status: str, limit: int | None = None) -> DataFrame:
    """newest batches in a status."""
    ordered = batches.where(F.col("status") == status).orderBy(F.desc("created_at"), F.desc("batch_job_id"))
    return first_rows(ordered, limit)


# Validation: each adds or returns error texts, never raises. The wording of these texts.


def image_errors(df: DataFrame, min_size: int = 32, max_size: int = 4096) -> DataFrame:
    """adds ``error`` for images of a wrong size or mode; null when fine."""
    w, h, mode = F.col("width"), F.col("height"), F.col("mode")
    size = F.format_string("%dx%d", w, h)
    modes = IMAGE_MODES
    error = (
        F.when(
            F.least(w, h) < min_size,
            F.concat(F.lit("Image too small: "), size, F.lit(f". Minimum size is {min_size}x{min_size}")),
        )
        .when(
            F.greatest(w, h) > max_size,
            F.concat(F.lit("Image too large: "), size, F.lit(f". Maximum size is {max_size}x{max_size}")),
        )
        .when(
            mode.isNull() | ~mode.isin(*modes),
            F.concat(F.lit("Unsupported image mode: "), F.coalesce(mode, F.lit("none")), F.lit(f". Allowed modes: {modes}")),
        )
    )
    return df.withColumn("error", error)


def file_errors(files: DataFrame, max_mb: float = 50, exts: Sequence[str] = ff.ALLOWED_EXTENSIONS) -> DataFrame:
    """adds ``error`` for files too large or of an unsupported extension."""
    mb = F.col("size_bytes") / (1024 * 1024)
    ext = ff.extension(F.col("filename"))
    error = F.when(
        mb > max_mb, F.format_string(f"File too large: %.1fMB. Maximum size is {max_mb:g}MB", mb)
    ).when(~ext.isin(*exts), F.concat(F.lit("Unsupported file type: "), ext))
    return files.withColumn("error", error)


def mime_errors(files: DataFrame) -> DataFrame:
    """adds the effective ``mime_type`` and an ``error`` when it is not accepted."""
    mime = ff.effective_mime(F.col("content_type"), F.col("filename"))
    message = F.concat(
        F.lit("Invalid file type: "), F.col("mime_type"), F.lit(". Allowed types: PDF, PNG, JPEG, TIFF, BMP")
    )
    return files.withColumn("mime_type", mime).withColumn(
        "error", F.when(~F.col("mime_type").isin(*ff.ALLOWED_MIME_TYPES), message)
    )


def pdf_batch_errors(files: DataFrame) -> DataFrame:
    """one row per file that is not a PDF by type nor by name, with its ``error``."""
    name = F.col("filename")
    stated = F.when(F.col("content_type") != "", F.col("content_type"))
    mime = F.coalesce(stated, ff.guess_mime(name))
    not_pdf = (F.coalesce(mime, F.lit("")) != "application/pdf") & ~F.lower(name).endswith(".pdf")
    error = F.when(name.isNull() | (name == ""), "File has no filename").when(
        not_pdf,
        F.concat(name, F.lit(": Not a PDF file (type: "), F.coalesce(mime, F.lit("unknown")), F.lit(")")),
    )
    return files.withColumn("error", error).where(F.col("error").isNotNull())


def option_errors(jobs: DataFrame) -> DataFrame:
    """adds ``errors``, an array of broken option rules; null options pass."""
    dpi, method = F.col("dpi"), F.col("method")
    start, end = F.col("start_page"), F.col("end_page")
    errors = F.array_compact(
        F.array(
            F.when(~dpi.between(72, 600), "dpi must be between 72 and 600"),
            F.when(~method.isin("auto", "extract", "ocr", "hybrid"), "method must be auto, extract, ocr or hybrid"),
            F.when(start < 1, "start_page must be at least 1"),
            F.when(end < start, "end_page must not be before start_page"),
        )
    )
    return jobs.withColumn("errors", errors)


# Relations.


def rows_for_user(rows: DataFrame, jobs: DataFrame, user_id) -> DataFrame:
    """Rows whose job belongs to the user. The join side is left to the size statistics."""
    mine = jobs.where(F.col("user_id") == user_id).select("job_id")
    return rows.join(mine, "job_id", "left_semi")


def directory_listing(dirs: DataFrame, junction: DataFrame, files: DataFrame, now: datetime) -> DataFrame:
    """Files of each directory in sequence order; deleted and expired ones are left out."""
    live = files.where(F.col("deleted_at").isNull() & ~ff.is_expired(F.col("expires_at"), moment(now)))
    return (
        dirs.join(junction, "directory_id")
        .join(live, "file_id")
        .select("directory_id", "name", "sequence_num", "file_id", "filename", "size_bytes")
        .orderBy("directory_id", "sequence_num")
    )


def job_files(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Each job with its original file and the type under which it is returned."""
    original = files.select(
        "file_id",
        "filename",
        "size_bytes",
        ff.original_media_type(F.col("filename")).alias("media_type"),
    )
    return jobs.join(original, "file_id")


def job_lineage(jobs: DataFrame) -> DataFrame:
    """(root_job_id, job_id, depth) of every version of a re-processed document.

    Parent links are followed by pointer doubling: each round doubles the steps
    taken. Rows that reached their root leave the join. A parent that is not in
    the table counts as none, so its child is a root. Rounds are cut by
    checkpoint(), which survives the loss of executors; this is the one operator
    here that runs jobs of its own. A chain longer than there are jobs is a cycle, which raises.
    """
    ensure_checkpoint_dir(jobs.sparkSession)
    known = jobs.select(F.col("job_id").alias("ptr"), F.lit(True).alias("__known")).distinct()
    links = jobs.select("job_id", F.col("parent_job_id").alias("ptr")).join(known, "ptr", "left")
    links = links.select("job_id", F.when(F.col("__known"), F.col("ptr")).alias("ptr"))
    hops = links.select(
        "job_id",
        F.coalesce("ptr", "job_id").alias("top"),
        F.col("ptr").isNotNull().cast("bigint").alias("depth"),
        F.col("ptr").isNull().alias("at_root"),
    ).checkpoint()
    steps, rows = 1, None
    while not hops.where(~F.col("at_root")).isEmpty():
        rows = hops.count() if rows is None else rows
        if steps > rows:
            raise ValueError("versions form a cycle")
        step = hops.select(
            F.col("job_id").alias("top"),
            F.col("top").alias("__top"),
            F.col("depth").alias("__depth"),
            F.col("at_root").alias("__root"),
        )
        moving = hops.where(~F.col("at_root")).join(step, "top")
        moved = moving.select(
            "job_id",
            F.col("__top").alias("top"),
            (F.col("depth") + F.col("__depth")).alias("depth"),
            F.col("__root").alias("at_root"),
        )
        hops = hops.where("at_root").unionByName(moved).checkpoint()
        steps *= 2
    return hops.select(F.col("top").alias("root_job_id"), "job_id", "depth")


def latest_version(jobs: DataFrame) -> DataFrame:
    """The newest version of a job per file."""
    rest = [c for c in jobs.columns if c != "file_id"]
    newest = F.max_by(F.struct(*rest), F.struct("version_number", "job_id"))
    return jobs.groupBy("file_id").agg(newest.alias("__job")).select("file_id", "__job.*")


def cascade_delete(tables: Mapping[str, DataFrame], removed_users: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows that hang on the removed users.

    users -> files, batches and jobs; files and batches -> jobs; jobs -> pages
    and events. Each level is one anti join on its own key, so a row whose
    parent was never in the tables stays.
    """
    users = removed_users.select("user_id")
    out = dict(tables)

    def minus(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
        return df.join(gone, key, "left_anti")

    gone_files = tables["files"].join(users, "user_id", "left_semi").select("file_id")
    gone_batches = None
    if "batches" in tables:
        gone_batches = tables["batches"].join(users, "user_id", "left_semi").select(
            F.col("batch_job_id").alias("parent_batch_id")
        )
        out["batches"] = minus(tables["batches"], users, "user_id")
    jobs = minus(minus(tables["jobs"], users, "user_id"), gone_files, "file_id")
    if gone_batches is not None:
        jobs = minus(jobs, gone_batches, "parent_batch_id")
    out["users"] = minus(tables["users"], users, "user_id")
    out["files"] = minus(tables["files"], users, "user_id")
    out["jobs"] = jobs
    gone_jobs = tables["jobs"].select("job_id").join(jobs.select("job_id"), "job_id", "left_anti")
    for child in ("pages", "events"):
        if child in tables:
            out[child] = minus(tables[child], gone_jobs, "job_id")
    return out


# Directories.


def ingest_directories(files: DataFrame, group: str, now: datetime) -> tuple[DataFrame, DataFrame]:
    """All-or-nothing ingest of groups of files.

    Groups with any file that fails the PDF check are left out whole. Returns
    the directories and their numbered files. Files are numbered by id; the
    numbering works per block of ids, so one huge group is no single task.
    """
    bad = pdf_batch_errors(files).select(group).distinct()
    good = files.join(bad, group, "left_anti").withColumnRenamed(group, "directory_id")
    directories = good.groupBy("directory_id").agg(
        F.sum("size_bytes").alias("total_size"),
        F.count(F.lit(1)).alias("file_count"),
        moment(now).alias("uploaded_at"),
    ).withColumn("name", F.col("directory_id"))
    numbered = row_numbers(
        good.select("directory_id", "file_id"),
        ["directory_id"],
        id_block(good, "file_id", ["directory_id"]),
        ["file_id"],
        "sequence_num",
    )
    return directories, numbered


def directory_totals(files: DataFrame, group: str) -> DataFrame:
    """Number and size of the files of each directory."""
    return files.groupBy(group).agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("size_bytes").alias("total_size")
    )


def cleanup_stats(victims: DataFrame) -> DataFrame:
    """One row with deleted uploads, deleted caches and bytes freed."""
    return victims.agg(
        F.count_if(F.col("kind") == "upload").alias("uploads_deleted"),
        F.count_if(F.col("kind") == "cache").alias("caches_deleted"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes_freed"),
    )


def numbered_versions(jobs: DataFrame) -> DataFrame:
    """Version chain of the jobs of one user and file, by creation time.

    Adds ``version_number`` and ``parent_job_id``.
    """
    keys, order = ["user_id", "file_id"], ["created_at", "job_id"]
    month = fitted_block(jobs, keys, [time_block("created_at", 30 * 86400), *time_blocks("created_at")])
    numbered = row_numbers(jobs, keys, month, order, "version_number")
    return previous(numbered, keys, month, order, "job_id", "parent_job_id")
