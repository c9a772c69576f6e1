"""File catalog and page sources."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import files as ff
from pagemill.functions.times import moment
from pagemill.schemas import PAGES


def register_files(spark: SparkSession, path: str, user_id: str, now: datetime, expiry_hours: int = 6) -> DataFrame:
    """Catalog rows of the files under ``path``. Contents are never read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    uploaded = moment(now)
    return listing.select(
        F.sha2("path", 256).alias("file_id"),
        F.lit(user_id).alias("user_id"),
        F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"),
        F.coalesce(ff.guess_mime(F.col("path")), F.lit(ff.DEFAULT_MIME)).alias("content_type"),
        F.col("length").alias("size_bytes"),
        F.col("path").alias("storage_path"),
        F.col("modificationTime").alias("modified_at"),
        uploaded.alias("uploaded_at"),
        ff.expires_at(uploaded, expiry_hours).alias("expires_at"),
    )


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The page table (embedded text and size per page) with its fixed schema."""
    return spark.read.format(fmt).schema(PAGES).load(path)


def append_job_events(df: DataFrame, path: str) -> None:
    """Appends audit events; existing ones are never rewritten."""
    df.write.mode("append").parquet(path)
