"""The monitoring log as JSON lines."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.times import moment
from pagemill.operators.monitoring import dashboard_averages
from pagemill.schemas import METRICS_LOG

LOG_SUFFIX = r"([^/]*)\.syslog\.jsonl$"


def _parsed(spark: SparkSession, path: str) -> DataFrame:
    schema = f"{METRICS_LOG}, _bad string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(
        F.from_json("value", schema, options).alias("m"),
        F.regexp_extract(F.col("_metadata.file_name"), LOG_SUFFIX, 1).alias("__file_job"),
    )


def _job_id() -> Column:
    return F.coalesce(F.col("m.job_id"), F.when(F.col("__file_job") != "", F.col("__file_job")))


def read_metrics_log(spark: SparkSession, path: str) -> DataFrame:
    """Log rows; blank and broken lines are dropped. A missing job id comes from the file name."""
    good = _parsed(spark, path).where(F.col("m").isNotNull() & F.col("m._bad").isNull())
    return good.select("m.*", _job_id().alias("__job")).withColumn("job_id", F.col("__job")).drop("__job", "_bad")


def metrics_log_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Number of non-blank lines that are no JSON record."""
    bad = F.col("m").isNull() | F.col("m._bad").isNotNull()
    return _parsed(spark, path).agg(F.count_if(bad).alias("rejects"))


def write_metrics_log(df: DataFrame, path: str) -> None:
    """Appends JSON lines."""
    df.write.mode("append").json(path)


def export_metrics(history: DataFrame, alerts: DataFrame, now: datetime) -> DataFrame:
    """The export as JSON lines of (kind, json).

    One ``summary`` row with the export time and averages, then a row per
    sample and per alert: a file of any length that no task holds whole.
    """
    summary = dashboard_averages(history).select(
        F.lit("summary").alias("kind"),
        F.to_json(F.struct(moment(now).alias("timestamp"), F.struct("*").alias("summary"))).alias("json"),
    )
    samples = history.select(F.lit("history").alias("kind"), F.to_json(F.struct("*")).alias("json"))
    warnings = alerts.select(F.lit("alert").alias("kind"), F.to_json(F.struct("*")).alias("json"))
    return summary.unionByName(samples).unionByName(warnings)
