"""Daily roll-ups of the monitoring log that merge, so that reports do not read the log again.

A day's partials are counts, extremes, sums and a sketch per stage, device and outcome: a few rows, whatever the length of the log. Sums are kept as decimals,
whose addition has no rounding, so figures from merged partials equal those of a scan in any grouping of days. The distinct
number of jobs, which has no exact partial of fixed size, is estimated from the sketches.

Rows without a time belong to a day of their own (null). A day is written as a whole and replaced when it is written again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = "day"
KEYS = [DAY, "stage", "gpu_id", "is_error"]
_EXACT = "decimal(38,9)"


def _exact_sum(value: Column) -> Column:
    return F.sum(value.cast(_EXACT)).cast(_EXACT)


def daily_rollup(log: DataFrame) -> DataFrame:
    """One row per day, stage, device and outcome."""
    zero = F.lit(0.0)
    keyed = log.select(
        "*", F.col("timestamp").cast("date").alias(DAY), F.coalesce(F.col("event_type") == "error", F.lit(False)).alias("is_error")
    )
    return keyed.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("timestamp").alias("first"),
        F.max("timestamp").alias("last"),
        _exact_sum(F.coalesce("cpu_percent", zero)).alias("cpu_sum"),
        _exact_sum(F.coalesce("ram_percent", zero)).alias("ram_sum"),
        F.count("page_duration_s").alias("timed"),
        _exact_sum(F.col("page_duration_s")).alias("elapsed_sum"),
        F.hll_sketch_agg(F.col("job_id").cast("string")).alias("jobs"),
    )


def write_rollup(log: DataFrame, path: str) -> None:
    """Stores the partials of the days in ``log``, which has to hold these days whole; other days stay as they are."""
    partials = daily_rollup(log)
    partials.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _mean(total: str, n: str) -> Column:
    return F.try_divide(F.sum(total).cast("double"), F.sum(n))


def time_range(partials: DataFrame) -> DataFrame:
    """A18 from partials."""
    return partials.agg(
        F.min("first").alias("start"), F.max("last").alias("end"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("duration_seconds")
    )


def averages(partials: DataFrame) -> DataFrame:
    """A20 from partials, with the estimated number of jobs."""
    return partials.agg(
        F.count_distinct("gpu_id").alias("total_gpus"),
        F.round(_mean("cpu_sum", "n"), 1).alias("avg_cpu"),
        F.round(_mean("ram_sum", "n"), 1).alias("avg_ram"),
        F.hll_sketch_estimate(F.hll_union_agg("jobs")).alias("about_jobs"),
    )


def telemetry(partials: DataFrame) -> DataFrame:
    """A15 from partials, by stage."""
    ok = ~F.col("is_error")
    good = partials.withColumn("__timed", F.when(ok, F.col("timed"))).withColumn("__elapsed", F.when(ok, F.col("elapsed_sum")))
    return good.groupBy(F.coalesce("stage", F.lit("other")).alias("model")).agg(
        F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0)).cast("bigint").alias("request_count"),
        F.coalesce(F.sum(F.when(~ok, F.col("n"))), F.lit(0)).cast("bigint").alias("error_count"),
        F.coalesce(_mean("__elapsed", "__timed"), F.lit(0.0)).alias("avg_time"),
    )
