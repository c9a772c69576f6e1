"""Reports from merged daily partials equal those of a scan."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pagemill.operators import monitoring as om
from pagemill.operators import rollups as ro

DDL = "event_id int, job_id int, timestamp timestamp_ntz, event_type string, stage string, gpu_id int, cpu_percent double, ram_percent double, page_duration_s double"


def rows(n):
    rnd = random.Random(n)
    return [
        (k, rnd.randrange(50), rnd.choice([None, datetime(2024, 1, 1) + timedelta(hours=rnd.randrange(200))]), rnd.choice(["metric", "error", None]),
         rnd.choice(["ocr", "merge", None]), rnd.choice([0, 1, 2, None]), rnd.choice([None, rnd.randrange(10**6) / 1000]), rnd.random() * 100,
         rnd.choice([None, 0.1, 0.2, 0.3]))
        for k in range(n)
    ]


def test_merged_partials_equal_the_scan(spark, tmp_path):
    log = spark.createDataFrame(rows(3000), DDL).repartition(7)
    path = str(tmp_path / "r")
    first = F.coalesce(F.col("timestamp") < F.lit("2024-01-04").cast("timestamp_ntz"), F.lit(False))
    ro.write_rollup(log.where(first).limit(0), path)
    ro.write_rollup(log.where(first), path)
    ro.write_rollup(log.where(~first), path)
    ro.write_rollup(log.where(first), path)  # a run repeated replaces its days
    partials = ro.read_rollup(spark, path)
    assert partials.count() < 500
    assert ro.time_range(partials).first() == om.metrics_time_range(log).first()
    want, got = om.dashboard_averages(log).first(), ro.averages(partials).first()
    assert got[:3] == tuple(want) and abs(got.about_jobs - 50) <= 2
    asked = log.select(
        F.coalesce("stage", F.lit("other")).alias("model"), F.coalesce(F.col("event_type") == "error", F.lit(False)).alias("is_error"),
        F.col("page_duration_s").alias("elapsed_s"),
    )
    plain = lambda df: sorted((r.model, r.request_count, r.error_count, round(r.avg_time, 9)) for r in df.collect())
    assert plain(ro.telemetry(partials)) == plain(om.request_telemetry(asked))


def test_no_rows(spark, tmp_path):
    log = spark.createDataFrame([], DDL)
    partials = ro.daily_rollup(log)
    assert ro.time_range(partials).first() == om.metrics_time_range(log).first()
    assert ro.averages(partials).first()[:3] == (0, None, None) and ro.telemetry(partials).count() == 0
