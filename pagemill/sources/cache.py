"""Stage results kept between the extract and the merge job.

One folder per run, not per job: a million jobs would mean a million folders
of tiny files. A run is written once and replaced whole when it is repeated;
of a page found in several runs the newest counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.mutations import latest_rows

KEYS = ["job_id", "page_num"]


def write_ocr_cache(df: DataFrame, path: str, run: int) -> None:
    """S3: stores one run. Repeating it replaces exactly that run."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/run={int(run)}")


def _runs(spark: SparkSession, path: str) -> list[int]:
    """The runs that the table at ``path`` holds."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/run=*")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    return [int(f.getPath().getName().removeprefix("run=")) for f in found]


def only_run(spark: SparkSession, path: str, run: int) -> bool:
    """True if the table at ``path`` holds this run and no other."""
    return _runs(spark, path) == [int(run)]


def last_run(spark: SparkSession, path: str, run: int) -> bool:
    """True if the table at ``path`` holds this run and no later one."""
    return max(_runs(spark, path), default=None) == int(run)


def read_ocr_cache(
    spark: SparkSession, path: str, job_ids: Sequence | DataFrame | None = None, before_run: int | None = None
) -> DataFrame:
    """S3: newest result of each page; given jobs are pushed to the scan as a filter or semi join.

    With ``before_run`` only earlier runs are read (a filter on folders), which is
    what a run may build on: its own results are replaced when it is repeated.
    """
    rows = spark.read.parquet(path)
    if before_run is not None:
        rows = rows.where(F.col("run") < before_run)
    if isinstance(job_ids, DataFrame):
        rows = rows.join(job_ids.select("job_id"), "job_id", "left_semi")
    elif job_ids is not None:
        rows = rows.where(F.col("job_id").isin(*job_ids))
    return latest_rows(rows, KEYS, ["run"]).drop("run")
