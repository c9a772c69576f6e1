"""Tables clustered by a key, for lookups that do not scan.

Rows are dealt into files by ranges of the key and sorted inside, so the least and greatest key of a row group bound what is in it; a bloom filter
on the key answers for keys that fall into a range but are not there. A filter on the key then reads the row groups that
hold it, whatever the size of the table; a job with very many rows fills consecutive files. Logs are stored by day, so that a bound on time
leaves out whole folders.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.times import moment

#: Compressed bytes of a row group: what a lookup reads at least.
ROW_GROUP_BYTES = 8 << 20
DAY = "day"


def write_clustered(
    df: DataFrame, path: str, keys: Sequence[str], files: int | None = None, row_group_bytes: int = ROW_GROUP_BYTES, mode: str = "overwrite"
) -> None:
    """Stores a table for lookups by the first of ``keys``; the others order its rows.

    Range borders come from a sample over all keys, so one first key with very many rows is split over files. ``files`` defaults to the
    shuffle partitions, which adaptive execution joins where they are small.
    """
    order = [F.col(k).asc_nulls_first() for k in keys]
    dealt = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    writer = dealt.sortWithinPartitions(*order).write.mode(mode)
    writer = writer.option(f"parquet.bloom.filter.enabled#{keys[0]}", "true").option("parquet.block.size", str(row_group_bytes))
    writer.parquet(path)


def lookup(spark: SparkSession, path: str, key: str, values: Sequence) -> DataFrame:
    """Rows of a clustered table with one of a few keys; the filter reaches the row groups."""
    wanted = F.col(key) == values[0] if len(values) == 1 else F.col(key).isin(*values)
    return spark.read.parquet(path).where(wanted)


def write_log_by_day(log: DataFrame, path: str, mode: str = "append") -> None:
    """Stores log rows in a folder per day of ``timestamp``; rows without a time have a folder of their own.

    Each day is sorted by job, so that a filter on the job skips row groups too.
    """
    dated = log.withColumn(DAY, F.col("timestamp").cast("date"))
    spread = dated.repartitionByRange(F.col(DAY), F.col("job_id"), F.col("timestamp"))
    spread.sortWithinPartitions(DAY, "job_id", "timestamp").write.mode(mode).partitionBy(DAY).parquet(path)


def read_log_since(spark: SparkSession, path: str, cutoff: Column) -> DataFrame:
    """the stored log without the days that end before ``cutoff``; rows without a time are always read."""
    kept = F.col(DAY).isNull() | (F.col(DAY) >= cutoff.cast("date"))
    return spark.read.parquet(path).where(kept).drop(DAY)


def history_cutoff(now: datetime, minutes: int) -> Column:
    return moment(now) - F.expr(f"INTERVAL {int(minutes)} MINUTES")
