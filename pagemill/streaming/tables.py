"""Tables fed by a stream.

Each micro-batch is written to its own folder, replaced whole when the batch is retried, so the sink is exactly-once. The folder carries the id
of the streaming query, which lives in its checkpoint: a stream that starts anew numbers its batches from 0 again, and writes
beside what earlier streams left. Readers take the newest row per key.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagemill.operators.mutations import latest_rows
from pagemill.session import path_exists

#: Where a stored row came from: the query, its micro-batch, and when that was written.
ORIGIN = ["query", "batch_id", "stored_us"]
_WRITTEN = ["stored_us", "batch_id"]
#: After so many micro-batches the state of ``write_folded`` is written whole, to bound what the next ones read.
BATCHES_PER_STATE = 8


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the streaming query that owns a checkpoint; it outlives restarts."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()[0])["id"]


def started(
    stream: DataFrame, store: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", every_s: float | None = None
) -> StreamingQuery:
    """Starts a stream whose micro-batches ``store`` takes in; without ``every_s`` it drains what is there and stops."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(store)
    writer = writer.trigger(processingTime=f"{every_s} seconds") if every_s else writer.trigger(availableNow=True)
    return writer.start()


def write_updates(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    mode: str = "append",
    every_s: float | None = None,
    reduce: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Starts a stream into an update table."""

    def store(batch: DataFrame, batch_id: int) -> None:
        rows = reduce(batch) if reduce else batch
        rows = rows.withColumn("stored_us", F.lit(time.time_ns() // 1000))
        rows.write.mode("overwrite").parquet(f"{path}/query={query_id(batch.sparkSession, checkpoint)}/batch_id={batch_id}")

    return started(stream, store, checkpoint, mode, every_s)


def read_updates(spark: SparkSession, path: str) -> DataFrame:
    """All stored updates with the columns of their origin."""
    return spark.read.parquet(path)


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    """All stored updates as the streams gave them."""
    return read_updates(spark, path).drop(*ORIGIN)


def current_rows(spark: SparkSession, path: str, keys: Sequence[str], version: Sequence[str] = ()) -> DataFrame:
    """Newest row of each key, by the given version columns and then by when it was stored."""
    return latest_rows(read_updates(spark, path), keys, [*version, *_WRITTEN]).drop(*ORIGIN)


def compact(spark: SparkSession, path: str, target: str, keys: Sequence[str], version: Sequence[str] = ()) -> None:
    """Writes the current rows as one batch of a new table, to bound what readers scan.

    A stream may then go on into ``target`` with its old checkpoint: its next batches have folders of their own, and their rows are newer.
    """
    newest = latest_rows(read_updates(spark, path), keys, [*version, *_WRITTEN]).drop("query", "batch_id")
    newest.write.mode("overwrite").parquet(f"{target}/query=compacted/batch_id=0")


def _folded(
    spark: SparkSession, path: str, batch_id: int, keys: Sequence[str], initial: DataFrame | None, whole: int | None = None
) -> DataFrame | None:
    """The state that ``write_folded`` had after the micro-batch before ``batch_id``, from the one written whole after ``whole``."""
    if whole is None:
        whole = batch_id // BATCHES_PER_STATE * BATCHES_PER_STATE - 1
    batches = {b: f"{path}/batch={b}" for b in range(whole + 1, batch_id)}
    found = [spark.read.parquet(f).withColumn("__batch", F.lit(b)) for b, f in batches.items() if path_exists(spark, f)]
    start = spark.read.parquet(f"{path}/upto={whole}") if whole >= 0 else initial
    if start is not None:
        found.append(start.withColumn("__batch", F.lit(-1)))
    if not found:
        return None
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    return latest_rows(rows, keys, ["__batch"]).drop("__batch") if len(found) > 1 else rows.drop("__batch")


def write_folded(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str],
    fold: Callable[[DataFrame | None, DataFrame], DataFrame],
    give: Callable[[DataFrame], DataFrame],
    initial: DataFrame | None = None,
    mode: str = "append",
    every_s: float | None = None,
) -> StreamingQuery:
    """Starts a stream with one row of state per key, folded by joins and aggregates of whole micro-batches.

    ``fold`` gets the state, None at first unless there is an ``initial`` one, and the micro-batch, and returns the rows of state that changed; what ``give``
    makes of these goes into the update table. The state lies beside the update table, in a folder per micro-batch that only later ones read, so a
    micro-batch that is retried gives the same again. For streams whose keys are too many for a call of Python each.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        spark, query = batch.sparkSession, query_id(batch.sparkSession, checkpoint)
        at = f"{path}-state/query={query}"
        fold(_folded(spark, at, batch_id, keys, initial), batch).write.mode("overwrite").parquet(f"{at}/batch={batch_id}")
        rows = give(spark.read.parquet(f"{at}/batch={batch_id}")).withColumn("stored_us", F.lit(time.time_ns() // 1000))
        rows.write.mode("overwrite").parquet(f"{path}/query={query}/batch_id={batch_id}")
        if (batch_id + 1) % BATCHES_PER_STATE == 0:
            _folded(spark, at, batch_id + 1, keys, initial, batch_id - BATCHES_PER_STATE).write.mode("overwrite").parquet(f"{at}/upto={batch_id}")

    return started(stream, store, checkpoint, mode, every_s)
