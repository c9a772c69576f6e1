"""T8 as a stream: a stage is complete when all pages of its job are, a job when its last stage is.

One keyed operator holds the pages seen and the total and gives each completion out once, in whatever order pages and totals arrive and
across restarts. Pages are kept as bits, 1024 to an entry, so a page costs a bit of state and a micro-batch one look-up per block of pages.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pagemill.functions.times import micros
from pagemill.session import ROCKSDB_PROVIDER
from pagemill.streaming.tables import write_folded

STAGES = ("ocr", "merge")
PAGES_PER_ENTRY = 1024


class Completion(StatefulProcessor):
    """State of one (job, stage): bits of the pages, how many they are, the newest completion, the total, and whether it is given out."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getMapState("pages", "block bigint", "bits binary", self.ttl_ms)
        self.seen = handle.getValueState("seen", "n bigint, last bigint, total bigint, done boolean", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        n, last, total, done = self.seen.get() if self.seen.exists() else (0, None, None, False)
        if done:
            return
        blocks: dict[int, int] = {}
        for row in rows:
            if row.total_pages is not None:
                total = row.total_pages
                continue
            block, bit = divmod(row.page_num, PAGES_PER_ENTRY)
            blocks[block] = blocks.get(block, 0) | 1 << bit
            if row.at is not None and (last is None or row.at > last):
                last = row.at
        for block, bits in blocks.items():
            old = int.from_bytes(self.pages.getValue((block,))[0], "little") if self.pages.containsKey((block,)) else 0
            if bits & ~old:
                n += (bits & ~old).bit_count()
                self.pages.updateValue((block,), ((old | bits).to_bytes(PAGES_PER_ENTRY // 8, "little"),))
        done = bool(total) and n >= total
        self.seen.update((n, last, total, done))
        if done:
            self.pages.clear()
            yield Row(job_id=key[0], stage=key[1], at=last)

    def close(self) -> None:
        pass


def completion_stream(
    pages: DataFrame, totals: DataFrame, stages: Sequence[str] = STAGES, ttl_ms: int | None = None
) -> DataFrame:
    """(job_id, stage, timestamp, event) with stage_complete of every stage and job_complete after the last of ``stages``.

    ``pages`` is a stream of (job_id, stage, page_num, timestamp) and may repeat pages, ``totals`` a stream of (job_id, total_pages),
    whose newest positive value counts. The event has the time of the newest page seen by then. With ``ttl_ms`` a job leaves the state so long
    after its last change, finished or not; pages that come later are taken for a new job. That is for streams that run on: a run that drains its source and
    stops would wait for the clock for ever.
    """
    pages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    none = F.lit(None).cast("bigint")
    done = pages.where("job_id IS NOT NULL AND stage IS NOT NULL AND page_num IS NOT NULL").select(
        "job_id", "stage", F.col("page_num").cast("bigint").alias("page_num"), micros(F.col("timestamp")).alias("at"), none.alias("total_pages")
    )
    known = totals.where("total_pages > 0").select(
        "job_id", F.explode(F.array(*map(F.lit, stages))).alias("stage"), none.alias("page_num"), none.alias("at"),
        F.col("total_pages").cast("bigint").alias("total_pages"),
    )
    job_type = dict(pages.dtypes)["job_id"]
    finished = done.unionByName(known).groupBy("job_id", "stage").transformWithState(
        statefulProcessor=Completion(ttl_ms),
        outputStructType=f"job_id {job_type}, stage string, at bigint",
        outputMode="Append",
        timeMode="ProcessingTime" if ttl_ms else "None",
    )
    return _events(finished, stages)


def _events(finished: DataFrame, stages: Sequence[str]) -> DataFrame:
    of_stage = [F.lit("stage_complete")]
    events = F.when(F.col("stage") == stages[-1], F.array(*of_stage, F.lit("job_complete"))).otherwise(F.array(*of_stage))
    at = F.timestamp_micros("at").cast("timestamp_ntz").alias("timestamp")
    return finished.select("job_id", "stage", at, F.explode(events).alias("event"))


def write_completions(
    pages: DataFrame, totals: DataFrame, path: str, checkpoint: str, stages: Sequence[str] = STAGES, every_s: float | None = None
) -> StreamingQuery:
    """T8 for very many jobs: the events of ``completion_stream`` into an update table, without a call of Python per job.

    Repeated pages are dropped by Spark's own keyed state, so a page costs a key there; counts, times and totals are folded per job, stage and
    micro-batch. Of several totals of a job in one micro-batch the greatest counts. State never expires.
    """
    pages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    none = F.lit(None).cast("bigint")
    known = pages.where("job_id IS NOT NULL AND stage IS NOT NULL AND page_num IS NOT NULL")
    new = known.select("job_id", "stage", "page_num").dropDuplicates(["job_id", "stage", "page_num"])
    # A repeated page counts no more, but its time does.
    times = known.select("job_id", "stage", F.lit(0).cast("bigint").alias("n"), micros(F.col("timestamp")).alias("at"), none.alias("total"))
    counted = new.select("job_id", "stage", F.lit(1).cast("bigint").alias("n"), none.alias("at"), none.alias("total"))
    sized = totals.where("total_pages > 0 AND job_id IS NOT NULL").select(
        "job_id", F.explode(F.array(*map(F.lit, stages))).alias("stage"), F.lit(0).cast("bigint").alias("n"), none.alias("at"),
        F.col("total_pages").cast("bigint").alias("total"),
    )
    keys = ["job_id", "stage"]

    def fold(rows: DataFrame | None, batch: DataFrame) -> DataFrame:
        came = batch.groupBy(*keys).agg(F.sum("n").alias("n"), F.max("at").alias("at"), F.max("total").alias("total"))
        if rows is not None:
            old = rows.select(*keys, F.col("n").alias("old_n"), F.col("at").alias("old_at"), F.col("total").alias("old_total"), "done")
            came = came.join(old, keys, "left").where("done IS NOT TRUE").select(
                *keys,
                (F.col("n") + F.coalesce("old_n", F.lit(0))).alias("n"),
                F.greatest("at", "old_at").alias("at"),
                F.coalesce("total", "old_total").alias("total"),
            )
        return came.withColumn("done", F.coalesce(F.col("n") >= F.col("total"), F.lit(False)))

    stream = counted.unionByName(times).unionByName(sized)
    return write_folded(stream, path, checkpoint, keys, fold, lambda changed: _events(changed.where("done"), stages), every_s=every_s)
