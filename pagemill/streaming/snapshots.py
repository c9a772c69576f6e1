"""Throttled snapshots of a text stream. The batch form is in operators.throttle."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagemill.functions.times import micros
from pagemill.session import ROCKSDB_PROVIDER

SNAPSHOTS_PER_PART = 64

class SnapshotThrottle(StatefulProcessor):
    """Buffers the chunks of a page; state is the open buffer and the text of the open part, until the final chunk or a timer."""

    def __init__(self, wait_us: int, tokens: int, cumulative: bool, per_part: int, idle_ms: int | None) -> None:
        self.wait_us, self.tokens, self.cumulative, self.per_part = wait_us, tokens, cumulative, per_part
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "open", "buffer string, n int, last bigint, no bigint, part_text string, seen bigint, expires bigint"
        )

    def _snapshot(self, key: Any, no: int, n: int, at: int, is_final: bool, delta: str, part_text: str) -> Row:
        text = {"part_text": part_text} if self.cumulative else {"delta": delta}
        part = (no - 1) // self.per_part
        return Row(job_id=key[0], page_num=key[1], snapshot_no=no, part=part, tokens=n, flushed_us=at, is_final=is_final, **text)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        """The page brought nothing for the idle time: what the buffer holds goes out as it is, and the state ends."""
        if not self.state.exists():
            return
        buffer, n, _, no, part_text, seen, _ = self.state.get()
        self.state.clear()
        if n:
            text = buffer if no % self.per_part == 0 else part_text + buffer
            yield self._snapshot(key, no + 1, n, seen, False, buffer, text)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        state = self.state.get() if self.state.exists() else ("", 0, None, 0, "", None, None)
        buffer, n, last, no, part_text, seen, expires = state
        held, done = [buffer], False
        for row in sorted(rows, key=lambda r: (r.at, r.chunk_sequence)):
            last = row.at if last is None else last
            seen = row.at
            held.append(row.chunk_text)
            n += 1
            done = False
            if row.is_final or n >= self.tokens or row.at - last >= self.wait_us:
                delta = "".join(held)
                if no % self.per_part == 0:
                    part_text = ""
                no += 1
                part_text = part_text + delta if self.cumulative else ""
                yield self._snapshot(key, no, n, row.at, row.is_final, delta, part_text)
                held, n, last = [], 0, row.at
                done = row.is_final
        if self.idle_ms and expires is not None:
            self.handle.deleteTimer(expires)
        if done:  # the stream of this page is over
            self.state.clear()
            return
        if self.idle_ms:
            expires = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(expires)
        self.state.update(("".join(held), n, last, no, part_text, seen, expires))

    def close(self) -> None:
        pass


def throttle_snapshot_stream(
    stream: DataFrame,
    ms: int = 100,
    tokens: int = 50,
    cumulative: bool = True,
    snapshots_per_part: int = SNAPSHOTS_PER_PART,
    idle_ms: int | None = None,
) -> DataFrame:
    """Snapshots of a chunk stream, appended as they fall due; columns as in the batch form.

    The buffer never exceeds ``tokens`` chunks and the kept text one part.
    Chunks of one micro-batch are taken in event-time order; limit the source
    (maxFilesPerTrigger and the like) to bound what one page brings at once.
    Without ``cumulative`` the text is the delta. With ``idle_ms`` a page that brings nothing for
    so long, by the clock, gives out what its buffer holds, not as final, and leaves the state. That is for streams that run on:
    a run that drains its source and stops would wait for the clock for ever.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    types = dict(stream.dtypes)
    schema = (
        f"job_id {types['job_id']}, page_num {types['page_num']}, snapshot_no bigint, part bigint,"
        " tokens bigint, flushed_us bigint, is_final boolean, " + ("part_text string" if cumulative else "delta string")
    )
    rows = stream.select(
        "job_id",
        "page_num",
        "chunk_sequence",
        F.coalesce("chunk_text", F.lit("")).alias("chunk_text"),
        micros(F.col("created_at")).alias("at"),
        F.coalesce("is_final", F.lit(False)).alias("is_final"),
    )
    snapshots = rows.groupBy("job_id", "page_num").transformWithState(
        statefulProcessor=SnapshotThrottle(ms * 1000, tokens, cumulative, snapshots_per_part, idle_ms),
        outputStructType=schema,
        outputMode="Append",
        timeMode="ProcessingTime" if idle_ms else "None",
    )
    flushed = F.timestamp_micros("flushed_us").cast("timestamp_ntz")
    return snapshots.withColumn("flushed_at", flushed).drop("flushed_us")
