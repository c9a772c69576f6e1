"""Text rebuilt from chunks that arrive in any order."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagemill.functions.times import micros
from pagemill.session import ROCKSDB_PROVIDER

CHUNKS_PER_PART = 1024
KEYS = ["job_id", "page_num", "part"]


def _part(size: int):
    return F.floor(F.col("chunk_sequence") / size)


def reassemble(chunks: DataFrame, chunks_per_part: int = CHUNKS_PER_PART) -> DataFrame:
    """Batch twin: (job_id, page_num, part, text, chunks, tokens).

    The newest text of a repeated sequence number wins (by created_at, then by
    text). Repeats are reduced map-side, so a part never holds more than its
    ``chunks_per_part`` chunks. ``tokens`` counts arrivals, repeats included.
    The text of a page is that of its parts in order.
    """
    newest = F.max_by("chunk_text", F.struct("created_at", "chunk_text"))
    unique = chunks.groupBy("job_id", "page_num", "chunk_sequence").agg(
        newest.alias("chunk_text"), F.count(F.lit(1)).alias("arrivals")
    )
    ordered = F.array_sort(F.collect_list(F.struct("chunk_sequence", "chunk_text")))
    return (
        unique.groupBy("job_id", "page_num", _part(chunks_per_part).alias("part"))
        .agg(
            ordered.alias("__c"),
            F.count(F.lit(1)).alias("chunks"),
            F.sum("arrivals").alias("tokens"),
        )
        .select(
            *KEYS,
            F.array_join(F.transform("__c", lambda c: c["chunk_text"]), "").alias("text"),
            "chunks",
            "tokens",
        )
    )


class ChunkAssembler(StatefulProcessor):
    """Keeps the chunks of one part of a page and emits its text whenever it changes."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chunks = handle.getMapState("chunks", "seq bigint", "text string, at bigint", self.ttl_ms)
        self.arrived = handle.getValueState("arrived", "n bigint", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        seen = self.arrived.get()[0] if self.arrived.exists() else 0
        newest: dict[int, tuple[int, str]] = {}
        for row in rows:
            seen += 1
            found = (row.at, row.chunk_text)
            if row.chunk_sequence not in newest or newest[row.chunk_sequence] <= found:
                newest[row.chunk_sequence] = found
        held = {k[0]: (v[1], v[0]) for k, v in self.chunks.iterator()}
        for seq, found in newest.items():
            if seq not in held or held[seq] <= found:
                held[seq] = found
                self.chunks.updateValue((seq,), (found[1], found[0]))
        self.arrived.update((seen,))
        yield Row(
            job_id=key[0],
            page_num=key[1],
            part=key[2],
            text="".join(held[seq][1] for seq in sorted(held)),
            chunks=len(held),
            tokens=seen,
        )

    def close(self) -> None:
        pass


def reassemble_chunks(
    stream: DataFrame, chunks_per_part: int = CHUNKS_PER_PART, ttl_ms: int | None = None
) -> DataFrame:
    """Streaming form: the same columns, one row per part whenever it changes (update mode).

    State is keyed by part, so even a page with endless chunks is spread over
    tasks and no key holds more than ``chunks_per_part`` of them. With ``ttl_ms`` parts leave the
    state so long after their last chunk; their text has been given out by then. Give it to streams that run on; a run that drains its source
    and stops would wait for the clock for ever.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    types = dict(stream.dtypes)
    schema = (
        f"job_id {types['job_id']}, page_num {types['page_num']}, part bigint, text string,"
        " chunks bigint, tokens bigint"
    )
    rows = stream.select(
        "job_id",
        "page_num",
        _part(chunks_per_part).alias("part"),
        F.col("chunk_sequence").cast("bigint").alias("chunk_sequence"),
        F.coalesce("chunk_text", F.lit("")).alias("chunk_text"),
        micros(F.col("created_at")).alias("at"),
    )
    return rows.groupBy(*KEYS).transformWithState(
        statefulProcessor=ChunkAssembler(ttl_ms),
        outputStructType=schema,
        outputMode="Update",
        timeMode="ProcessingTime" if ttl_ms else "None",
    )
