"""One current row per page under snapshot, stage, complete and failed commands.

A command has job_id, page_num, order_no (unique and growing per page), kind
and, by kind, stage, snapshot_text, is_final, error, plus updated_at.

* snapshot  insert with seq 1, or replace stage, text, is_final, error; seq + 1
* stage     insert with empty text and seq 0, or replace the stage; seq + 1
* complete  only if the row exists: final text, stage complete; seq + 1
* failed    only if the row exists: error, stage failed; seq + 1
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pagemill.functions.times import micros
from pagemill.session import ROCKSDB_PROVIDER
from pagemill.streaming.tables import write_folded

KEYS = ["job_id", "page_num"]
COMMANDS_PER_BLOCK = 4096


def _latest(value: Column, when: Column, order: str = "order_no") -> Column:
    """Newest value among rows where ``when`` holds, as struct(v) so that null values count."""
    return F.max_by(F.when(when, F.struct(value.alias("v"))), F.when(when, F.col(order)))


def apply_stream_commands(
    current: DataFrame | None, commands: DataFrame, commands_per_block: int = COMMANDS_PER_BLOCK
) -> DataFrame:
    """The rows after applying ``commands`` in order to ``current``.

    A fold, yet every field is either the newest value some commands set or a
    count, so it is computed by aggregates. Only the commands that precede the
    row's creation need the order; they are told apart within blocks of
    ``order_no``, so a page with endless commands is spread over tasks.
    """
    kind = F.col("kind")
    creates = kind.isin("snapshot", "stage")
    rows = commands.select(
        *KEYS, "order_no", "kind", "stage", "snapshot_text", "is_final", "error", "updated_at",
        F.floor(F.col("order_no") / commands_per_block).alias("__b"),
    )
    if current is not None:
        # A stored row acts as a command of its own kind that precedes all others.
        start = current.select(
            *KEYS,
            F.lit(-1).cast("bigint").alias("order_no"),
            F.lit("stored").alias("kind"),
            "stage", "snapshot_text", "is_final", "error", "updated_at",
            F.lit(-1).cast("bigint").alias("__b"),
            "seq",
        )
        rows = rows.withColumn("seq", F.lit(None).cast("bigint")).unionByName(start)
        creates = creates | (kind == "stored")
    else:
        rows = rows.withColumn("seq", F.lit(None).cast("bigint"))

    so_far = W.partitionBy(*KEYS, "__b").orderBy("order_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = F.max(creates).over(so_far)
    stored, snapshot, stage = kind == "stored", kind == "snapshot", kind == "stage"
    sets_text = stored | snapshot | (kind == "complete")
    stage_value = F.when(kind == "complete", "complete").when(kind == "failed", "failed").otherwise(F.col("stage"))
    final_value = F.when(kind.isin("complete", "failed"), True).otherwise(F.coalesce("is_final", F.lit(False)))
    ordered = F.col("order_no")
    blocks = (
        rows.withColumn("__live", F.coalesce(seen, F.lit(False)))
        .groupBy(*KEYS, "__b")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("__live").alias("n_live"),
            F.bool_or(creates).alias("created"),
            F.min(F.when(creates, ordered)).alias("created_at_no"),
            F.min_by(F.struct(kind.alias("kind"), F.col("seq").alias("seq")), F.when(creates, ordered)).alias("creator"),
            F.max("order_no").alias("last_no"),
            _latest(stage_value, F.lit(True)).alias("stage"),
            _latest(F.col("snapshot_text"), sets_text).alias("text"),
            F.max(F.when(sets_text, ordered)).alias("text_no"),
            _latest(final_value, ~stage).alias("final"),
            F.max(F.when(~stage, ordered)).alias("final_no"),
            _latest(F.col("error"), stored | snapshot | (kind == "failed")).alias("error"),
            F.max(F.when(stored | snapshot | (kind == "failed"), ordered)).alias("error_no"),
            _latest(F.col("updated_at"), F.lit(True)).alias("updated"),
        )
    )
    # From here on there is one row per block. The first block with a creation
    # counts from that creation; later ones count whole; earlier ones not at all.
    created_before = F.max("created").over(
        W.partitionBy(*KEYS).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    )
    effective = F.when(F.coalesce(created_before, F.lit(False)), F.col("n")).otherwise(F.col("n_live"))
    total = (
        blocks.withColumn("effective", effective)
        .groupBy(*KEYS)
        .agg(
            F.bool_or("created").alias("created"),
            F.min("created_at_no").alias("first_no"),
            F.min_by("creator", "created_at_no").alias("creator"),
            F.sum("effective").alias("n"),
            F.max_by("stage", "last_no").alias("stage"),
            F.max_by("text", "text_no").alias("text"),
            F.max("text_no").alias("text_no"),
            F.max_by("final", "final_no").alias("final"),
            F.max("final_no").alias("final_no"),
            F.max_by("error", "error_no").alias("error"),
            F.max("error_no").alias("error_no"),
            F.max_by("updated", "last_no").alias("updated"),
        )
        .where("created")
    )
    first_seq = (
        F.when(F.col("creator.kind") == "stored", F.col("creator.seq"))
        .when(F.col("creator.kind") == "snapshot", 1)
        .otherwise(0)
    )

    def unless_earlier(field: str, default: Column) -> Column:
        """A value set before the row existed does not count."""
        return F.when(F.col(f"{field}_no") >= F.col("first_no"), F.col(f"{field}.v")).otherwise(default)

    return total.select(
        *KEYS,
        F.col("stage.v").alias("stage"),
        unless_earlier("text", F.lit("")).alias("snapshot_text"),
        (first_seq + F.col("n") - 1).alias("seq"),
        unless_earlier("final", F.lit(False)).alias("is_final"),
        unless_earlier("error", F.lit(None).cast("string")).alias("error"),
        F.col("updated.v").alias("updated_at"),
    )


def clear_streams(rows: DataFrame, finished_jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """T5: rows without those of finished jobs, and the number removed per job."""
    jobs = finished_jobs.select("job_id")
    removed = rows.join(jobs, "job_id", "left_semi").groupBy("job_id").agg(F.count(F.lit(1)).alias("removed"))
    return rows.join(jobs, "job_id", "left_anti"), removed


ROW = "stage string, text string, seq bigint, is_final boolean, error string, at bigint"
#: Pages of a job are dealt into so many keys, so that a job with very many pages is spread over tasks.
SLOTS = 16


def applied(row: list | None, c: Row) -> list | None:
    """The row of a page (stage, text, seq, is_final, error, at) after one command; None while there is none."""
    if c.kind == "snapshot":
        return [c.stage, c.snapshot_text, row[2] + 1 if row else 1, c.is_final, c.error, c.at]
    if c.kind == "stage":
        return [c.stage, row[1], row[2] + 1, row[3], row[4], c.at] if row else [c.stage, "", 0, False, None, c.at]
    if row and c.kind == "complete":
        return ["complete", c.snapshot_text, row[2] + 1, True, row[4], c.at]
    if row and c.kind == "failed":
        return ["failed", row[1], row[2] + 1, True, c.error, c.at]
    return row


def _out(key: tuple, row: list) -> Row:
    names = ["stage", "snapshot_text", "seq", "is_final", "error", "at"]
    return Row(**dict(zip([*KEYS, *names], [*key, *row])))


class StreamRow(StatefulProcessor):
    """Keyed state of one page's row; emits the row after every micro-batch that changed it."""

    def __init__(self, clear_when_final: bool, ttl_ms: int | None) -> None:
        self.clear_when_final, self.ttl_ms = clear_when_final, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = handle.getValueState("row", ROW, self.ttl_ms)

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        r = initialState
        self.row.update((r.stage, r.snapshot_text, r.seq, r.is_final, r.error, r.at))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        row = list(self.row.get()) if self.row.exists() else None
        before = row[2] if row else None
        for c in sorted(rows, key=lambda r: r.order_no):
            row = applied(row, c)
        if row is None or row[2] == before:
            return
        if self.clear_when_final and row[3]:
            self.row.clear()
        else:
            self.row.update(tuple(row))
        yield _out((key[0], key[1]), row)

    def close(self) -> None:
        pass


def _commands(commands: DataFrame) -> DataFrame:
    return commands.select(
        *KEYS, "order_no", "kind", "stage", "snapshot_text", F.coalesce("is_final", F.lit(False)).alias("is_final"),
        "error", micros(F.col("updated_at")).alias("at"),
    )


def _schema(commands: DataFrame) -> str:
    types = dict(commands.dtypes)
    return (
        f"job_id {types['job_id']}, page_num {types['page_num']}, stage string, snapshot_text string,"
        " seq bigint, is_final boolean, error string, at bigint"
    )


def current_stream_rows(
    commands: DataFrame, clear_when_final: bool = False, initial: DataFrame | None = None, ttl_ms: int | None = None
) -> DataFrame:
    """T4: streaming form in update mode. A sink keeps the row with the greatest seq per page.

    Commands of one micro-batch are applied by ``order_no``; across batches the
    arrival order counts. One task holds what a micro-batch brings for a page, so
    limit the source; for pages hotter than that use ``apply_stream_commands`` in
    foreachBatch, which spreads a page over blocks. ``clear_when_final`` drops the state of a finished
    page (T5), which bounds it when no command follows the final one.

    ``initial`` has the rows stored before, one per page: a stream that lost its checkpoint goes on from them, with
    their seq, and counts on from there. With ``ttl_ms`` a page without a command for so long leaves the state. That is for streams that
    run on: a run that drains its source and stops would wait for the clock for ever.
    """
    commands.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    stored = None
    if initial is not None:
        stored = initial.select(
            *[F.col(k).cast(dict(commands.dtypes)[k]).alias(k) for k in KEYS], "stage", "snapshot_text",
            F.col("seq").cast("bigint").alias("seq"), "is_final", "error", micros(F.col("updated_at")).alias("at"),
        ).groupBy(*KEYS)
    out = _commands(commands).groupBy(*KEYS).transformWithState(
        statefulProcessor=StreamRow(clear_when_final, ttl_ms),
        outputStructType=_schema(commands),
        outputMode="Update",
        timeMode="ProcessingTime" if ttl_ms else "None",
        initialState=stored,
    )
    return out.withColumn("updated_at", F.timestamp_micros("at").cast("timestamp_ntz")).drop("at")


class JobRows(StatefulProcessor):
    """State of the pages of one (job, slot). A finish command removes them and gives out how many they were."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getMapState("rows", "page bigint", ROW, self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        commands = sorted(rows, key=lambda r: (r.order_no, r.kind == "finish"))
        removed, changed = None, {}
        for c in commands:
            if c.kind == "finish":
                removed = (removed or 0) + self._clear(changed)
                changed = {}
                continue
            page = c.page_num
            if page not in changed:
                changed[page] = list(self.rows.getValue((page,))) if self.rows.containsKey((page,)) else None
            changed[page] = applied(changed[page], c)
        for page, row in changed.items():
            if row is not None:
                self.rows.updateValue((page,), tuple(row))
        if removed is not None:
            yield Row(job_id=key[0], slot=key[1], removed=removed)

    def _clear(self, changed: dict) -> int:
        held = {k[0] for k in self.rows.keys()}
        self.rows.clear()
        return len(held | {page for page, row in changed.items() if row is not None})

    def close(self) -> None:
        pass


def cleared_stream(commands: DataFrame, slots: int = SLOTS, ttl_ms: int | None = None) -> DataFrame:
    """T5 as a stream: (job_id, slot, removed) whenever a job ends, in update mode; the rows of a job are the sum over its slots.

    Ends come in the stream of commands as kind ``finish`` with an ``order_no`` and no page; what follows one starts the job anew. A job's
    pages are dealt into slots, each a key of its own, and its end goes to all of them.
    """
    commands.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    own = F.array(F.pmod(F.xxhash64("page_num"), F.lit(slots)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(slots - 1))
    rows = _commands(commands).withColumn("page_num", F.col("page_num").cast("bigint"))
    rows = rows.select("*", F.explode(F.when(F.col("kind") == "finish", every).otherwise(own)).alias("slot"))
    return rows.groupBy("job_id", "slot").transformWithState(
        statefulProcessor=JobRows(ttl_ms),
        outputStructType=f"job_id {dict(commands.dtypes)['job_id']}, slot int, removed bigint",
        outputMode="Update",
        timeMode="ProcessingTime" if ttl_ms else "None",
    )


def _of_keys(rows: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are in the micro-batch; null keys meet as well."""
    wanted = batch.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return rows.join(wanted, same, "left_semi")


def write_stream_rows(
    commands: DataFrame, path: str, checkpoint: str, initial: DataFrame | None = None, every_s: float | None = None
) -> StreamingQuery:
    """T4 for very many pages or commands: the rows of ``current_stream_rows``, folded by ``apply_stream_commands`` per micro-batch.

    No Python per page or command, and a page with endless commands is spread over blocks. ``initial`` as there; state never expires.
    """

    def fold(rows: DataFrame | None, batch: DataFrame) -> DataFrame:
        return apply_stream_commands(None if rows is None else _of_keys(rows, batch, KEYS), batch)

    return write_folded(commands, path, checkpoint, KEYS, fold, lambda changed: changed, initial, every_s=every_s)


def write_cleared(commands: DataFrame, path: str, checkpoint: str, every_s: float | None = None) -> StreamingQuery:
    """T5 for very many jobs: (job_id, removed) of the jobs that a micro-batch ends and that had rows; commands as in ``cleared_stream``.

    The ends of a job cut its commands into spans, and the pages of each span are folded apart; state is a row per page, gone or not.
    """

    def fold(rows: DataFrame | None, batch: DataFrame) -> DataFrame:
        ends = batch.where("kind = 'finish'").groupBy(F.col("job_id").alias("__job")).agg(
            F.array_sort(F.collect_set("order_no")).alias("ends")
        )
        span = F.when(F.col("ends").isNull(), 0).otherwise(F.size(F.filter("ends", lambda e: e < F.col("order_no"))))
        page = F.struct("page_num", span.alias("span")).alias("page_num")
        own = batch.where("kind <> 'finish'").join(ends, F.col("job_id").eqNullSafe(F.col("__job")), "left")
        own = own.select("job_id", page, *[c for c in batch.columns if c not in KEYS])
        current = None
        if rows is not None:
            held = _of_keys(rows.where("live"), batch, ["job_id"])
            current = held.withColumn("page_num", F.struct("page_num", F.lit(0).alias("span")))
        row = F.struct("stage", "snapshot_text", "seq", "is_final", "error", "updated_at")
        spans = apply_stream_commands(current, own).join(ends, F.col("job_id").eqNullSafe(F.col("__job")), "left").select(
            "job_id", F.col("page_num.page_num").alias("page_num"), F.col("page_num.span").alias("span"), row.alias("row"),
            (F.col("ends").isNotNull() & (F.col("page_num.span") < F.size("ends"))).alias("over"),
        )
        return spans.groupBy(*KEYS).agg(
            F.max_by("row", "span").alias("row"), (~F.max_by("over", "span")).alias("live"), F.count_if("over").alias("removed")
        ).select(*KEYS, "row.*", "live", "removed")

    def removed(changed: DataFrame) -> DataFrame:
        return changed.where("removed > 0").groupBy("job_id").agg(F.sum("removed").alias("removed"))

    return write_folded(commands, path, checkpoint, KEYS, fold, removed, every_s=every_s)
