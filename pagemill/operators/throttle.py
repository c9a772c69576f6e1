"""Marks that depend on the previous mark, computed in parallel.

Snapshots are written after 50 chunks or 100 ms, checkpoints after 5 pages or
30 s, both counted since the last one. That is a sequential rule, yet where a
run of rows is left depends only on how many rows were pending on entry, a
number below ``max_count``. So each block of a long sequence is reduced to a
table "pending on entry -> pending on exit" (at most ``max_count`` numbers),
the tables are chained per key, and every block is then marked on its own. A
key of any length is spread over its blocks and the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions.times import micros
from pagemill.operators.blocked import fitted_block, page_block, row_numbers, time_block, time_blocks

ROWS_PER_BLOCK = 8192


def _next_marks(ts: np.ndarray, force: np.ndarray, max_count: int, max_wait: int) -> np.ndarray:
    """Index of the mark that follows a mark at each index; len(ts) when there is none."""
    n = len(ts)
    nxt = np.arange(n) + max_count
    for step in range(min(max_count - 1, n - 1), 0, -1):
        hit = (ts[step:] - ts[:-step] >= max_wait) | force[step:]
        nxt[:-step] = np.where(hit, np.arange(n - step) + step, nxt[:-step])
    return np.minimum(nxt, n)


def _first_mark(ts: np.ndarray, force: np.ndarray, max_count: int, max_wait: int, arm_first: bool) -> int:
    """First mark of a sequence: the clock starts with its first row."""
    first = 1 if arm_first else 0
    for i in range(first, min(len(ts), max(max_count, first + 1))):
        if force[i] or i + 1 >= max_count or ts[i] - ts[0] >= max_wait:
            return i
    return len(ts)


def _groups(batches: Iterator[pd.DataFrame], names: list[str]) -> Iterator[pd.DataFrame]:
    """Cuts a stream of sorted batches into one frame per value of ``names``."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if pdf.empty:
            continue
        codes = np.zeros(len(pdf), dtype=bool)
        for c in names:
            col = pdf[c].to_numpy()
            codes[1:] |= col[1:] != col[:-1]
        starts = np.flatnonzero(codes).tolist()
        if held and any(held[-1][c].iat[-1] != pdf[c].iat[0] for c in names):
            yield pd.concat(held)
            held = []
        for a, b in zip([0, *starts], [*starts, len(pdf)]):
            if a:
                yield pd.concat(held)
                held = []
            held.append(pdf.iloc[a:b])
    if held:
        yield pd.concat(held)


def throttle_marks(
    df: DataFrame,
    keys: Sequence[str],
    block: Column,
    order: Sequence[str],
    ts: str,
    max_count: int,
    max_wait_ms: int,
    force: str | None = None,
    arm_first: bool = False,
    name: str = "mark",
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Adds the boolean ``name``, ``__n`` (position per key) and ``__marks`` (marks so far, this row's included).

    A row is marked when ``force`` holds, when ``max_count`` rows have come
    since the last mark, or when ``max_wait_ms`` have passed since it. With
    ``arm_first`` the first row only starts the clock. Keys are not null, and
    ``block`` is made of the keys, the order columns or ``ts``.
    """
    if rows_per_block < max_count:
        raise ValueError("rows_per_block must not be below max_count")
    keys = list(keys)
    wait = int(max_wait_ms) * 1000
    clock = {
        "__ts": micros(F.col(ts)),
        "__force": F.coalesce(F.col(force), F.lit(False)) if force else F.lit(False),
        "__b": F.floor((F.col("__n") - 1) / rows_per_block),
    }
    # A block also gets the last rows of the block before, to time its first mark.
    in_tail = (F.col("__n") - 1) % rows_per_block >= rows_per_block - max_count
    spread = F.when(in_tail, F.array(F.col("__b"), F.col("__b") + 1)).otherwise(F.array("__b"))

    def in_blocks(rows: DataFrame) -> DataFrame:
        numbered = row_numbers(rows, keys, block, order, "__n")
        return numbered.withColumns(clock).withColumn("__b", F.explode(spread))

    key_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pending on exit and marks made, for each pending on entry, of every full block."""
        for pdf in _groups(batches, [*keys, "__b"]):
            b = int(pdf["__b"].iat[0])
            start = int(np.searchsorted(pdf["__n"].to_numpy(), b * rows_per_block + 1))
            t, f = pdf["__ts"].to_numpy(), pdf["__force"].to_numpy().astype(bool)
            n = len(t)
            if n - start < rows_per_block:
                continue
            nxt = _next_marks(t, f, max_count, wait)
            leaves, later = np.arange(n), np.zeros(n, dtype=np.int64)
            for i in range(n - 1, -1, -1):
                if nxt[i] < n:
                    leaves[i], later[i] = leaves[nxt[i]], later[nxt[i]] + 1
            if b == 0:
                at, done = [_first_mark(t, f, max_count, wait, arm_first)], 1
            else:
                at, done = [start - 1 - c for c in range(max_count)], 0
            row = {k: [pdf[k].iat[0]] for k in keys}
            pending = [int(n - 1 - leaves[i]) for i in at]
            yield pd.DataFrame(
                {**row, "__b": [b], "__table": [pending], "__made": [[int(later[i]) + done for i in at]]}
            )

    def chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows pending on entry to each later block and marks before it, key by key in order."""
        pending, total = 0, 0
        for pdf in batches:
            entry, before = [], []
            for b, table, made in pdf[["__b", "__table", "__made"]].itertuples(index=False, name=None):
                if b == 0:
                    pending, total = 0, 0
                total += int(made[pending])
                pending = int(table[pending])
                entry.append(pending)
                before.append(total)
            yield pdf[keys].assign(__b=pdf["__b"] + 1, __entry=entry, __before=before)

    # Only keys of more than one block need the tables; there are few of them.
    long_keys = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__c")).where(F.col("__c") >= rows_per_block)
    narrow = df.select(*dict.fromkeys([*keys, *order, ts, *([force] if force else [])]))
    entries = (
        in_blocks(narrow.join(long_keys.select(*keys), keys, "left_semi"))
        .select(*keys, "__b", "__n", "__ts", "__force")
        .repartition(*keys, "__b")
        .sortWithinPartitions(*keys, "__b", "__n")
        .mapInPandas(tables, f"{key_ddl}, __b bigint, __table array<int>, __made array<bigint>")
        .repartition(*keys)
        .sortWithinPartitions(*keys, "__b")
        .mapInPandas(chained, f"{key_ddl}, __b bigint, __entry int, __before bigint")
    )

    # The entry states join the rows as markers that sort first in their block.
    rows = in_blocks(df).withColumns({"__entry": F.lit(-1), "__before": F.lit(0)}).unionByName(
        entries.withColumn("__n", F.lit(0).cast("bigint")), allowMissingColumns=True
    )
    kept = [*df.columns, "__n"]
    kept_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema)

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One pass over sorted rows with the state of the open block; nothing is held back."""
        held, count, last, total, resume_at, own_from = None, 0, 0, 0, 0, 1
        names = [*keys, "__b", "__n", "__ts", "__force", "__entry", "__before"]
        for batch in batches:
            out, made, own = [], [], []
            for *key, n, t, forced, entry, before in zip(*[batch.column(c).to_pylist() for c in names]):
                if key != held:
                    held, count, total, own_from = key, 0, 0, key[-1] * rows_per_block + 1
                    last, resume_at = t, own_from - 1
                if entry >= 0:
                    count, total, resume_at = entry, before, own_from - 1 - entry
                elif n < own_from:
                    # A row of the block before: one of them is where the last mark was.
                    if n == resume_at:
                        last = t
                else:
                    count += 1
                    due = forced or count >= max_count or t - last >= wait
                    mark = bool(due and not (arm_first and n == 1))
                    if mark:
                        count, last, total = 0, t, total + 1
                    out.append(mark)
                    made.append(total)
                    own.append(True)
                    continue
                own.append(False)
            mine = batch.select(kept).filter(pa.array(own, pa.bool_()))
            yield mine.append_column(name, pa.array(out, pa.bool_())).append_column(
                "__marks", pa.array(made, pa.int64())
            )

    return (
        rows.repartition(*keys, "__b")
        .sortWithinPartitions(*keys, "__b", "__n")
        .mapInArrow(marks, f"{kept_ddl}, `{name}` boolean, __marks bigint")
    )


def checkpoint_marks(pages: DataFrame, every_pages: int = 5, every_s: int = 30, **blocks) -> DataFrame:
    """Adds ``mark`` where a checkpoint is due; the first page only starts the clock."""
    marked = throttle_marks(
        pages,
        ["job_id"],
        page_block("page_num"),
        ["page_num"],
        ts="completed_at",
        max_count=every_pages,
        max_wait_ms=every_s * 1000,
        arm_first=True,
        **blocks,
    )
    return marked.drop("__n", "__marks")


def throttle_snapshots(
    chunks: DataFrame,
    ms: int = 100,
    tokens: int = 50,
    cumulative: bool = True,
    snapshots_per_part: int = 64,
    **blocks,
) -> DataFrame:
    """T3 in batch: the snapshots a throttled writer would store, in event time.

    ``chunks`` has job_id, page_num, chunk_sequence, chunk_text, created_at and
    is_final. Rows out: snapshot_no, tokens, flushed_at, is_final and the text
    since the last snapshot (``delta``) or, cumulative, ``part_text`` since
    the start of its ``part``. The text of a page at a snapshot is that of the
    last snapshot of each earlier part followed by this one; pages of up to 64
    snapshots have one part.
    """
    keys, order = ["job_id", "page_num"], ["created_at", "chunk_sequence"]
    block = fitted_block(chunks, keys, [time_block("created_at", 60), *time_blocks("created_at")[2:]])
    marked = throttle_marks(chunks, keys, block, order, "created_at", tokens, ms, force="is_final", **blocks)
    segments = marked.withColumn("snapshot_no", F.col("__marks") - F.col("mark").cast("int") + 1)
    parts = F.array_sort(F.collect_list(F.struct("__n", "chunk_text")))
    deltas = (
        segments.groupBy(*keys, "snapshot_no")
        .agg(
            parts.alias("__chunks"),
            F.count(F.lit(1)).alias("tokens"),
            F.max_by("created_at", "__n").alias("flushed_at"),
            F.bool_or("is_final").alias("is_final"),
            F.bool_or("mark").alias("__flushed"),
        )
        .where("__flushed")
        .select(
            *keys,
            "snapshot_no",
            F.floor((F.col("snapshot_no") - 1) / snapshots_per_part).alias("part"),
            "tokens",
            "flushed_at",
            "is_final",
            F.array_join(F.transform("__chunks", lambda c: c["chunk_text"]), "").alias("delta"),
        )
    )
    if not cumulative:
        return deltas.drop("part")
    so_far = (
        W.partitionBy(*keys, "part").orderBy("snapshot_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return deltas.withColumn("part_text", F.array_join(F.collect_list("delta").over(so_far), "")).drop("delta")


def text_parts(snapshots: DataFrame) -> DataFrame:
    """(job_id, page_num, part, text) as of the newest cumulative snapshot; the parts in order are the whole text."""
    return snapshots.groupBy("job_id", "page_num", "part").agg(F.max_by("part_text", "snapshot_no").alias("text"))
