"""Ordered per-key computations that do not put a whole key into one task.

A plain window partitioned by job sends every row of a job to one task, which
fails when one job holds a third of the data. Here the caller names a *block*
column that grows with the order (pages 1-1024, one hour, ...). Rows are
shuffled and sorted by (keys, block) only. What a block needs from earlier
blocks is one value per block: it is pre-aggregated map-side, carried forward
over the short list of blocks, and fed back as a marker row that sorts first in
its block. One shuffle of the data, no join, null keys kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

PAGES_PER_BLOCK = 1024
SECONDS_PER_BLOCK = 3600
#: A block of times or ids is made finer until no key has more rows in one.
ROWS_PER_BLOCK = 500_000


def page_block(page_num: str | Column, size: int = PAGES_PER_BLOCK) -> Column:
    """Block number of a 1-based position."""
    c = F.col(page_num) if isinstance(page_num, str) else page_num
    return F.floor((c - 1) / size)


def time_block(ts: str | Column, seconds: int = SECONDS_PER_BLOCK) -> Column:
    """Block number of a timestamp (session time zone UTC)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_seconds(c.cast("timestamp")) / seconds)


def fitted_block(df: DataFrame, keys: Sequence[str], blocks: Sequence[Column], limit: int = ROWS_PER_BLOCK) -> Column:
    """The first of ``blocks``, given from coarse to fine, in which no key has more than ``limit`` rows, else the last.

    So a block is bounded by its rows, not by the clock or by a prefix that all ids share. Each try is a count over
    the keys and the block alone, combined before the shuffle; with ordinary data there is one.
    """
    for block in blocks[:-1]:
        counts = df.groupBy(*keys, block.alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
        if (counts.agg(F.max("__n")).first()[0] or 0) <= limit:
            return block
    return blocks[-1]


def time_blocks(ts: str, tie: str | None = None) -> list[Column]:
    """Blocks of a timestamp from hours to microseconds, then with ranges of an integer tie-break column."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    blocks = [time_block(ts, seconds) for seconds in (SECONDS_PER_BLOCK, 60, 1)] + [F.floor(at / 1000), at]
    return [*blocks, F.struct(at, F.floor(F.col(tie) / 4096))] if tie else blocks


def fitted_time_block(
    df: DataFrame, keys: Sequence[str], ts: str, tie: str | None = None, seconds: int | None = None
) -> Column:
    """A block of ``seconds``, or one fitted to the rows."""
    return time_block(ts, seconds) if seconds else fitted_block(df, keys, time_blocks(ts, tie))


def id_block(df: DataFrame, name: str, keys: Sequence[str] = (), size: int = 4096, limit: int = ROWS_PER_BLOCK) -> Column:
    """Block of an id column, growing with its sort order.

    Integers fall into ranges of ``size``; texts are cut by a prefix, as long as it takes.
    """
    if isinstance(df.schema[name].dataType, IntegralType):
        return F.floor(F.col(name) / size)
    prefixes = [F.substring(F.col(name), 1, n) for n in (3, 8, 16, 32, 64)]
    return fitted_block(df, keys, [*prefixes, F.col(name)], limit)


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


def _block_window(keys: Sequence[str]):
    # Without keys the short list of blocks (never the rows) is one partition.
    return W.partitionBy(*_cols(keys)) if keys else W.partitionBy(F.lit(0))


def running_sum(
    df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str], value: Column, name: str
) -> DataFrame:
    """Adds the inclusive running sum of ``value`` per key as ``name``."""
    rows = df.withColumn("__block", block).withColumn("__v", value.cast("bigint"))
    totals = rows.groupBy(*keys, "__block").agg(F.sum("__v").alias("__total"))
    before = _block_window(keys).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    markers = (
        totals.withColumn("__v", F.sum("__total").over(before))
        .where(F.col("__v").isNotNull())
        .select(*keys, "__block", "__v", F.lit(0).alias("__row"))
    )
    local = (
        W.partitionBy(*_cols([*keys, "__block"]))
        .orderBy("__row", *order)
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return (
        rows.withColumn("__row", F.lit(1))
        .unionByName(markers, allowMissingColumns=True)
        .withColumn(name, F.sum("__v").over(local))
        .where("__row = 1")
        .drop("__block", "__v", "__row")
    )


def row_numbers(
    df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str], name: str = "seq"
) -> DataFrame:
    """Adds 1, 2, 3, ... per key in ``order`` (which must be a total order)."""
    return running_sum(df, keys, block, order, F.lit(1), name)


def previous(
    df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str], value: str, name: str
) -> DataFrame:
    """Adds the value of the preceding row of the key; null on its first row."""
    rows = df.withColumn("__block", block).withColumn("__v", F.struct(F.col(value).alias("x")))
    last = rows.groupBy(*keys, "__block").agg(
        F.max_by("__v", F.struct(*_cols(order))).alias("__last")
    )
    by_block = _block_window(keys).orderBy("__block")
    markers = (
        last.withColumn("__v", F.lag("__last").over(by_block))
        .where(F.col("__v").isNotNull())
        .select(*keys, "__block", "__v", F.lit(0).alias("__row"))
    )
    local = W.partitionBy(*_cols([*keys, "__block"])).orderBy("__row", *order)
    return (
        rows.withColumn("__row", F.lit(1))
        .unionByName(markers, allowMissingColumns=True)
        .withColumn(name, F.lag("__v").over(local)["x"])
        .where("__row = 1")
        .drop("__block", "__v", "__row")
    )
