"""Table changes as rewrites: each returns the new contents of the table."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions.times import moment


def latest_rows(df: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """The row with the greatest version per key.

    The rank filter becomes a window group limit: every task keeps one row per
    key before the shuffle, so a key with very many versions stays small.
    """
    newest = W.partitionBy(*keys).orderBy(*[F.desc(v) for v in version])
    return df.withColumn("__rank", F.row_number().over(newest)).where("__rank = 1").drop("__rank")


def upsert(
    current: DataFrame | None, changes: DataFrame, keys: Sequence[str], version: Column, columns: Sequence[str]
) -> DataFrame:
    """Column-wise upsert; the newest non-null value of each column wins.

    A null in a change leaves the stored value alone. ``version`` orders the
    rows of one key and must be a total order; it is an explicit column of both
    inputs, never the arrival order.
    """
    rows = changes if current is None else current.unionByName(changes, allowMissingColumns=True)
    rows = rows.withColumn("__version", version)
    # The greatest (version, value) pair is cheaper than max_by, which keeps and compares both apart.
    newest = [
        F.max(F.when(F.col(c).isNotNull(), F.struct("__version", F.col(c).alias("v")))).alias(c) for c in columns
    ]
    return rows.groupBy(*keys).agg(*newest).select(*keys, *[F.col(f"{c}.v").alias(c) for c in columns])


def upsert_page_results(
    changes: DataFrame, jobs: DataFrame, version: Column, columns: Sequence[str], current: DataFrame | None = None
) -> DataFrame:
    """Upsert on (job_id, page_num), keeping pages of known jobs only."""
    merged = upsert(current, changes.where("page_num IS NOT NULL"), ["job_id", "page_num"], version, columns)
    return merged.join(jobs.select("job_id"), "job_id", "left_semi")


def split_valid_page_results(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with a page number, and the rejected rest."""
    return df.where("page_num IS NOT NULL"), df.where("page_num IS NULL")


def partial_update(
    df: DataFrame, changes: DataFrame, key: str, supplied: str = "supplied", version: str | None = None
) -> DataFrame:
    """U4: only fields the change supplies change; the rest stay, and so does the number of rows.

    A column ``supplied`` names, as an array, the fields of each change, which may then be null to clear the
    stored value; without that column a null is a field not supplied. Several changes of one key are
    taken in the order of the column ``version``, which must tell them apart, each field from the newest change that supplies it; without ``version``
    the query fails on them. Changes without a key change nothing.
    """
    fields = [c for c in changes.columns if c not in (key, supplied, version)]
    if supplied in changes.columns:
        named = F.coalesce(F.col(supplied), F.array().cast("array<string>"))
        given = {c: F.array_contains(named, c) for c in fields}
    else:
        given = {c: F.col(c).isNotNull() for c in fields}
    value = {c: F.when(given[c], F.struct(F.col(c).alias("v"))) for c in fields}
    if version:
        newest = [F.max_by(value[c], F.when(given[c], F.col(version))).alias(f"__new {c}") for c in fields]
    else:
        newest = [F.max_by(value[c], given[c].cast("int")).alias(f"__new {c}") for c in fields]
    new = changes.where(F.col(key).isNotNull()).groupBy(key).agg(*newest, F.count(F.lit(1)).alias("__changes of key"))
    if not version:
        repeated = F.raise_error(F.concat(F.lit("several changes of key "), F.col(key).cast("string"), F.lit(" and no version")))
        new = new.withColumn("__changes of key", F.when(F.col("__changes of key") > 1, repeated.cast("bigint")).otherwise(F.col("__changes of key")))
    updated = {c: F.when(F.col(f"__new {c}").isNotNull(), F.col(f"__new {c}")["v"]).otherwise(F.col(c)) for c in fields}
    # The count is looked at in every matching row, so that repeats are noticed even where no field changes.
    merged = df.join(new, key, "left").where("`__changes of key` IS NULL OR `__changes of key` > 0")
    return merged.withColumns(updated).select(*df.columns)


def soft_delete(files: DataFrame, keys: DataFrame, now: datetime | Column) -> DataFrame:
    """Sets ``deleted_at`` of the given file ids."""
    change = keys.select("file_id").distinct().withColumn("deleted_at", moment(now))
    return partial_update(files, change, "file_id")


def delete_rows(df: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The remaining rows, and a one-row frame with the number deleted."""
    on = keys.columns
    hit = df.join(keys, on, "left_semi").agg(F.count(F.lit(1)).alias("deleted"))
    return df.join(keys, on, "left_anti"), hit


def insert_absent(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Adds rows whose key is not there yet; of repeated new keys the least row goes in."""
    rest = [c for c in df.columns if c != key]
    fresh = rows.select(*df.columns).join(df.select(key), key, "left_anti")
    one = fresh.groupBy(key).agg(F.min(F.struct(*rest)).alias("__row")).select(key, "__row.*")
    return df.unionByName(one)


def older_than(
    items: DataFrame, now: datetime | Column, max_age_hours: float = 24, modified: str = "modified_at"
) -> DataFrame:
    """U8: items last changed strictly before the cut-off."""
    cutoff = moment(now) - F.expr(f"INTERVAL {int(max_age_hours * 3600)} SECONDS")
    return items.where(F.col(modified) < cutoff)
