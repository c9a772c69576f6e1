"""S8 as a stream: column-wise upserts into a table of hash buckets, copied on write.

The table is a folder per bucket of the key. A micro-batch reads the buckets that its keys fall into, merges them with the changes
and replaces exactly these folders; all other files stay as they are. Every stored value has its version, so the merge is a maximum per key and column:
it gives the same table for any order and any split of the changes, and a repeated micro-batch changes nothing. A row is stored and shuffled with its newest
version once, and with further ones only for columns whose value is older.

A bucket is spread by a hash of the whole key, so a job with very many pages fills all buckets alike. Take as many buckets as make one a few
hundred MB: a micro-batch rewrites at most the buckets it touches. Where two buckets for each core are not to be had, several tasks share one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pagemill.session import path_exists
from pagemill.streaming.tables import started

BUCKETS = 64
BUCKET = "__bucket"
_PIECE = "__piece"
_VERSION = "__version"
_OLDER = "__older_"


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _newest(columns: Sequence[str], version_of: Callable[[str], Column]) -> list[Column]:
    """Per column the newest non-null value, as struct(version, v)."""
    return [F.max(F.when(F.col(c).isNotNull(), F.struct(version_of(c).alias("version"), F.col(c).alias("v")))).alias(c) for c in columns]


def _packed(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(bucket, keys, newest version, values, versions of the older values) from structs of version and value."""
    rows = rows.withColumn(_VERSION, F.array_max(F.array(*[F.col(c)["version"] for c in columns])))
    # Inside a struct, as a version may be null itself.
    older = [
        F.when(F.col(c).isNotNull() & ~F.col(c)["version"].eqNullSafe(F.col(_VERSION)), F.struct(F.col(c)["version"].alias("version"))).alias(_OLDER + c)
        for c in columns
    ]
    return rows.select(BUCKET, *keys, _VERSION, *[F.col(c)["v"].alias(c) for c in columns], *older)


def versioned(changes: DataFrame, keys: Sequence[str], version: Column, columns: Sequence[str], buckets: int) -> DataFrame:
    """The newest non-null value of each column, as rows of the table; combined before the shuffle."""
    rows = changes.withColumn(_VERSION, version).groupBy(bucket_of(keys, buckets).alias(BUCKET), *keys)
    return _packed(rows.agg(*_newest(columns, lambda c: F.col(_VERSION))), keys, columns)


def _merged(stored: DataFrame, keys: Sequence[str], columns: Sequence[str], buckets: int) -> DataFrame:
    # One shuffle by pieces of buckets serves the grouping and the write, which thus makes one file per piece. A partition each, as a hash of so few would give
    # several of them to some tasks and none to others.
    pieces = -(-2 * stored.sparkSession.sparkContext.defaultParallelism // buckets)
    piece = F.col(BUCKET) * pieces + F.pmod(F.hash(*keys), F.lit(pieces))
    dealt = stored.withColumn(_PIECE, piece).repartitionById(buckets * pieces, _PIECE)

    def version_of(column: str) -> Column:
        older = F.col(_OLDER + column)
        return F.when(older.isNull(), F.col(_VERSION)).otherwise(older["version"])

    return _packed(dealt.groupBy(BUCKET, _PIECE, *keys).agg(*_newest(columns, version_of)), keys, columns)


def _stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def upsert_changes(
    path: str, changes: DataFrame, keys: Sequence[str], version: Column, columns: Sequence[str], buckets: int = BUCKETS
) -> None:
    """Upserts ``changes`` into the table at ``path``, which is made when absent. ``buckets`` is fixed for the life of a table.

    The changes are persisted for the two passes over them (which buckets, then the merge).
    """
    spark = changes.sparkSession
    new = versioned(changes, keys, version, columns, buckets).persist()
    try:
        touched = [r[0] for r in new.select(BUCKET).distinct().collect()]
        if not touched:
            return
        rows = new
        if path_exists(spark, path):
            old = _stored(spark, path, new.schema).where(F.col(BUCKET).isin(touched))
            rows = old.select(new.columns).unionByName(new)
        writer = _merged(rows, keys, columns, buckets).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(BUCKET).parquet(path)
    finally:
        new.unpersist()


def write_upserts(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str],
    version: Column,
    columns: Sequence[str],
    known: DataFrame | None = None,
    buckets: int = BUCKETS,
    every_s: float | None = None,
) -> StreamingQuery:
    """A stream of changes into a bucketed table.

    Changes with a null key are left out, and with ``known`` also those whose first key is not in its first column.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        rows = batch.dropna(subset=list(keys))
        if known is not None:
            rows = rows.join(known.select(F.col(known.columns[0]).alias(keys[0])), keys[0], "left_semi")
        upsert_changes(path, rows, keys, version, columns, buckets)

    return started(stream, store, checkpoint, every_s=every_s)


def upserted_rows(spark: SparkSession, path: str, keys: Sequence[str], buckets: int = BUCKETS, only: DataFrame | None = None) -> DataFrame:
    """The rows of a table with plain columns.

    With ``only``, a short list of keys, just the buckets of these keys are read.
    """
    rows = spark.read.parquet(path)
    if only is not None:
        hit = [r[0] for r in only.select(bucket_of(keys, buckets)).distinct().collect()]
        rows = rows.where(F.col(BUCKET).isin(hit)).join(only.select(*keys).distinct(), list(keys), "left_semi")
    inner = (BUCKET, _VERSION)
    return rows.select(*[c for c in rows.columns if c not in inner and not c.startswith(_OLDER)])
