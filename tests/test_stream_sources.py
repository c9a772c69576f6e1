"""Streams over the stand-in tables: one file or a folder, one batch per part."""

import pytest
from pyspark.sql import functions as F

from pagemill.sources import standins
from pagemill.streaming import tables


@pytest.mark.parametrize("files", [1, 3])
def test_a_table_is_streamed_whole_as_a_file_and_as_a_folder(spark, tmp_path, files):
    """F1, F3, F4."""
    rows = spark.range(50).select(F.col("id").alias("k"), F.concat(F.lit("t"), "id").alias("text"))
    folder = tmp_path / "sf" / "documents.parquet"
    rows.repartition(files).write.parquet(str(folder))
    spark.range(7).write.parquet(str(tmp_path / "sf" / "documents.parquets"))
    if files == 1:
        part = next(folder.glob("part-*.parquet"))
        moved = tmp_path / "one"
        moved.mkdir()
        part.rename(moved / "documents.parquet")
        folder = moved / "documents.parquet"
    stream = standins.stream_table(spark, str(folder.parent), "documents")
    tables.write_updates(stream, f"{tmp_path}/table", f"{tmp_path}/check").awaitTermination()
    assert sorted(map(tuple, tables.stored_rows(spark, f"{tmp_path}/table").collect())) == sorted(map(tuple, rows.collect()))
