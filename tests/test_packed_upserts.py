"""Bucketed upserts store a version once per row, and once more only for values that are older."""

import glob
import os
import random

from pyspark.sql import functions as F

from pagemill.operators.mutations import upsert
from pagemill.streaming import upserts

COLUMNS = ["a", "b", "c", "d", "e", "f"]
DDL = "k int, page int, v struct<at:int,by:string>, " + ", ".join(f"{c} string" for c in COLUMNS)


def test_a_version_is_stored_once_per_row(spark, tmp_path):
    rnd, path = random.Random(3), str(tmp_path / "t")
    rows = [(k, 1, (k, rnd.randbytes(100).hex()), *"xxxxxx") for k in range(1000)]
    upserts.upsert_changes(path, spark.createDataFrame(rows, DDL), ["k", "page"], F.col("v"), COLUMNS, 4)
    assert sum(map(os.path.getsize, glob.glob(f"{path}/*/*.parquet"))) < 2 * 1000 * 200


def test_random_parts_equal_the_batch_form(spark, tmp_path):
    rnd, path = random.Random(5), str(tmp_path / "t")
    version = lambda: rnd.choice([None, (rnd.randrange(9), rnd.choice("xyz")), (None, "x")])
    rows = [(rnd.randrange(12), 1, version(), *[rnd.choice([None, None, f"{n}"]) for _ in COLUMNS]) for n in range(300)]
    for at in range(0, 300, 100):
        upserts.upsert_changes(path, spark.createDataFrame(rows[at : at + 100], DDL), ["k", "page"], F.col("v"), COLUMNS, 4)
    want = upsert(None, spark.createDataFrame(rows, DDL), ["k", "page"], F.col("v"), COLUMNS)
    got = upserts.upserted_rows(spark, path, ["k", "page"], 4)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
