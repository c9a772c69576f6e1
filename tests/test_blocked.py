"""Block-wise windows against plain ones, with hot, short and null keys."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.operators import blocked, monitoring
from pagemill.operators.documents import page_batches


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    data = [("hot", i + 1, rng.choice([None, 1, 2, 3])) for i in range(500)]
    data += [(f"k{i % 40}", i // 40 + 1, i) for i in range(200)]
    data += [(None, i + 1, i) for i in range(30)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, n int, v int").repartition(5).cache()


def _sorted(df):
    return sorted(map(str, df.select("k", "n", "got").collect()))


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
def test_row_numbers_and_sums(skewed, size):
    block = blocked.page_block("n", size)
    plain = W.partitionBy("k").orderBy("n")
    want = skewed.withColumn("got", F.row_number().over(plain).cast("bigint"))
    assert _sorted(blocked.row_numbers(skewed, ["k"], block, ["n"], "got")) == _sorted(want)
    values = F.coalesce("v", F.lit(0))
    want = skewed.withColumn("got", F.sum(values).over(plain))
    assert _sorted(blocked.running_sum(skewed, ["k"], block, ["n"], values, "got")) == _sorted(want)


@pytest.mark.parametrize("size", [1, 7, 64])
def test_previous_keeps_null_values(skewed, size):
    want = skewed.withColumn("got", F.lag("v").over(W.partitionBy("k").orderBy("n")))
    got = blocked.previous(skewed, ["k"], blocked.page_block("n", size), ["n"], "v", "got")
    assert _sorted(got) == _sorted(want)


def test_no_keys_numbers_everything(skewed):
    hot = skewed.where("k = 'hot'")
    got = blocked.row_numbers(hot, [], blocked.page_block("n", 16), ["n"], "got")
    assert got.where("got <> n").count() == 0


def test_hot_key_is_spread_over_tasks(skewed):
    """No window is partitioned by the key alone below the block totals."""
    df = blocked.row_numbers(skewed, ["k"], blocked.page_block("n", 16), ["n"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "__block" in plan


def test_page_batch_limits(rows):
    pages = rows([(1, i) for i in range(1, 20)], "job_id int, page_num int")
    got = page_batches(pages, 8).groupBy("batch_no").count().orderBy("batch_no").collect()
    assert [r["count"] for r in got] == [8, 8, 3]
    for size in (0, 17):
        with pytest.raises(ValueError):
            page_batches(pages, size)


def test_last_n_limits_before_the_shuffle(spark, rows):
    log = rows([(1, i) for i in range(50)], "job_id int, event_id int")
    df = monitoring.last_n(log, "job_id", ["event_id"], 5)
    assert [r.event_id for r in df.collect()] == [45, 46, 47, 48, 49]
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()


def test_text_ids_keep_their_order_over_blocks(rows):
    ids = ["", "a", "aa", "aab", "aac", "ab", "b", "zz-9", "é", "日本"]
    df = rows([(1, i) for i in ids], "k int, file_id string")
    got = blocked.row_numbers(df, ["k"], blocked.id_block(df, "file_id"), ["file_id"]).collect()
    assert [r.file_id for r in sorted(got, key=lambda r: r.seq)] == sorted(ids, key=lambda i: i.encode())
    numbers = rows([(1, i) for i in range(0, 20000, 999)], "k int, file_id bigint")
    got = blocked.row_numbers(numbers, ["k"], blocked.id_block(numbers, "file_id"), ["file_id"]).collect()
    assert all(r.file_id == (r.seq - 1) * 999 for r in got)


def test_blocks_are_as_fine_as_their_rows_ask(rows):
    ids = [f"job_{i:06d}" for i in range(300)]
    df = rows([(1, i) for i in ids], "k int, file_id string")
    block = blocked.id_block(df, "file_id", ["k"], limit=50)
    assert df.groupBy(block.alias("b")).count().agg({"count": "max"}).first()[0] <= 50
    got = blocked.row_numbers(df, ["k"], block, ["file_id"]).collect()
    assert [r.file_id for r in sorted(got, key=lambda r: r.seq)] == ids


def test_one_busy_instant_is_split_by_the_tie_break(spark):
    df = spark.range(20_000).selectExpr("1 AS k", "timestamp'2024-01-01 00:00:30' AS timestamp", "id AS event_id")
    block = blocked.fitted_block(df, ["k"], blocked.time_blocks("timestamp", "event_id"), limit=5000)
    assert df.groupBy(block.alias("b")).count().agg({"count": "max"}).first()[0] <= 5000
    got = blocked.row_numbers(df, ["k"], block, ["timestamp", "event_id"])
    assert got.where("seq <> event_id + 1").count() == 0


def test_last_n_beyond_the_group_limit(spark):
    log = spark.range(8000).selectExpr("id % 2 AS job_id", "id AS event_id", "timestamp_millis(id * 40000) AS timestamp")
    got = monitoring.last_n(log, "job_id", ["timestamp", "event_id"], 3000).collect()
    assert [r.event_id for r in got] == [*range(2000, 8000, 2), *range(2001, 8000, 2)]
    by_id = monitoring.last_n(log, "job_id", ["event_id"], 3000).collect()
    assert [r.event_id for r in by_id] == [r.event_id for r in got]
