"""Rank selection for any number of kept rows against a plain sort."""

import random
from datetime import datetime, timedelta

import pytest

from pagemill.operators import jobs

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def batches(spark):
    rng = random.Random(4)
    spread = [(f"b{k:04}", START + timedelta(microseconds=rng.randrange(10**13))) for k in range(300)]
    tied = [(f"t{k:04}", START + timedelta(days=30)) for k in range(200)]
    untimed = [(f"n{k:04}", None) for k in range(100)]
    rows = [(i, at, rng.choice(["completed", "processing"])) for i, at in spread + tied + untimed]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "batch_job_id string, created_at timestamp_ntz, status string").repartition(5).cache()


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or START, r[0]), reverse=True)


@pytest.mark.parametrize("keep", [0, 1, 20, 21, 150, 300, 333, 420, 500, 501, 570, 599, 600, 10**6])
def test_newest_rows_equal_a_sort(batches, keep):
    rows, frame = batches
    got = jobs.newest_rows(frame, "created_at", "batch_job_id", keep, exact=20, ranges=8)
    assert sorted(r.batch_job_id for r in got.collect()) == sorted(r[0] for r in in_order(rows)[:keep])


def test_many_kept_batches(batches, monkeypatch):
    rows, frame = batches
    monkeypatch.setattr(jobs.newest_rows, "__defaults__", (20, 8))
    left, gone = jobs.evict_old_batches(frame, 400)
    want = {r[0] for r in in_order(rows)[400:] if r[2] == "completed"}
    assert {r.batch_job_id for r in gone.collect()} == want
    assert {r.batch_job_id for r in left.collect()} == {r[0] for r in rows} - want
    plan = jobs.newest_rows(frame, "created_at", "batch_job_id", 250)._jdf.queryExecution().executedPlan().toString()
    assert "limit=250" not in plan


def test_no_rows(spark):
    empty = spark.createDataFrame([], "batch_job_id string, created_at timestamp_ntz, status string")
    assert jobs.newest_rows(empty, "created_at", "batch_job_id", 50, exact=20).count() == 0
