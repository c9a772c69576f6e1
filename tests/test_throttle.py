"""Parallel marks against a plain loop, with blocks far smaller than the keys."""

import random
from datetime import datetime, timedelta

import pytest

from pagemill.operators.blocked import page_block
from pagemill.operators.throttle import checkpoint_marks, throttle_marks, text_parts, throttle_snapshots

START = datetime(2024, 1, 1)


def loop_marks(ts, force, max_count, wait_ms, arm_first):
    out, count, last = [], 0, ts[0]
    for i, (t, f) in enumerate(zip(ts, force)):
        count += 1
        due = f or count >= max_count or t - last >= timedelta(milliseconds=wait_ms)
        if due and not (arm_first and i == 0):
            out.append(True)
            count, last = 0, t
        else:
            out.append(False)
    return out


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("arm_first", [False, True])
def test_marks(spark, seed, arm_first):
    rng = random.Random(seed)
    max_count = rng.choice([1, 2, 5, 8])
    data, want = [], {}
    for key, length in [("hot", 400), ("full", 32), ("short", 3), ("one", 1), ("next", 33)]:
        t, ts, force = START, [], []
        for i in range(length):
            t += timedelta(milliseconds=rng.choice([0, 1, 5, 30, 80, 120]))
            ts.append(t)
            force.append(rng.random() < 0.05)
        for i, m in enumerate(loop_marks(ts, force, max_count, 100, arm_first)):
            want[key, i + 1] = m
            data.append((key, i + 1, ts[i], force[i]))
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k string, n int, ts timestamp_ntz, f boolean").repartition(3)
    got = throttle_marks(
        df, ["k"], page_block("n", 16), ["n"], "ts", max_count, 100, force="f", arm_first=arm_first, rows_per_block=16
    )
    found = got.collect()
    assert {(r.k, r.n): r.mark for r in found} == want
    for r in found:
        assert r["__marks"] == sum(m for (k, n), m in want.items() if k == r.k and n <= r.n)


def test_block_must_hold_a_whole_count(spark):
    df = spark.createDataFrame([("a", 1, START)], "k string, n int, ts timestamp_ntz")
    with pytest.raises(ValueError):
        throttle_marks(df, ["k"], page_block("n"), ["n"], "ts", 50, 100, rows_per_block=10)


def _chunks(spark, times_ms, final=()):
    data = [
        (1, 1, i, f"c{i} ", START + timedelta(milliseconds=ms), i in final) for i, ms in enumerate(times_ms)
    ]
    return spark.createDataFrame(
        data,
        "job_id int, page_num int, chunk_sequence int, chunk_text string, created_at timestamp_ntz, is_final boolean",
    )


@pytest.mark.parametrize("n, flushes", [(49, 0), (50, 1), (51, 1), (100, 2)])
def test_token_limit(spark, n, flushes):
    got = throttle_snapshots(_chunks(spark, [0] * n)).collect()
    assert len(got) == flushes


def test_time_limit_and_final(spark):
    got = throttle_snapshots(_chunks(spark, [0, 99, 100, 150, 151], final={4}), cumulative=False)
    found = [(r.snapshot_no, r.tokens, r.delta, r.is_final) for r in got.orderBy("snapshot_no").collect()]
    assert found == [(1, 3, "c0 c1 c2 ", False), (2, 2, "c3 c4 ", True)]


def test_final_right_after_a_flush(spark):
    got = throttle_snapshots(_chunks(spark, [0, 100, 100], final={2}), cumulative=False).orderBy("snapshot_no")
    assert [(r.tokens, r.is_final) for r in got.collect()] == [(2, False), (1, True)]


def test_cumulative_text_in_parts(spark):
    chunks = _chunks(spark, [i * 100 for i in range(9)], final={8})
    got = throttle_snapshots(chunks, snapshots_per_part=4).orderBy("snapshot_no").collect()
    last = {}
    for r in got:
        last[r.part] = r.part_text
    assert "".join(last[p] for p in sorted(last)) == "".join(f"c{i} " for i in range(9))
    assert got[1].part_text.startswith(got[0].part_text)


def test_200_snapshots_make_the_whole_text(spark):
    chunks = _chunks(spark, [i * 100 for i in range(201)], final={200})
    parts = text_parts(throttle_snapshots(chunks)).orderBy("part").collect()
    assert len(parts) == 4 and "".join(r.text for r in parts) == "".join(f"c{i} " for i in range(201))


def test_checkpoint_marks(spark):
    seconds = [0, 1, 2, 3, 4, 5, 36, 37]
    data = [(1, i + 1, START + timedelta(seconds=s)) for i, s in enumerate(seconds)]
    pages = spark.createDataFrame(data, "job_id int, page_num int, completed_at timestamp_ntz")
    got = checkpoint_marks(pages).orderBy("page_num").collect()
    assert [r.page_num for r in got if r.mark] == [5, 7]
