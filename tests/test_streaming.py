"""Streams against their batch twins, with files in both orders and repeats."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pagemill.operators.throttle import throttle_snapshots
from pagemill.streaming import chunks, feeds, snapshots, stream_rows, tables

START = datetime(2024, 1, 1)
CHUNKS = "job_id int, page_num int, chunk_sequence bigint, chunk_text string, created_at timestamp_ntz, is_final boolean"
COMMANDS = (
    "job_id int, page_num int, order_no bigint, kind string, stage string, snapshot_text string,"
    " is_final boolean, error string, updated_at timestamp_ntz"
)


def as_stream(spark, path, parts, ddl, order):
    """Writes each part as a file; the source takes one file per micro-batch, oldest first."""
    import os
    import time

    for i in order:
        spark.createDataFrame(parts[i], ddl).coalesce(1).write.mode("append").parquet(path)
        for f in os.listdir(path):
            full = os.path.join(path, f)
            if f.startswith("part-") and f not in as_stream.seen:
                as_stream.seen.add(f)
                os.utime(full, (time.time() + len(as_stream.seen), time.time() + len(as_stream.seen)))
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


as_stream.seen = set()


def drain(stream, base, mode):
    tables.write_updates(stream, f"{base}/table", f"{base}/check", mode=mode).awaitTermination()
    return f"{base}/table"


@pytest.mark.parametrize("order", [[0, 1, 2], [2, 1, 0]])
def test_chunks_in_any_order(spark, tmp_path, order):
    def chunk(job, seq, text, ms):
        return (job, 1, seq, text, START + timedelta(milliseconds=ms), False)

    parts = [
        [chunk(1, 2, "c", 2), chunk(2, 0, "x", 0), chunk(1, 0, "a", 0)],
        [chunk(1, 1, "b", 1), chunk(1, 2, "C", 9), chunk(2, 5, "gap", 5)],
        [chunk(1, 1, "b", 1), chunk(2, 0, "x", 0), chunk(1, 7, "h", 7)],
    ]
    stream = as_stream(spark, str(tmp_path / "in"), parts, CHUNKS, order)
    path = drain(chunks.reassemble_chunks(stream, chunks_per_part=4), tmp_path, "update")
    got = tables.current_rows(spark, path, chunks.KEYS)
    want = chunks.reassemble(spark.createDataFrame([c for p in parts for c in p], CHUNKS), chunks_per_part=4)
    rows = lambda df: sorted((r.job_id, r.part, r.text, r.chunks, r.tokens) for r in df.collect())
    assert rows(got) == rows(want)
    assert rows(want)[0] == (1, 0, "abC", 3, 5)


def test_snapshot_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    data, t = [], {1: START, 2: START}
    for i in range(120):
        for job in (1, 2):
            t[job] += timedelta(milliseconds=rng.choice([1, 10, 60, 130]))
            data.append((job, 1, i, f"{i};", t[job], i == 119))
    parts = [data[:80], data[80:200], data[200:]]
    stream = as_stream(spark, str(tmp_path / "in"), parts, CHUNKS, [0, 1, 2])
    path = drain(snapshots.throttle_snapshot_stream(stream, 100, 5, snapshots_per_part=8), tmp_path, "append")
    batch = throttle_snapshots(spark.createDataFrame(data, CHUNKS), 100, 5, snapshots_per_part=8, rows_per_block=16)
    cols = ["job_id", "snapshot_no", "part", "tokens", "flushed_at", "is_final", "part_text"]
    rows = lambda df: sorted(tuple(r[c] for c in cols) for r in df.collect())
    assert rows(tables.read_updates(spark, path)) == rows(batch)


def fold(commands, rows=None):
    """The plain sequential meaning of stream commands."""
    rows = dict(rows or {})
    for job, page, _, kind, stage, text, final, error, at in commands:
        k, row = (job, page), rows.get((job, page))
        if kind == "snapshot":
            rows[k] = (stage, text, row[2] + 1 if row else 1, final, error, at)
        elif kind == "stage":
            rows[k] = (stage, row[1], row[2] + 1, row[3], row[4], at) if row else (stage, "", 0, False, None, at)
        elif row and kind == "complete":
            rows[k] = ("complete", text, row[2] + 1, True, row[4], at)
        elif row and kind == "failed":
            rows[k] = ("failed", row[1], row[2] + 1, True, error, at)
    return rows


def random_commands(seed, n=150):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.choice(["snapshot", "stage", "complete", "failed"])
        out.append((
            rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 2]), i, kind,
            rng.choice(["ocr", "merge"]) if kind in ("snapshot", "stage") else None,
            f"t{i}" if kind in ("snapshot", "complete") else None,
            rng.random() < 0.3 if kind == "snapshot" else None,
            rng.choice([None, f"e{i}"]) if kind in ("snapshot", "failed") else None,
            START + timedelta(seconds=i),
        ))
    return out


def as_rows(df):
    names = ["stage", "snapshot_text", "seq", "is_final", "error", "updated_at"]
    return {(r.job_id, r.page_num): tuple(r[c] for c in names) for r in df.collect()}


@pytest.mark.parametrize("seed", range(5))
@pytest.mark.parametrize("block", [1, 8, 4096])
def test_stream_commands_equal_the_fold(spark, seed, block):
    commands = random_commands(seed, n=[6, 12, 40, 150, 150][seed])
    half = len(commands) // 2
    frame = lambda c: spark.createDataFrame(c, COMMANDS).repartition(3)
    first = stream_rows.apply_stream_commands(None, frame(commands[:half]), block)
    assert as_rows(first) == fold(commands[:half])
    both = stream_rows.apply_stream_commands(first, frame(commands[half:]), block)
    assert as_rows(both) == fold(commands)


def test_live_rows_and_clearing(spark, tmp_path):
    commands = random_commands(9)
    parts = [commands[:50], commands[50:100], commands[100:]]
    stream = as_stream(spark, str(tmp_path / "in"), parts, COMMANDS, [0, 1, 2])
    path = drain(stream_rows.current_stream_rows(stream), tmp_path, "update")
    rows = tables.current_rows(spark, path, stream_rows.KEYS, ["seq"])
    assert as_rows(rows) == fold(commands)
    tables.compact(spark, path, str(tmp_path / "compact"), stream_rows.KEYS, ["seq"])
    assert as_rows(tables.current_rows(spark, str(tmp_path / "compact"), stream_rows.KEYS, ["seq"])) == fold(commands)
    left, removed = stream_rows.clear_streams(rows, spark.createDataFrame([(1,)], "job_id int"))
    assert {k[0] for k in as_rows(left)} == {2, 3}
    assert removed.first()["removed"] == 2


def test_missing_rows_are_left_alone(spark):
    late = [(1, 1, 0, "complete", None, "x", None, None, START), (1, 1, 1, "failed", None, None, None, "e", START)]
    assert as_rows(stream_rows.apply_stream_commands(None, spark.createDataFrame(late, COMMANDS))) == {}
    mark = [(1, 1, 2, "stage", "ocr", None, None, None, START)]
    got = stream_rows.apply_stream_commands(None, spark.createDataFrame(late + mark, COMMANDS))
    assert as_rows(got) == {(1, 1): ("ocr", "", 0, False, None, START)}


def test_page_increments_count_once(spark, tmp_path):
    ddl = "job_id int, stage string, page_num int, timestamp timestamp_ntz"
    parts = [[(1, "merge", 1, START), (1, "merge", 2, START)], [(1, "merge", 2, START), (1, "merge", 3, START)], [(2, "ocr", 1, START)]]
    stream = as_stream(spark, str(tmp_path / "in"), parts, ddl, [0, 1, 2])
    feeds.page_increments(stream, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    counts = feeds.stage_counts(spark, str(tmp_path / "t"))
    assert {(r.job_id, r.stage): r.pages_completed for r in counts.collect()} == {(1, "merge"): 3, (2, "ocr"): 1}
    totals = spark.createDataFrame([(1, 7, 3), (2, 7, 2), (3, 7, 1)], "job_id int, parent_batch_id int, total_pages int")
    events = feeds.completion_events(counts, totals)
    assert sorted((r.job_id, r.event) for r in events.collect()) == [(1, "job_complete"), (1, "stage_complete")]
    job, batch = feeds.progress_feed(counts, totals)
    assert {r.job_id: (r.status, r.progress_pct) for r in job.collect()} == {
        1: ("completed", 100.0), 2: ("processing", 50.0), 3: ("queued", 0.0)
    }
    assert batch.first()["overall_progress_pct"] == 50.0


def test_followed_rows(spark, tmp_path):
    ddl = "job_id int, status string, v int"
    parts = [[(1, "queued", 1), (2, "queued", 1)], [(1, "completed", 3)], [(1, "processing", 2)]]
    stream = as_stream(spark, str(tmp_path / "in"), parts, ddl, [0, 1, 2])
    feeds.follow_rows(stream.where(F.col("job_id") == 1), ["job_id"], ["v"], str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    got = feeds.followed_rows(spark, ["job_id"], ["v"], str(tmp_path / "t"))
    assert [(r.job_id, r.status) for r in got.collect()] == [(1, "completed")]
    with pytest.raises(ValueError):
        feeds.live_latest(stream, "x", "y", every_s=31)
