"""Streams whose state is folded per micro-batch, against a fold in plain Python, over more batches than state is kept apart for."""

import random
from datetime import datetime, timedelta
from types import SimpleNamespace

from pyspark.sql import functions as F

from pagemill.sources import standins
from pagemill.streaming import completions, stream_rows, tables

START = datetime(2024, 1, 1)
COMMANDS = (
    "job_id int, page_num int, order_no bigint, kind string, stage string, snapshot_text string,"
    " is_final boolean, error string, updated_at timestamp_ntz"
)


def command(rng, n, kinds):
    kind = rng.choice(kinds)
    page = None if kind == "finish" else rng.choice([1, 2, None])
    text = f"t{n}" if kind in ("snapshot", "complete") else None
    final = rng.choice([True, False, None]) if kind == "snapshot" else None
    stage = "ocr" if kind in ("snapshot", "stage") else None
    return (rng.randint(1, 3), page, n, kind, stage, text, final, f"e{n}" if kind == "failed" else None, START + timedelta(seconds=n))


def batches(kinds, n=10, size=7, seed=5):
    rng = random.Random(seed)
    return [[command(rng, b * size + i, kinds) for i in range(size)] for b in range(n)]


def staged(spark, frames, ddl, path):
    """One file per frame, one per micro-batch."""
    for rows in frames:
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(path)


def folded(frames):
    """Rows per page, and rows removed per job, as the commands give them one by one."""
    held, removed = {}, {}
    for job, page, _, kind, stage, text, final, error, at in (c for f in frames for c in f):
        if kind == "finish":
            gone = [k for k in held if k[0] == job]
            removed[job] = removed.get(job, 0) + len(gone)
            for k in gone:
                del held[k]
            continue
        c = SimpleNamespace(kind=kind, stage=stage, snapshot_text=text, is_final=bool(final), error=error, at=at)
        row = stream_rows.applied(held.get((job, page)), c)
        if row is not None:
            held[job, page] = row
    return held, removed


def test_stream_rows_are_folded_per_batch(spark, tmp_path):
    """F11, F12."""
    frames = batches(["snapshot", "stage", "complete", "failed"])
    stream = staged(spark, frames, COMMANDS, f"{tmp_path}/in")
    stream_rows.write_stream_rows(stream, f"{tmp_path}/table", f"{tmp_path}/check").awaitTermination()
    got = tables.current_rows(spark, f"{tmp_path}/table", stream_rows.KEYS, ["seq"]).select(
        *stream_rows.KEYS, "stage", "snapshot_text", "seq", "is_final", "error", "updated_at"
    )
    want, _ = folded(frames)
    assert {(r[0], r[1]): list(r[2:]) for r in got.collect()} == want


def test_ends_of_jobs_clear_their_rows(spark, tmp_path):
    """ends between other commands, of jobs with and without rows, and jobs that start anew."""
    frames = batches(["snapshot", "stage", "complete", "failed", "finish"])
    stream = staged(spark, frames, COMMANDS, f"{tmp_path}/in")
    stream_rows.write_cleared(stream, f"{tmp_path}/table", f"{tmp_path}/check").awaitTermination()
    got = tables.stored_rows(spark, f"{tmp_path}/table").groupBy("job_id").agg(F.sum("removed")).collect()
    _, want = folded(frames)
    assert dict(map(tuple, got)) == {j: n for j, n in want.items() if n}


def test_completions_are_given_once(spark, tmp_path):
    """repeated pages, later totals, pages before and after the total."""
    at = lambda s: START + timedelta(seconds=s)
    pages = [[(1, "ocr", 1, at(1)), (1, "ocr", 1, at(9)), (2, "merge", 1, at(2))], [(1, "ocr", 2, at(3)), (2, "merge", 1, at(4))],
             [(1, "ocr", 2, at(20)), (2, "merge", 2, at(5)), (None, "ocr", 1, at(1))], [(3, "ocr", 1, at(1))]]
    totals = [[(1, 2)], [(1, 2), (2, 0)], [(2, 2)], [(2, 2), (3, 5)]]
    p = staged(spark, pages, "job_id int, stage string, page_num int, timestamp timestamp_ntz", f"{tmp_path}/p")
    t = staged(spark, totals, "job_id int, total_pages int", f"{tmp_path}/t")
    completions.write_completions(p, t, f"{tmp_path}/table", f"{tmp_path}/check").awaitTermination()
    got = sorted(map(tuple, tables.stored_rows(spark, f"{tmp_path}/table").collect()))
    assert got == [(1, "ocr", at(9), "stage_complete"), (2, "merge", at(5), "job_complete"), (2, "merge", at(5), "stage_complete")]


def test_staged_frames_are_written_by_many_tasks_and_come_in_order(spark):
    """no frame is written by one task alone."""
    parts = [spark.range(1000).select(F.col("id").alias("k"), F.lit(n).alias("n")) for n in range(3)]
    stream = standins.micro_batches(parts, ["k"])
    staged_at = stream._jdf.queryExecution().analyzed().collectLeaves().head().dataSource().options()
    assert int(staged_at.apply("maxFilesPerTrigger")) > 1
    seen = []
    stream.writeStream.foreachBatch(lambda b, i: seen.append({r.n for r in b.select("n").distinct().collect()})).trigger(
        availableNow=True
    ).start().awaitTermination()
    assert seen == [{0}, {1}, {2}]
