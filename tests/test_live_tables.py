"""Tables that streams feed: restarts, bucketed upserts, stored starting rows, timers, completions."""

import glob
import os
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pagemill.operators.mutations import partial_update, upsert
from pagemill.streaming import completions, feeds, snapshots, stream_rows, tables, upserts
from tests.test_streaming import CHUNKS, COMMANDS, START, as_rows, as_stream, fold, random_commands

CHANGES = "job_id int, page_num int, v int, a string, b string"
KEYS = ["job_id", "page_num"]
PARTS = [
    [(1, 1, 5, "new", None), (1, 2, 1, "x", "y"), (2, 1, 1, None, "z"), (None, 1, 1, "q", "q")],
    [(1, 1, 3, "old", "kept"), (1, 1, 4, None, "newer"), (2, 1, 2, "late", None), (9, 1, 1, "unknown job", None)],
    [(1, 2, 1, "x", "y"), (1, None, 2, "no page", None), (2, 2, 1, "only", "only")],
]


@pytest.mark.parametrize("order", [[0, 1, 2], [2, 1, 0]])
def test_upserts_in_any_order_equal_the_batch_form(spark, tmp_path, order):
    stream = as_stream(spark, str(tmp_path / "in"), PARTS, CHANGES, order)
    path = str(tmp_path / "t")
    known = spark.createDataFrame([(1,), (2,)], "id int")
    upserts.write_upserts(stream, path, str(tmp_path / "c"), KEYS, F.col("v"), ["a", "b"], known, buckets=4).awaitTermination()
    flat = [c for p in PARTS for c in p if c[0] in (1, 2) and c[1] is not None]
    want = upsert(None, spark.createDataFrame(flat, CHANGES), KEYS, F.col("v"), ["a", "b"])
    got = upserts.upserted_rows(spark, path, KEYS, 4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert (1, 1, "new", "newer") in set(map(tuple, got.collect()))
    one = upserts.upserted_rows(spark, path, KEYS, 4, spark.createDataFrame([(1, 2)], "job_id int, page_num int"))
    assert list(map(tuple, one.collect())) == [(1, 2, "x", "y")]


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda rows: spark.createDataFrame(rows, CHANGES)
    upserts.upsert_changes(path, frame([(j, 1, 1, f"a{j}", None) for j in range(40)]), KEYS, F.col("v"), ["a", "b"], 8)
    files = lambda: set(glob.glob(f"{path}/{upserts.BUCKET}=*/*.parquet"))
    before = files()
    one = frame([(7, 1, 2, "changed", None)])
    bucket = one.select(upserts.bucket_of(KEYS, 8)).first()[0]
    upserts.upsert_changes(path, one, KEYS, F.col("v"), ["a", "b"], 8)
    after = files()
    changed = {os.path.basename(os.path.dirname(f)) for f in before ^ after}
    assert changed == {f"{upserts.BUCKET}={bucket}"}
    rows = {r.job_id: r.a for r in upserts.upserted_rows(spark, path, KEYS, 8).collect()}
    assert len(rows) == 40 and rows[7] == "changed" and rows[8] == "a8"
    assert len(after) <= 8  # a file per bucket
    upserts.upsert_changes(path, one, KEYS, F.col("v"), ["a", "b"], 8)  # a repeated micro-batch
    assert upserts.upserted_rows(spark, path, KEYS, 8).count() == 40
    upserts.upsert_changes(path, frame([]), KEYS, F.col("v"), ["a", "b"], 8)
    assert upserts.upserted_rows(spark, path, KEYS, 8).count() == 40


def test_a_second_stream_keeps_the_rows_of_the_first(spark, tmp_path):
    ddl = "job_id int, v int"
    path = str(tmp_path / "t")
    for k, rows in enumerate([[(1, 1), (2, 1)], [(3, 1), (1, 5)]]):
        stream = as_stream(spark, str(tmp_path / f"in{k}"), [rows], ddl, [0])
        feeds.follow_rows(stream, ["job_id"], ["v"], path, str(tmp_path / f"c{k}")).awaitTermination()
    got = feeds.followed_rows(spark, ["job_id"], ["v"], path)
    assert sorted(map(tuple, got.collect())) == [(1, 5), (2, 1), (3, 1)]
    tables.compact(spark, path, str(tmp_path / "t2"), ["job_id"], ["v"])
    stream = as_stream(spark, str(tmp_path / "in2"), [[(2, 9)]], ddl, [0])
    feeds.follow_rows(stream, ["job_id"], ["v"], str(tmp_path / "t2"), str(tmp_path / "c1b")).awaitTermination()
    got = feeds.followed_rows(spark, ["job_id"], ["v"], str(tmp_path / "t2"))
    assert sorted(map(tuple, got.collect())) == [(1, 5), (2, 9), (3, 1)]


def test_rows_go_on_from_the_table_after_a_lost_checkpoint(spark, tmp_path):
    commands = random_commands(4)
    path = str(tmp_path / "t")
    first = as_stream(spark, str(tmp_path / "in1"), [commands[:60]], COMMANDS, [0])
    tables.write_updates(stream_rows.current_stream_rows(first), path, str(tmp_path / "c1"), mode="update").awaitTermination()
    tables.current_rows(spark, path, stream_rows.KEYS, ["seq"]).write.parquet(str(tmp_path / "start"))
    stored = spark.read.parquet(str(tmp_path / "start"))
    rest = as_stream(spark, str(tmp_path / "in2"), [commands[60:100], commands[100:]], COMMANDS, [0, 1])
    live = stream_rows.current_stream_rows(rest, initial=stored)
    tables.write_updates(live, path, str(tmp_path / "c2"), mode="update").awaitTermination()
    assert as_rows(tables.current_rows(spark, path, stream_rows.KEYS, ["seq"])) == fold(commands)


def test_ends_of_jobs_clear_their_pages(spark, tmp_path):
    commands = random_commands(6)
    end = lambda job, no: (job, None, no, "finish", None, None, None, None, START)
    again = [(1, 7, 900, "stage", "ocr", None, None, None, START), end(1, 901)]
    parts = [commands, [end(1, 500), end(3, 500), end(8, 500)], again]
    stream = as_stream(spark, str(tmp_path / "in"), parts, COMMANDS, [0, 1, 2])
    path = str(tmp_path / "t")
    tables.write_updates(stream_rows.cleared_stream(stream, slots=3), path, str(tmp_path / "c"), mode="update").awaitTermination()
    got = {r.job_id: r.n for r in tables.stored_rows(spark, path).groupBy("job_id").agg(F.sum("removed").alias("n")).collect()}
    pages = [k[0] for k in fold(commands)]
    assert got == {1: pages.count(1) + 1, 3: pages.count(3), 8: 0}


PAGES = "job_id int, stage string, page_num int, timestamp timestamp_ntz"


def _at(s):
    return START + timedelta(seconds=s)


def test_completions_come_once_whatever_comes_first(spark, tmp_path):
    pages = [
        [(1, "ocr", 1, _at(1)), (1, "ocr", 1, _at(2)), (2, "merge", 5000, _at(3)), (None, "ocr", 1, _at(1)), (4, "ocr", None, _at(1))],
        [(1, "ocr", 2, _at(4)), (2, "merge", 1, _at(2)), (3, "merge", 1, _at(1))],
        [(1, "ocr", 2, _at(9)), (1, "merge", 1, _at(5)), (1, "merge", 2, _at(6))],
    ]
    path, check = str(tmp_path / "t"), str(tmp_path / "c")

    def run(page_parts, total_parts):
        p = as_stream(spark, str(tmp_path / "pages"), page_parts, PAGES, range(len(page_parts)))
        t = as_stream(spark, str(tmp_path / "totals"), total_parts, "job_id int, total_pages int", range(len(total_parts)))
        tables.write_updates(completions.completion_stream(p, t), path, check).awaitTermination()
        return sorted((r.job_id, r.stage, r.event, r.timestamp) for r in tables.stored_rows(spark, path).collect())

    first = run(pages[:2], [[(1, 2)], [(3, 2), (5, 0)]])
    assert first == [(1, "ocr", "stage_complete", _at(4))]
    # After a restart: the total of job 2 comes after its pages, and pages of finished stages come again.
    second = run(pages[2:], [[(2, 2), (1, 2)]])
    assert second == sorted(first + [
        (1, "merge", "job_complete", _at(6)), (1, "merge", "stage_complete", _at(6)),
        (2, "merge", "job_complete", _at(3)), (2, "merge", "stage_complete", _at(3)),
    ])


def test_an_idle_page_is_flushed_and_forgotten(spark, tmp_path):
    rows = [(1, 1, k, f"t{k};", START + timedelta(milliseconds=k), False) for k in range(3)]
    stream = as_stream(spark, str(tmp_path / "in"), [rows], CHUNKS, [0])
    out = snapshots.throttle_snapshot_stream(stream, ms=1000, tokens=50, idle_ms=500)
    query = tables.write_updates(out, str(tmp_path / "t"), str(tmp_path / "c"), every_s=0.2)
    try:
        deadline, found = time.time() + 60, []
        while not found and time.time() < deadline:
            time.sleep(1)
            if glob.glob(str(tmp_path / "t" / "query=*" / "*" / "*.parquet")):
                found = tables.stored_rows(spark, str(tmp_path / "t")).collect()
        left = None
        while left != 0 and time.time() < deadline:
            time.sleep(0.5)
            progress = query.lastProgress
            left = progress["stateOperators"][0]["numRowsTotal"] if progress and progress["stateOperators"] else None
    finally:
        query.stop()
    assert [(r.snapshot_no, r.tokens, r.part_text, r.is_final) for r in found] == [(1, 3, "t0;t1;t2;", False)]
    assert left == 0


def test_partial_update_keeps_the_number_of_rows(rows):
    df = rows([(1, "a", 1), (2, "b", 2), (None, "n", 3)], "id int, s string, n int")
    twice = rows([(1, "x", None, 1), (1, None, 9, 2), (1, "old", None, 0), (None, "q", 7, 1), (5, "no row", 1, 1)], "id int, s string, n int, v int")
    got = partial_update(df, twice, "id", version="v").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, "x", 9), (2, "b", 2), (None, "n", 3)]))
    with pytest.raises(Exception, match="several changes of key 1"):
        partial_update(df, twice.drop("v"), "id").collect()
    cleared = rows([(2, None, ["s"])], "id int, s string, supplied array<string>")
    assert (2, None, 2) in set(map(tuple, partial_update(df, cleared, "id").collect()))
