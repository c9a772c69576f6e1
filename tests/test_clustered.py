"""Clustered tables: lookups read few row groups, logs skip days; stage tables meet a page once."""

import glob
import os
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pagemill.operators import monitoring as om
from pagemill.plans import extraction
from pagemill.sources import clustered as cl


def scan_metrics(df):
    """Figures of the scan under a collected frame."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    stack, found = [plan], {}
    while stack:
        node = stack.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            stack.append(node.plan())
        if kind == "FileSourceScanExec":
            it = node.metrics().iterator()
            while it.hasNext():
                pair = it.next()
                found[pair._1()] = found.get(pair._1(), 0) + pair._2().value()
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return found


def test_a_lookup_reads_a_bounded_number_of_rows(spark, tmp_path):
    path = str(tmp_path / "jobs")
    n = 200_000
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("job_id"), F.repeat(F.col("id").cast("string"), 20).alias("text"))
    cl.write_clustered(df, path, ["job_id"], files=4, row_group_bytes=256 << 10)
    groups = [pq.ParquetFile(f).metadata.row_group(i) for f in glob.glob(f"{path}/*.parquet") for i in range(pq.ParquetFile(f).num_row_groups)]
    assert len(groups) > 8
    largest = max(g.num_rows for g in groups)
    hit = cl.lookup(spark, path, "job_id", [777])
    rows = scan_metrics(hit)["numOutputRows"]
    assert [r.job_id for r in hit.collect()] == [777] and rows <= largest
    assert "PushedFilters: [IsNotNull(job_id), EqualTo(job_id,777)]" in hit._jdf.queryExecution().toString()
    assert scan_metrics(cl.lookup(spark, path, "job_id", [n + 5]))["numOutputRows"] == 0
    assert {r.job_id for r in cl.lookup(spark, path, "job_id", [1, 199_999]).collect()} == {1, 199_999}


def test_a_hot_key_is_split_over_files(spark, tmp_path):
    path = str(tmp_path / "events")
    df = spark.range(40_000).select(F.when(F.col("id") % 4 == 0, F.col("id")).otherwise(7).alias("job_id"), F.col("id").alias("event_id"))
    cl.write_clustered(df.withColumn("x", F.lit(None).cast("int")), path, ["job_id", "event_id"], files=8)
    rows = [pq.ParquetFile(f).metadata.num_rows for f in glob.glob(f"{path}/*.parquet")]
    assert max(rows) < 3 * 40_000 / 8
    assert cl.lookup(spark, path, "job_id", [7]).count() == 30_000


def test_log_by_day_skips_folders_and_keeps_rows_without_a_time(spark, tmp_path):
    now = datetime(2024, 1, 20, 0, 30)
    rows = [(k, k % 3, datetime(2024, 1, 1) + timedelta(hours=k), "metric") for k in range(24 * 25)] + [(-1, 1, None, "metric")]
    log = spark.createDataFrame(rows, "event_id bigint, job_id int, timestamp timestamp_ntz, event_type string")
    path = str(tmp_path / "log")
    cl.write_log_by_day(log.where("event_id < 100"), path)
    cl.write_log_by_day(log.where("event_id >= 100"), path)
    recent = cl.read_log_since(spark, path, cl.history_cutoff(now, 60))
    got = om.metrics_history(recent, now, 60)
    want = om.metrics_history(log, now, 60)
    assert sorted(map(str, got.select(log.columns).collect())) == sorted(map(str, want.collect()))
    assert "PartitionFilters: [(isnull(day" in got._jdf.queryExecution().toString()
    assert scan_metrics(recent)["numPartitions"] == 8  # 19 to 25 January and the rows without a time
    assert len([d for d in os.listdir(path) if d.startswith("day=")]) == 26


@pytest.fixture
def counted(tmp_path):
    """A scorer that leaves a file per call, fails on some pages, and the number of calls."""
    folder = tmp_path / "calls"
    folder.mkdir()

    def loader(name, fails=()):
        def load():
            def score(row):
                import uuid

                (folder / f"{name}-{row['job_id']}-{row['page_num']}-{uuid.uuid4().hex}").touch()
                if row["page_num"] in fails:
                    raise ValueError("model failed")
                return f"{name}({row['ocr_text'] if name == 'merge' else row['merged']})"

            return score

        return load

    return loader, lambda name: sorted(f.rsplit("-", 1)[0] for f in os.listdir(folder) if f.startswith(f"{name}-"))


def test_each_page_meets_a_model_once_and_failures_are_asked_again(spark, tmp_path, counted):
    load, calls = counted
    pages = spark.createDataFrame([(1, k, f"text {k}", f"ocr {k}") for k in range(1, 4)], "job_id int, page_num int, embedded_text string, ocr_text string")
    path = str(tmp_path / "stage")
    ask = lambda run, fails=(): extraction.stage_texts(pages, ["embedded_text", "ocr_text"], load("merge", fails), "merge", path, run, "merged")
    first = ask(1, fails=(2,))
    for _ in range(3):  # however often the result is read
        got = {r.page_num: r.merged for r in first.collect()}
    assert got == {1: "merge(ocr 1)", 2: None, 3: "merge(ocr 3)"}
    assert calls("merge") == ["merge-1-1", "merge-1-2", "merge-1-3"]
    assert {r.page_num: r.merged for r in ask(2).collect()} == {k: f"merge(ocr {k})" for k in range(1, 4)}
    assert calls("merge") == ["merge-1-1", "merge-1-2", "merge-1-2", "merge-1-3"]
    pages = pages.withColumn("ocr_text", F.when(F.col("page_num") == 3, "better").otherwise(F.col("ocr_text")))
    assert {r.page_num: r.merged for r in ask(3).collect()}[3] == "merge(better)"
    assert calls("merge").count("merge-1-3") == 2 and calls("merge").count("merge-1-1") == 1
