"""Readers and writers on small files."""

import os
from datetime import datetime

from pyspark.sql import functions as F

from pagemill.operators.monitoring import alerts, job_summary, metrics_history, with_event_time
from pagemill.sources import cache, documents, files, logs

NOW = datetime(2024, 1, 1)


def test_register_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.PDF").write_bytes(b"x" * 100)
    (tmp_path / "sub" / "b.bin").write_bytes(b"y")
    df = files.register_files(spark, str(tmp_path), "u", NOW)
    got = {r.filename: (r.content_type, r.size_bytes, r.expires_at) for r in df.collect()}
    assert got == {
        "a.PDF": ("application/pdf", 100, datetime(2024, 1, 1, 6)),
        "b.bin": ("application/octet-stream", 1, datetime(2024, 1, 1, 6)),
    }
    assert "content" not in df._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_metrics_log(spark, tmp_path):
    lines = [
        '{"timestamp":"2024-01-01T00:00:00.000000Z","event_type":"stage_transition","to_stage":"merge"}',
        "",
        "   ",
        '{"timestamp":"2024-01-01T00:0',
        '{"event_type":"page_completion","page_number":3,"stage":"ocr"}',
        '{"timestamp":"2024-01-01T00:01:30.250000Z","job_id":"own","gpus":[{"id":0,"memory_used_mb":99.0,"memory_total_mb":100.0}],'
        '"system":{"cpu_percent":97.0,"ram_percent":1.0}}',
    ]
    (tmp_path / "job-7.syslog.jsonl").write_text("\n".join(lines) + "\n")
    log = with_event_time(logs.read_metrics_log(spark, str(tmp_path)))
    assert log.count() == 3
    assert logs.metrics_log_rejects(spark, str(tmp_path)).first()["rejects"] == 1
    assert sorted(r.job_id for r in log.collect()) == ["job-7", "job-7", "own"]
    window = metrics_history(log, datetime(2024, 1, 1, 1, 1), minutes=60)
    assert window.count() == 2 and window.where("timestamp IS NULL").count() == 1
    flat = log.withColumns(
        {"event_id": F.monotonically_increasing_id(), "cpu_percent": F.col("system.cpu_percent"), "ram_percent": F.col("system.ram_percent")}
    )
    found = alerts(flat.where("gpus IS NOT NULL")).collect()
    assert [(r.type, r.message) for r in found] == [
        ("error", "GPU 0 memory critical: 99.0%"), ("error", "CPU usage critical: 97.0%")
    ]
    summary = {r.job_id: r for r in job_summary(flat).collect()}
    assert summary["job-7"].stage_transitions == 1 and summary["job-7"].duration_seconds == 0.0


def test_log_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01T00:00:00Z", "j", "metric")], "timestamp string, job_id string, event_type string")
    path = str(tmp_path / "log")
    logs.write_metrics_log(df, path)
    logs.write_metrics_log(df, path)
    assert logs.read_metrics_log(spark, path).count() == 2


def test_ocr_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    ddl = "job_id int, page_num int, ocr_text string"
    cache.write_ocr_cache(spark.createDataFrame([(1, 1, "old"), (1, 2, "two"), (2, 1, "x")], ddl), path, run=1)
    cache.write_ocr_cache(spark.createDataFrame([(1, 1, "gone")], ddl), path, run=2)
    cache.write_ocr_cache(spark.createDataFrame([(1, 1, "new")], ddl), path, run=2)
    got = cache.read_ocr_cache(spark, path, job_ids=[1])
    assert sorted((r.page_num, r.ocr_text) for r in got.collect()) == [(1, "new"), (2, "two")]
    only = cache.read_ocr_cache(spark, path, spark.createDataFrame([(2,)], "job_id int"))
    assert [r.ocr_text for r in only.collect()] == ["x"]


def test_document_files(spark, tmp_path):
    pages = spark.createDataFrame(
        [(1, 2, "ocr", 0.5, "second"), (1, 1, "hybrid", 1.0, "first\nline"), (2, 1, "ocr", 0.0, "")],
        "job_id int, page_num int, method string, processing_time double, text string",
    )
    documents.write_document(pages, str(tmp_path / "docs"))
    folder = tmp_path / "docs" / "job_id=1" / "part=0"
    (name,) = [f for f in os.listdir(folder) if f.endswith(".txt")]
    assert (folder / name).read_text() == (
        "<!-- Page 1 | Method: HYBRID | Time: 1.00s | Chars: 10 -->\nfirst\nline\n\n"
        "<!-- Page 2 | Method: OCR | Time: 0.50s | Chars: 6 -->\nsecond\n\n"
    )


def test_read_pages_and_events(spark, tmp_path):
    path = str(tmp_path / "pages")
    spark.createDataFrame([("j", 1, "text", 1.0, 2.0, True)], "job_id string, page_num int, embedded_text string, width double, height double, has_text boolean").write.json(path)
    assert files.read_pages(spark, path, "json").first()["embedded_text"] == "text"
    event = spark.createDataFrame([(1, "j")], "event_id int, job_id string")
    files.append_job_events(event, str(tmp_path / "e"))
    files.append_job_events(event, str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).count() == 2


def test_export(spark):
    log = spark.createDataFrame([(1, 90.0, 10.0, 0), (2, 70.0, 20.0, 1)], "event_id int, cpu_percent double, ram_percent double, gpu_id int")
    found = spark.createDataFrame([("warning", "CPU")], "type string, message string")
    lines = {r.kind: r.json for r in logs.export_metrics(log, found, NOW).collect()}
    assert '"avg_cpu":80.0' in lines["summary"] and '"total_gpus":2' in lines["summary"]
    assert set(lines) == {"summary", "history", "alert"}
