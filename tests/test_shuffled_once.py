"""Wide rows are shuffled once, and costly rows computed once."""

import re

from pagemill.operators import jobs as oj
from pagemill.plans import all_queries


def test_contents_shared_by_jobs_are_joined_by_their_own_key(spark, rows):
    """F8."""
    jobs = rows(
        [(1, 10, 7, "a", "completed", None), (1, 11, 7, "a", "completed", None), (2, 12, 8, "b", "failed", "no"), (2, 13, 8, "b", "queued", None),
         (2, 14, 9, "c", "completed", None)],
        "parent_batch_id int, job_id int, file_id int, filename string, status string, error_message string",
    )
    texts = rows([(7, 0, "x"), (7, 1, "y"), (8, 0, "z")], "file_id int, part bigint, content string")
    by_file = oj.finished_documents(jobs, texts, on="file_id")
    by_job = oj.finished_documents(jobs, jobs.join(texts, "file_id").select("job_id", "part", "content"))
    assert sorted(map(str, by_file.collect())) == sorted(map(str, by_job.collect()))
    assert by_file.count() == 5


def test_only_the_users_pages_are_upserted(spark):
    """the semi join lies below the upsert even where no side is small enough to be broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = all_queries()["pages_of_user"].build(spark, "/root/testdata/sf0.001")
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert re.search(r"Aggregate.*Join LeftSemi", plan, re.S)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_stored_runs_compute_their_pages_once(spark, monkeypatch):
    """the upsert is in none of the plans that write a run."""
    from pagemill.plans import queries_scoring as q

    plans, write = [], q.sc.write_ocr_cache

    def seen(df, path, run):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        write(df, path, run)

    monkeypatch.setattr(q.sc, "write_ocr_cache", seen)
    all_queries()["cached_stage_results"].build(spark, "/root/testdata/sf0.001")
    assert len(plans) == 3 and not any("Aggregate" in p for p in plans)


def test_texts_are_not_joined_to_their_pages_again(spark):
    """the first run of the two-stage job reads pages and texts together; jobs alone are joined."""
    df = all_queries()["two_stage_documents"].build(spark, "/root/testdata/sf0.001")
    joins = re.findall(r"Join [^\n]*", df._jdf.queryExecution().optimizedPlan().toString())
    assert joins and not any("page_num" in j for j in joins)
