"""Scoring jobs with failing, short and oversized models."""

import pytest

from pagemill.operators import scoring
from pagemill.operators.jobs import batch_report
from pagemill.plans.extraction import extract_documents


@pytest.fixture
def pages(rows):
    return rows([(1, i, f"text {i}") for i in range(1, 17)], "job_id int, page_num int, text_in string").repartition(3)


def by_page(df, *cols):
    return {r.page_num: tuple(r[c] for c in cols) for r in df.collect()}


def test_model_is_loaded_once_per_task_and_failures_are_rows(pages):
    def load():
        calls = []

        def score(row):
            calls.append(1)
            if row["page_num"] == 3:
                raise RuntimeError("Processing failed")
            return f"{len(calls)}"

        return score

    got = by_page(scoring.score_pages(pages.coalesce(1), load), "text", "success", "error")
    assert got[3] == ("", False, "Processing failed")
    assert sorted(int(t) for t, ok, _ in got.values() if ok) == [n for n in range(1, 17) if n != int_position(got, 3)]


def int_position(got, page):
    """The one call number that is missing: that of the failed page."""
    used = {int(t) for t, ok, _ in got.values() if ok}
    return next(iter(set(range(1, 17)) - used))


@pytest.mark.parametrize("size, batches", [(4, 4), (8, 2), (16, 1)])
def test_batches_keep_order(pages, size, batches):
    def load():
        return lambda rows, single=False: [{"text": r["text_in"], "success": True} for r in rows]

    got = by_page(scoring.score_batches(pages, load, size), "text", "batch_no", "batch_index", "batch_success")
    assert {b for _, b, _, _ in got.values()} == set(range(batches))
    assert all(got[p] == (f"text {p}", (p - 1) // size, (p - 1) % size, True) for p in got)


def test_partial_missing_and_unsupported_batches(pages):
    def load_partial():
        def score(rows, single=False):
            out = [{"text": "t", "success": r["page_num"] != 3, "error": None} for r in rows]
            return out[:3]

        return score

    got = by_page(scoring.score_batches(pages.where("page_num <= 8"), load_partial, 4), "text", "success", "batch_success")
    assert got[3] == ("t", False, False) and got[4] == ("", False, False) and got[1] == ("t", True, False)

    def load_single():
        def score(rows, single=False):
            if not single:
                raise NotImplementedError
            return [{"text": "one", "success": True}]

        return score

    got = by_page(scoring.score_batches(pages, load_single, 8), "text", "success")
    assert set(got.values()) == {("one", True)} and len(got) == 16


def test_retry_ladder_and_fallback():
    seen = []

    def fn(row, scale):
        seen.append(scale)
        if scale > row["fits"]:
            raise RuntimeError("CUDA out of memory")
        return "ok"

    scorer = scoring.with_retry(fn, [1.0, 0.75, 0.5], scoring.is_oom_error)
    out = scorer({"fits": 0.6})
    assert (str(out), out.attempts, out.scale, seen) == ("ok", 3, 0.5, [1.0, 0.75, 0.5])
    with pytest.raises(RuntimeError):
        scorer({"fits": 0.1})

    def wrong(row, scale):
        raise ValueError("bad page")

    with pytest.raises(ValueError) as e:
        scoring.with_retry(wrong, [1.0, 0.5], scoring.is_oom_error)({})
    assert e.value.attempts == 1

    waits = []

    def fails(row):
        raise TimeoutError("slow")

    chain = scoring.with_fallback([("a", fails), ("b", lambda r: "fine")], retries=2, sleep=waits.append)
    out = chain({})
    assert (str(out), out.model, out.attempts, waits) == ("fine", "b", 4, [1.0, 2.0])
    with pytest.raises(TimeoutError):
        scoring.with_fallback([("a", fails)], sleep=waits.append)({})


def test_document_job_resumes(spark, rows, tmp_path):
    pages = rows([(1, i, "embedded line %d" % i) for i in range(1, 11)], "job_id int, page_num int, embedded_text string")

    def load(broken):
        def make():
            def score(row):
                if row["page_num"] in broken:
                    raise RuntimeError("oom")
                return f"scan {row['page_num']} {len(broken)}"

            return score

        return make

    cache = str(tmp_path / "cache")
    _, missing = extract_documents(pages, load({4, 7}), cache)
    assert sorted(r.page_num for r in missing.collect()) == [4, 7]
    docs, missing = extract_documents(pages, load(set()), cache, run=2)
    assert missing.isEmpty()
    content = docs.first()["content"]
    assert "scan 4 0" in content and "scan 5 2" in content and content.count("<!-- Page") == 10


def test_a_repeated_resumed_run_loses_nothing(rows, tmp_path):
    pages = rows([(1, i, "line %d of the page" % i) for i in range(1, 11)], "job_id int, page_num int, embedded_text string")

    def load(broken):
        def make():
            def score(row):
                if row["page_num"] in broken:
                    raise RuntimeError("oom")
                return "scan"

            return score

        return make

    cache = str(tmp_path / "cache")
    docs, missing = extract_documents(pages, load({4, 5, 6}), cache)
    assert missing.count() == 3 and not docs.first()["is_complete"]
    for _ in range(2):
        docs, missing = extract_documents(pages, load(set()), cache, run=2)
        assert missing.isEmpty() and docs.first()["is_complete"]


def test_all_validators_count(rows):
    pages = rows([(1, 1, "abc"), (1, 2, "abd")], "job_id int, page_num int, text string")
    checks = [lambda r: (True, ""), lambda r: (True, ""), lambda r: (r["text"] != "abd", "third")]
    got = {r.page_num: (r.valid, r.issues, r.text) for r in scoring.validate_and_refine(pages, checks, lambda: lambda r: "new").collect()}
    assert got[1][0] and got[2] == (False, "third", "new")


def test_columns_pass_unchanged_and_lists_are_scored(rows):
    ddl = "job_id bigint, page_num bigint, other bigint, seen timestamp, tags array<string>"
    data = [(9007199254740993, 1, None, None, None), (9007199254740995, 2, 9007199254740997, None, ["a", None])]
    pages = rows(data, ddl)

    def load():
        return lambda batch: [ValueError("bad") if r["page_num"] == 1 else f"p{r['page_num']}" for r in batch]

    got = {r.page_num: r for r in scoring.score_pages(pages, load, batched=True).collect()}
    assert [tuple(got[i])[:5] for i in (1, 2)] == [data[0], data[1]]
    assert (got[1].success, got[1].error, got[2].text) == (False, "bad", "p2")
    short = scoring.score_pages(pages.coalesce(1), lambda: lambda batch: ["only one"], batched=True).collect()
    assert sorted(r.success for r in short) == [False, True]


def test_a_ladder_is_not_cut():
    with pytest.raises(ValueError):
        scoring.with_retry(lambda row, scale: "", [1.0] * 6, scoring.is_oom_error, max_attempts=5)


def test_batch_report(rows):
    jobs = rows(
        [(1, 1, "completed", 100.0, None, None), (2, 1, "processing", 50.0, None, None)],
        "job_id int, parent_batch_id int, status string, progress_pct double, started_at timestamp_ntz, completed_at timestamp_ntz",
    )
    r = batch_report(jobs).first()
    assert (r.status, r.is_partial, r.overall_progress_pct, r.failed_files) == ("completed", True, 75.0, 0)
