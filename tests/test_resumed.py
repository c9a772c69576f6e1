"""a resumed run joins texts once, and its results are those of the stage table."""

import re

import pytest

from pagemill.functions import text as ft
from pagemill.operators import documents as od
from pagemill.plans import all_queries
from pagemill.plans.extraction import stage_one
from pagemill.session import scratch_dir
from pyspark.sql import functions as F

PAGES = "job_id int, page_num int, embedded_text string"


def _reader(fails):
    def read(row):
        if row["page_num"] in fails:
            raise RuntimeError("out of memory")
        return "scan of " + (row["embedded_text"] or "")

    return lambda: read


def _seen(frame):
    return sorted(map(str, frame.select("job_id", "page_num", "embedded_text", "route", "ocr_text").collect()))


def _expected(frame, failed):
    return sorted(
        f"Row(job_id={r.job_id}, page_num={r.page_num}, embedded_text={r.embedded_text!r}, route='hybrid',"
        f" ocr_text={None if r.page_num in failed or r.page_num is None else 'scan of ' + r.embedded_text!r})"
        for r in frame.collect()
    )


def test_texts_are_joined_once(spark):
    df = all_queries()["resumed_documents"].build(spark, "/root/testdata/sf0.001")
    joins = re.findall(r"Join [^\n]*", df._jdf.queryExecution().optimizedPlan().toString())
    assert sum("page_num" in j for j in joins) == 1


def test_pages_without_a_text_are_read_from_the_last_run(spark, rows):
    pages = rows([(1, n, f"page number {n}") for n in range(1, 9)] + [(None, 9, "page of no job"), (1, None, "no page number")], PAGES)
    path = scratch_dir(spark, "test-resume")
    stage_one(pages, _reader({2, 4, 6}), path)
    merged, missing = stage_one(pages, _reader({4}), path, run=2)
    assert "Join" not in missing._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, missing.collect()), key=str) == [(1, 4), (1, None), (None, 9)]
    want = [r.replace("'scan of page of no job'", "None") for r in _expected(pages, {4})]
    assert _seen(merged) == sorted(want)


def test_changed_pages_keep_their_stored_texts(spark, rows):
    """Texts of earlier runs belong to their pages as they are now; pages that are gone do not come back, new ones are scored."""
    path = scratch_dir(spark, "test-resume")
    stage_one(rows([(1, 1, "the first page"), (1, 2, "the second page"), (1, 3, "the third page")], PAGES), _reader({2}), path)
    now = rows([(1, 1, "the first page, changed"), (1, 2, "the second page, changed"), (1, 4, "a fourth page")], PAGES)
    merged, missing = stage_one(now, _reader(set()), path, run=2)
    got = {r.page_num: (r.embedded_text, r.ocr_text) for r in merged.collect()}
    assert got == {
        1: ("the first page, changed", "scan of the first page"),
        2: ("the second page, changed", "scan of the second page, changed"),
        4: ("a fourth page", "scan of a fourth page"),
    }
    assert missing.count() == 0


def test_pages_that_need_no_model_stay_in_a_resumed_run(spark, rows):
    pages = rows([(1, 1, "text enough to extract"), (1, 2, "short"), (1, 3, "")], PAGES)
    path = scratch_dir(spark, "test-resume")
    stage_one(pages, _reader({2}), path, method="extract")
    merged, missing = stage_one(pages, _reader({3}), path, method="extract", run=2)
    assert {r.page_num: (r.route, r.ocr_text) for r in merged.collect()} == {1: ("embedded", None), 2: ("ocr", "scan of short"), 3: ("ocr", "scan of ")}
    assert missing.count() == 0


def test_a_repeated_first_run_yields_to_a_later_one(spark, rows):
    pages = rows([(1, n, f"page number {n}") for n in range(1, 5)], PAGES)
    path = scratch_dir(spark, "test-resume")
    stage_one(pages, _reader({2, 3}), path)
    stage_one(pages, _reader({3}), path, run=2)
    merged, missing = stage_one(pages, _reader({2, 3}), path)
    assert [tuple(r) for r in missing.collect()] == [(1, 3)]
    assert _seen(merged) == _expected(pages, {3})


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10])
def test_enough_text_is_that_of_the_stripped_text(spark, rows, n):
    texts = [None, "", " ", "a", " a ", "ab", "a b", "\t　a\nb ", "a\U0001f600", "\U0001f600\U0001f600\n", "123456789", " 1234 6789\r\n ", "1234567890", "1\n34567890 "]
    frame = rows([(t,) for t in texts], "t string")
    old = F.coalesce(F.length(ft.strip(F.col("t"))) >= n, F.lit(False))
    assert frame.where(ft.has_embedded_text(F.col("t"), n) != old).count() == 0


def test_forms_are_made_only_where_two_lines_begin_alike(spark, rows):
    """The costly form of a line stands behind the test of first words, and the result is that of all forms."""
    merged = od.rule_merge(F.col("e"), F.col("o"))
    cases = [
        ("One  line\nand two", "scan of One line\n\nand TWO", "One  line\nand two\nscan of One line"),
        ("a b", " \t\n A\tB \na c", "a b\na c"),
        ("a b", "a​b\nx", "a b\na​b\nx"),
        (" \n", "x\nX\n ", "x\nX"),
        (None, None, ""),
        ("ΣΣ x", "σς  X\ny", "ΣΣ x\ny"),
    ]
    frame = rows(cases, "e string, o string, want string")
    assert [tuple(r) for r in frame.where(~merged.eqNullSafe(F.col("want"))).select(merged, "want").collect()] == []
    plan = frame.select(merged)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("arrays_overlap") < plan.index(ft.SPACE_RUN)
