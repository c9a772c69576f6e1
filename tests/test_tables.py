"""Catalog, job and mutation operators on hand-made rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pagemill.operators import catalog, documents, jobs, mutations, prompts

NOW = datetime(2024, 1, 1, 12)


def found(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_upsert_keeps_old_values_of_null_fields(rows):
    ddl = "job_id int, page_num int, ocr_text string, merge_text string, v int"
    current = rows([(1, 1, "old", "kept", 1), (2, 1, "other", None, 1)], ddl)
    changes = rows([(1, 1, "new", None, 2), (1, 1, None, None, 3), (1, 2, "x", "y", 1), (9, 1, "orphan", None, 1), (1, None, "bad", None, 1)], ddl)
    known = rows([(1,), (2,)], "job_id int")
    got = mutations.upsert_page_results(changes, known, F.col("v"), ["ocr_text", "merge_text"], current)
    assert found(got, "job_id", "page_num", "ocr_text", "merge_text") == [
        (1, 1, "new", "kept"), (1, 2, "x", "y"), (2, 1, "other", None)
    ]
    again = got.withColumn("v", F.lit(10))
    twice = mutations.upsert_page_results(again, known, F.col("v"), ["ocr_text", "merge_text"], current)
    assert found(twice, "job_id", "page_num", "ocr_text") == found(got, "job_id", "page_num", "ocr_text")


def test_partial_update_soft_delete_and_delete(rows):
    files = rows([(1, "a", None), (2, "b", None)], "file_id int, filename string, deleted_at timestamp_ntz")
    changed = mutations.partial_update(files, rows([(1, None), (2, "z")], "file_id int, filename string"), "file_id")
    assert found(changed, "file_id", "filename") == [(1, "a"), (2, "z")]
    gone = mutations.soft_delete(files, rows([(2,), (2,)], "file_id int"), NOW)
    assert found(gone, "file_id", "deleted_at") == [(1, None), (2, NOW)]
    rest, n = mutations.delete_rows(files, rows([(2,), (7,)], "file_id int"))
    assert found(rest, "file_id") == [(1,)] and n.first()["deleted"] == 1


def test_insert_absent(rows):
    users = rows([(1, "a")], "user_id int, email string")
    got = mutations.insert_absent(users, rows([(1, "x"), (2, "c"), (2, "b")], "user_id int, email string"), "user_id")
    assert found(got, "user_id", "email") == [(1, "a"), (2, "b")]


def test_older_than_is_strict(rows):
    items = rows([(1, datetime(2023, 12, 31, 12)), (2, datetime(2023, 12, 31, 11, 59, 59))], "id int, modified_at timestamp_ntz")
    assert found(mutations.older_than(items, NOW), "id") == [(2,)]


@pytest.mark.parametrize(
    "statuses, cancel, want",
    [
        (["completed"] * 3, False, ("completed", False, None)),
        (["failed"] * 3, False, ("failed", False, "3 of 3 documents failed")),
        (["completed", "failed"], False, ("completed", True, None)),
        (["completed", "cancelled"], True, ("cancelled", False, None)),
    ],
)
def test_batch_status(rows, statuses, cancel, want):
    data = rows([(i, 1, s, 0.0) for i, s in enumerate(statuses)], "job_id int, parent_batch_id int, status string, progress_pct double")
    asked = rows([(1,)] if cancel else [], "parent_batch_id int")
    r = jobs.batch_status(data, asked).first()
    assert (r.status, r.is_partial, r.error_message) == want


def test_active_and_failed_add_up(rows):
    data = rows(
        [(1, "b", "processing", 50.0), (2, "b", "processing", 0.0), (3, "b", "completed", 100.0), (4, "c", "processing", 10.0), (5, "b", "queued", 0.0)],
        "job_id int, parent_batch_id string, status string, progress_pct double",
    )
    assert found(jobs.active_jobs(data), "parent_batch_id", "active_files") == [("b", 2), ("c", 1)]
    assert found(jobs.batch_failures(data), "parent_batch_id", "failed_files", "truly_failed") == [("b", 1, 0), ("c", 0, 0)]
    assert found(jobs.batch_progress(data), "parent_batch_id", "overall_progress_pct") == [("b", 37.5), ("c", 10.0)]
    stats = jobs.queue_stats(data).first()
    assert sum(stats) == 5 and stats["cancelled"] == 0


def test_empty_inputs_give_zeros(rows):
    none = rows([], "job_id int, parent_batch_id int, status string, progress_pct double")
    assert tuple(jobs.queue_stats(none).first()) == (0, 0, 0, 0, 0)
    assert catalog.cleanup_stats(rows([], "kind string, size_bytes bigint")).first()["bytes_freed"] == 0


def test_eviction_ranks_all_but_drops_terminal_only(rows):
    data = [(i, datetime(2024, 1, i + 1), "completed" if i != 1 else "processing") for i in range(5)]
    batches = rows(data, "batch_job_id int, created_at timestamp_ntz, status string")
    left, gone = jobs.evict_old_batches(batches, keep=3)
    assert found(gone, "batch_job_id") == [(0,)]
    assert found(left, "batch_job_id") == [(1,), (2,), (3,), (4,)]


@pytest.mark.parametrize(
    "kwargs, want",
    [
        ({"start": 2}, [1, 2, 3, 4]), ({"end": 2}, [1, 2, 3, 4]), ({"start": 9, "end": 12}, []),
        ({"start": 2, "end": 99}, [2, 3, 4]), ({"start": 2, "end": 2}, [2]), ({"start": -3, "end": 2}, [1, 2]),
        ({"max_pages": 0}, []), ({"max_pages": 3}, [1, 2, 3]), ({"start": 2, "max_pages": 3}, [1, 2, 3]),
    ],
)
def test_page_range(rows, kwargs, want):
    pages = rows([(1, i) for i in range(1, 5)], "job_id int, page_num int")
    assert [n for (n,) in found(documents.select_page_range(pages, **kwargs), "page_num")] == want


def test_assembly_in_parts_is_the_whole_document(rows):
    pages = rows(
        [(1, i, "ocr", 1.0, f"page {i}\n") for i in range(1, 51)],
        "job_id int, page_num int, method string, processing_time double, text string",
    ).repartition(7)
    whole = documents.assemble_documents(pages).first()["content"]
    parts = documents.assemble_documents(pages, pages_per_part=8).orderBy("part").collect()
    assert len(parts) == 7 and "".join(p.content for p in parts) == whole
    assert whole.count("<!-- Page ") == 50 and whole.startswith("<!-- Page 1 |")
    raw = pages.withColumnRenamed("text", "ocr_text")
    joined = "".join(r.ocr_content for r in documents.stage1_text(raw, 8).orderBy("part").collect())
    assert joined == documents.stage1_text(raw).first()["ocr_content"]


def test_done_and_to_do_make_all_pages(rows):
    pages = rows([(j, p) for j in (1, 2) for p in range(1, 6)], "job_id int, page_num int")
    done = pages.where("page_num % 2 = 0")
    rest = documents.pages_to_do(pages, done)
    assert found(rest.unionByName(done), "job_id", "page_num") == found(pages, "job_id", "page_num")


def test_lineage_of_a_long_chain(rows):
    chain = rows([(i, i - 1 if i else None) for i in range(20)] + [(100, None)], "job_id int, parent_job_id int")
    got = catalog.job_lineage(chain)
    assert found(got, "job_id", "root_job_id", "depth") == [(i, 0, i) for i in range(20)] + [(100, 100, 0)]
    with pytest.raises(ValueError):
        catalog.job_lineage(rows([(1, 2), (2, 3), (3, 1), (4, None)], "job_id int, parent_job_id int")).count()


def test_lineage_of_a_chain_of_thousands(rows):
    chain = rows([(i, i - 1) for i in range(1, 2001)], "job_id int, parent_job_id int")
    got = {r.job_id: (r.root_job_id, r.depth) for r in catalog.job_lineage(chain).collect()}
    assert got == {i: (1, i - 1) for i in range(1, 2001)}  # job 0 is absent, so job 1 is the root


def test_cascade(rows):
    tables = {
        "users": rows([(1,), (2,)], "user_id int"),
        "files": rows([(10, 1), (20, 2)], "file_id int, user_id int"),
        "batches": rows([(5, 1), (6, 2)], "batch_job_id int, user_id int"),
        "jobs": rows([(100, 1, 10, 5), (200, 2, 20, 6), (201, 2, 10, None), (202, 2, 20, 5), (203, 2, 20, None)],
                     "job_id int, user_id int, file_id int, parent_batch_id int"),
        "pages": rows([(100, 1), (200, 1), (201, 1), (203, 2)], "job_id int, page_num int"),
        "events": rows([(1, 202), (2, 203)], "event_id int, job_id int"),
    }
    left = catalog.cascade_delete(tables, rows([(1,)], "user_id int"))
    assert found(left["files"], "file_id") == [(20,)]
    assert found(left["batches"], "batch_job_id") == [(6,)]
    assert found(left["jobs"], "job_id") == [(200,), (203,)]
    assert found(left["pages"], "job_id", "page_num") == [(200, 1), (203, 2)]
    assert found(left["events"], "event_id") == [(2,)]


def test_validation_messages(rows):
    images = rows([(31, 40, "RGB"), (5000, 40, "RGB"), (40, 40, "CMYK"), (40, 40, None), (32, 4096, "L")], "width int, height int, mode string")
    errors = [r.error for r in catalog.image_errors(images).collect()]
    assert [e and e.split(":")[0] for e in errors] == [
        "Image too small", "Image too large", "Unsupported image mode", "Unsupported image mode", None
    ]
    files = rows([("a.PDF", 1), ("a.exe", 1), ("a.pdf", 60 * 1024 * 1024), ("noext", 1)], "filename string, size_bytes bigint")
    assert [r.error for r in catalog.file_errors(files).collect()] == [
        None, "Unsupported file type: .exe", "File too large: 60.0MB. Maximum size is 50MB", "Unsupported file type: "
    ]
    batch = rows([("a.pdf", None), ("b.txt", "application/pdf"), ("", None), ("c.txt", None), ("d", None)], "filename string, content_type string")
    assert sorted(r.error for r in catalog.pdf_batch_errors(batch).collect()) == [
        "File has no filename", "c.txt: Not a PDF file (type: text/plain)", "d: Not a PDF file (type: unknown)"
    ]
    options = rows([(300, "auto", 1, 1), (71, "x", 0, -1), (None, None, None, None)], "dpi int, method string, start_page int, end_page int")
    assert [len(r.errors) for r in catalog.option_errors(options).collect()] == [0, 4, 0]


def test_ingest_is_all_or_nothing(rows):
    files = rows(
        [(1, "d1", "a.pdf", None, 10), (2, "d1", "b.pdf", None, 5), (3, "d2", "a.pdf", None, 1), (4, "d2", "x.txt", None, 1)],
        "file_id int, folder string, filename string, content_type string, size_bytes bigint",
    )
    dirs, numbered = catalog.ingest_directories(files, "folder", NOW)
    assert found(dirs, "directory_id", "total_size", "file_count") == [("d1", 15, 2)]
    assert found(numbered, "directory_id", "file_id", "sequence_num") == [("d1", 1, 1), ("d1", 2, 2)]


def test_prompt_libraries(spark, rows):
    lib = rows([("a", "1")], "name string, text string")
    exported = prompts.export_prompts(rows([("a", "2"), ("b", "3")], "name string, text string"))
    assert found(prompts.import_prompts(lib, exported), "name", "text") == [("a", "1"), ("b", "3")]
    array = rows([('[{"name":"c","text":"4"},{"name":"a","text":"5"}]',), ("not json",)], "json string")
    assert found(prompts.import_prompts(lib, array), "name", "text") == [("a", "1"), ("c", "4")]
    defaults = rows([("ocr", "d"), ("merge", "m")], "prompt_type string, template string")
    custom = rows([("ocr", "mine"), ("extra", "e")], "prompt_type string, template string")
    assert found(prompts.merge_prompts(defaults, custom), "prompt_type", "template") == [
        ("extra", "e"), ("merge", "m"), ("ocr", "mine")
    ]
    catalog_rows = prompts.model_catalog(spark)
    assert catalog_rows.where("is_default").select("model").distinct().count() == 1
    wanted = rows([("qwen3-vl-2b", "structured", None), ("deepseek-ocr", "ocr", None), ("deepseek-x", "ocr", None), ("x", "ocr", "own")],
                  "model string, prompt_type string, custom_prompt string")
    got = dict(found(prompts.resolve_prompts(wanted, catalog_rows), "model", "prompt"))
    assert got["qwen3-vl-2b"] == prompts.FALLBACK_PROMPTS["qwen"]
    assert got["deepseek-x"] == prompts.FALLBACK_PROMPTS["deepseek"] and got["x"] == "own"


def test_a_supplied_null_clears_a_field(rows):
    jobs = rows([(1, "a", 5), (2, "b", 6), (3, "c", 7)], "job_id int, note string, n int")
    changes = rows([(1, None, None, ["note"]), (2, "z", None, ["note", "n"]), (3, "x", 1, None)],
                   "job_id int, note string, n int, supplied array<string>")
    got = mutations.partial_update(jobs, changes, "job_id")
    assert found(got, "job_id", "note", "n") == [(1, None, 5), (2, "z", None), (3, "c", 7)]
    plain = mutations.partial_update(jobs, changes.drop("supplied"), "job_id")
    assert found(plain, "job_id", "note", "n") == [(1, "a", 5), (2, "z", 6), (3, "x", 1)]
