"""Registered queries over scoring jobs, with deterministic functions in place of a model."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from pagemill.functions.layout import RESOLUTION_STEPS, SCALE_STEPS
from pagemill.functions.times import moment
from pagemill.operators import documents as od
from pagemill.operators import scoring as os_
from pagemill.operators import throttle as ot
from pagemill.operators import prompts as op
from pagemill.plans.extraction import extract_documents
from pagemill.plans.extraction import two_stage_documents as two_stage
from pagemill.plans.registry import query
from pagemill.session import scratch_dir
from pagemill.sources import cache as sc
from pagemill.sources import standins as s


def _load_reader():
    """A scorer that fails on very short pages."""

    def read(row):
        if len(row["text_in"]) < 5:
            raise ValueError("blank page")
        return f"<{row['text_in']}>"

    return read


def _pages(spark, sf_dir):
    return s.document_pages(spark, sf_dir).select("job_id", "page_num", F.col("text").alias("text_in"))


@query("""
SELECT job_id, page_num, 'ocr' AS prompt_type, CASE WHEN length(text) < 5 THEN '' ELSE '<' || text || '>' END AS text,
  length(text) >= 5 AS success, CASE WHEN length(text) < 5 THEN 'blank page' END AS error FROM v_lines""")
def scored_pages(spark, sf_dir):
    """M1."""
    df = os_.score_pages(_pages(spark, sf_dir), _load_reader)
    return df.select("job_id", "page_num", "prompt_type", "text", "success", "error")


def _load_batch_reader():
    def read(rows, single=False):
        out = []
        for row in rows:
            ok = len(row["text_in"]) >= 5
            out.append({"text": row["text_in"] if ok else "", "success": ok, "error": None if ok else "blank page"})
        return out

    return read


@query("""
SELECT job_id, page_num, (page_num - 1) // 8 AS batch_no, (page_num - 1) % 8 AS batch_index,
  CASE WHEN length(text) < 5 THEN '' ELSE text END AS text, length(text) >= 5 AS success,
  CASE WHEN length(text) < 5 THEN 'blank page' END AS error,
  CAST(count(*) OVER b AS INTEGER) AS batch_size, bool_and(length(text) >= 5) OVER b AS batch_success
FROM (SELECT job_id, CAST(page_num AS BIGINT) AS page_num, text FROM v_lines)
WINDOW b AS (PARTITION BY job_id, (page_num - 1) // 8)""")
def scored_batches(spark, sf_dir):
    """M2."""
    df = os_.score_batches(_pages(spark, sf_dir), _load_batch_reader, size=8)
    return df.drop("text_in").withColumn("page_num", F.col("page_num").cast("bigint"))


def _load_retrying_reader():
    """Long pages only fit at a smaller scale; the longest never do."""
    def read(row, scale):
        if len(row["text_in"]) * scale > 200:
            raise RuntimeError("CUDA out of memory")
        return row["text_in"]

    return os_.with_retry(read, SCALE_STEPS, os_.is_oom_error)


@query("""
SELECT job_id, page_num, CASE WHEN length(text) * 0.25 > 200 THEN '' ELSE text END AS text,
  CAST(CASE WHEN length(text) <= 200 THEN 1 WHEN length(text) * 0.75 <= 200 THEN 2 WHEN length(text) * 0.5 <= 200 THEN 3
    WHEN length(text) * 0.35 <= 200 THEN 4 ELSE 5 END AS INTEGER) AS attempts,
  CAST(CASE WHEN length(text) <= 200 THEN 1.0 WHEN length(text) * 0.75 <= 200 THEN 0.75 WHEN length(text) * 0.5 <= 200 THEN 0.5
    WHEN length(text) * 0.35 <= 200 THEN 0.35 ELSE 0.25 END AS DOUBLE) AS scale,
  CASE WHEN length(text) * 0.25 > 200 THEN 'CUDA out of memory' END AS error FROM v_lines""")
def retried_pages(spark, sf_dir):
    """M4, X8."""
    df = os_.score_pages(_pages(spark, sf_dir), _load_retrying_reader)
    return df.select("job_id", "page_num", "text", "attempts", "scale", "error")


def _load_merging_reader():
    """The merge stage at falling image sizes; texts too long for a size need the next."""

    def merge(row, pixels):
        if len(row["text_in"]) * pixels > 200_000:
            raise RuntimeError("CUDA out of memory")
        return row["text_in"]

    return os_.with_retry(merge, RESOLUTION_STEPS, os_.is_oom_error)


@query("""
SELECT job_id, page_num, CASE WHEN n * 512 > 200000 THEN '' ELSE text END AS text,
  CAST(CASE WHEN n * 1024 <= 200000 THEN 1 WHEN n * 768 <= 200000 THEN 2 ELSE 3 END AS INTEGER) AS attempts,
  CASE WHEN n * 1024 <= 200000 THEN 1024.0::DOUBLE WHEN n * 768 <= 200000 THEN 768.0::DOUBLE ELSE 512.0::DOUBLE END AS pixels
FROM (SELECT *, length(text) AS n FROM v_lines)""")
def resized_pages(spark, sf_dir):
    """M4, X8 with the ladder of resolutions."""
    df = os_.score_pages(_pages(spark, sf_dir), _load_merging_reader, "merge")
    return df.select("job_id", "page_num", "text", "attempts", F.col("scale").alias("pixels"))


def _load_fallback_reader():
    def first(row):
        if len(row["text_in"]) > 300:
            raise TimeoutError("too slow")
        return "a " + row["text_in"]

    def second(row):
        if len(row["text_in"]) > 600:
            raise TimeoutError("too slow")
        return "b " + row["text_in"]

    return os_.with_fallback([("qwen3-vl-8b", first), ("qwen3-vl-4b", second)], sleep=lambda s: None)


@query("""
SELECT job_id, page_num, CASE WHEN length(text) <= 300 THEN 'a ' || text WHEN length(text) <= 600 THEN 'b ' || text ELSE '' END AS text,
  CASE WHEN length(text) <= 300 THEN 'qwen3-vl-8b' WHEN length(text) <= 600 THEN 'qwen3-vl-4b' END AS model,
  CAST(CASE WHEN length(text) <= 300 THEN 1 ELSE 2 END AS INTEGER) AS attempts,
  CASE WHEN length(text) > 600 THEN 'too slow' END AS error FROM v_lines""")
def fallback_pages(spark, sf_dir):
    """M5."""
    df = os_.score_pages(_pages(spark, sf_dir), _load_fallback_reader)
    return df.select("job_id", "page_num", "text", "model", "attempts", "error")


def _load_merger():
    return lambda row: row["embedded_text"] + "|" + row["ocr_text"]


@query("""
SELECT doc_id AS job_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: i % 5 <> 0), chr(10))
  || '|' || text || chr(10) || 'scanned copy ' || doc_id AS merge_text FROM documents""")
def model_merged_text(spark, sf_dir):
    """M3 with a supplied function."""
    pages = s.ocr_lines(spark, sf_dir)
    return os_.merge_with_model(pages, _load_merger).select("job_id", "merge_text")


def _is_long(row):
    return (len(row["text"]) >= 20, "" if len(row["text"]) >= 20 else "short")


def _is_clean(row):
    bad = "<" in row["text"]
    return (not bad, "markup" if bad else "")


def _is_dated(row):
    dated = "2024" in row["text"]
    return (not dated, "date" if dated else "")


def _load_refiner():
    return lambda row: f"fixed({row['issues']})"


@query("""
SELECT job_id, page_num, CASE WHEN valid THEN text ELSE 'fixed(' || issues || ')' END AS text, valid, issues, NOT valid AS refined
FROM (SELECT *, ok1 AND ok2 AND ok3 AS valid, array_to_string(list_filter([CASE WHEN NOT ok1 THEN 'short' END,
    CASE WHEN NOT ok2 THEN 'markup' END, CASE WHEN NOT ok3 THEN 'date' END], lambda x: x IS NOT NULL), ' | ') AS issues
  FROM (SELECT *, length(text) >= 20 AS ok1, NOT contains(text, '<') AS ok2, NOT contains(text, '2024') AS ok3 FROM v_lines))""")
def refined_pages(spark, sf_dir):
    """M6."""
    pages = s.document_pages(spark, sf_dir).select("job_id", "page_num", "text")
    return os_.validate_and_refine(pages, [_is_long, _is_clean, _is_dated], _load_refiner)


def _load_context_reader():
    def read(row):
        return f"{row['context'] or ''}:{row['input_text']}"

    return read


@query("""
WITH f AS (SELECT job_id, page_num, ':' || text AS scored FROM v_lines WHERE page_num <= 2),
c AS (SELECT job_id, string_agg(scored, chr(10) || chr(10) ORDER BY page_num) AS context FROM f GROUP BY 1)
SELECT job_id, page_num, scored AS text FROM f
UNION ALL SELECT job_id, page_num, context || ':' || text FROM v_lines JOIN c USING (job_id) WHERE page_num > 2""")
def calibrated_pages(spark, sf_dir):
    """M7, J11, U1."""
    pages = s.document_pages(spark, sf_dir).select("job_id", "page_num", "text")
    return os_.score_with_calibration(pages, _load_context_reader, n=2).select("job_id", "page_num", "text")


def _load_formatter():
    return lambda row: "# " + row["input_text"]


@query("""
SELECT job_id, page_num, '# ' || text AS text FROM v_lines""")
def formatted_pages(spark, sf_dir):
    """M8."""
    pages = s.document_pages(spark, sf_dir).select("job_id", "page_num", "text")
    return os_.format_pages(pages, _load_formatter, "markdown")


def _load_page_reader():
    return lambda row: "scan of " + (row["embedded_text"] or "")


_DOCUMENTS = """
SELECT job_id, CAST((page_num - 1) // 512 AS BIGINT) AS part, true AS is_complete, count(*) AS pages, string_agg('<!-- Page ' || page_num || ' | Method: '
  || CASE WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 10 THEN 'OCR' ELSE 'HYBRID' END
  || ' | Time: 0.00s | Chars: ' || length(merged) || ' -->' || chr(10) || merged || chr(10) || chr(10), '' ORDER BY page_num) AS content
FROM (SELECT *, CASE WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 10 THEN 'scan of ' || text
  ELSE text || chr(10) || 'scan of ' || text END AS merged FROM v_lines) GROUP BY 1, 2"""


@query(_DOCUMENTS)
def extracted_documents(spark, sf_dir):
    """The whole document job: route, stage 1, stage table, merge, assembly."""
    pages = s.document_pages(spark, sf_dir).select("job_id", "page_num", F.col("text").alias("embedded_text"))
    cache = scratch_dir(spark, "ocr")
    docs, _ = extract_documents(pages, _load_page_reader, cache, timed=False)
    return docs


def _load_second_merger():
    """Puts both texts under the model's name; fails on long pages, so the rule merge stands in."""

    def merge(row):
        if len(row["embedded_text"]) > 300:
            raise TimeoutError("too slow")
        return f"{row['merge_model']}|{row['prompt']}|{row['embedded_text']}|{row['ocr_text']}"

    return merge


@query("""
WITH p AS (SELECT l.job_id, page_num, l.text, d.lang, length(regexp_replace(l.text, '^\\s+|\\s+$', '', 'g')) < 10 AS scan,
    CASE d.lang WHEN 'en' THEN 'qwen3-vl-2b' WHEN 'fr' THEN 'qwen3-vl-8b' ELSE 'qwen3-vl-4b' END AS model
  FROM v_lines l JOIN documents d ON d.doc_id = l.job_id),
m AS (SELECT *, CASE WHEN scan THEN 'scan of ' || text WHEN length(text) > 300 THEN text || chr(10) || 'scan of ' || text
    ELSE model || '|own prompt|' || text || '|scan of ' || text END AS merged FROM p),
f AS (SELECT *, CASE WHEN lang = 'de' THEN merged ELSE '# ' || merged END AS out FROM m)
SELECT job_id, CAST((page_num - 1) // 512 AS BIGINT) AS part, true AS is_complete, count(*) AS pages, string_agg('<!-- Page ' || page_num
  || ' | Method: ' || CASE WHEN scan THEN 'OCR' ELSE 'HYBRID' END || ' | Time: 0.00s | Chars: ' || length(out) || ' -->' || chr(10)
  || out || chr(10) || chr(10), '' ORDER BY page_num) AS content FROM f GROUP BY 1, 2""")
def two_stage_documents(spark, sf_dir):
    """The two-stage job over all pages: M3, M8, M9, M10, S3, S8, A13."""
    pages = s.document_pages(spark, sf_dir).select("job_id", "page_num", F.col("text").alias("embedded_text"))
    lang = F.col("lang")
    jobs = s.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("job_id"),
        (lang == "fr").alias("prefer_quality"),
        F.when(lang == "en", "speed").alias("strategy"),
        F.lit("own prompt").alias("custom_prompt"),
        F.when(lang == "de", "text").otherwise("markdown").alias("output_format"),
    )
    docs, _, _ = two_stage(
        pages,
        jobs,
        op.model_catalog(spark),
        _load_page_reader,
        _load_second_merger,
        lambda: lambda row: "# " + row["merged"],
        scratch_dir(spark, "two-stage"),
        timed=False,
    )
    return docs


def _load_failing_reader(modulus):
    """Fails on every page whose number the modulus divides; 0 never fails."""

    def make():
        def read(row):
            if modulus and row["page_num"] % modulus == 0:
                raise RuntimeError("out of memory")
            return "scan of " + (row["embedded_text"] or "")

        return read

    return make


@query(_DOCUMENTS)
def resumed_documents(spark, sf_dir):
    """A job with failures, resumed, and the resumed run repeated."""
    pages = s.document_pages(spark, sf_dir).select("job_id", "page_num", F.col("text").alias("embedded_text"))
    cache = scratch_dir(spark, "resume")
    extract_documents(pages, _load_failing_reader(3), cache, timed=False)
    extract_documents(pages, _load_failing_reader(0), cache, run=2, timed=False)
    docs, _ = extract_documents(pages, _load_failing_reader(0), cache, run=2, timed=False)
    return docs


@query("""
SELECT job_id, page_num, 9007199254740993 + page_num AS wide_id, CASE WHEN page_num % 2 = 0 THEN 9007199254740995 + job_id END AS maybe_id,
  TIMESTAMP '2024-01-01' + to_seconds(page_num) AS seen_at, text || '|null' AS parts, '<' || text || '>' AS text FROM v_lines""")
def passed_columns(spark, sf_dir):
    """M1 with a scorer of lists: wide ids with nulls, times and arrays pass unchanged."""
    num = F.col("page_num")
    pages = s.document_pages(spark, sf_dir).select(
        "job_id",
        "page_num",
        (F.lit(9007199254740993) + num).alias("wide_id"),
        F.when(num % 2 == 0, F.lit(9007199254740995) + F.col("job_id")).alias("maybe_id"),
        (moment(datetime(2024, 1, 1)) + F.make_dt_interval(secs=num.cast("decimal(18,6)"))).alias("seen_at"),
        F.array(F.col("text"), F.lit(None)).alias("parts"),
        F.col("text").alias("text_in"),
    )
    scored = os_.score_pages(pages, lambda: lambda rows: [f"<{r['text_in']}>" for r in rows], batched=True)
    parts = F.array_join("parts", "|", "null").alias("parts")
    return scored.select("job_id", "page_num", "wide_id", "maybe_id", "seen_at", parts, "text")


@query("SELECT job_id, page_num, ocr_text, method, processing_time FROM v_pages WHERE ocr_text IS NOT NULL")
def cached_stage_results(spark, sf_dir):
    """S3: two runs stored, the second repeated; the newest result of a page is read."""
    path = scratch_dir(spark, "cache")
    results = s.page_results(spark, sf_dir).where("ocr_text IS NOT NULL").select(
        "job_id", "page_num", "ocr_text", "method", "processing_time"
    )
    # Stored, so that the upsert behind them runs once and not for every run.
    staged = scratch_dir(spark, "cache-source")
    results.write.parquet(staged)
    pages = spark.read.parquet(staged)
    sc.write_ocr_cache(pages.withColumn("ocr_text", F.lit("stale")), path, run=1)
    sc.write_ocr_cache(pages.withColumn("ocr_text", F.lit("half done")), path, run=2)
    sc.write_ocr_cache(pages, path, run=2)
    return sc.read_ocr_cache(spark, path)


_MARKS = """
WITH RECURSIVE c AS (SELECT job_id, page_num, epoch_ms(TIMESTAMP '2024-01-01') + (page_num * 9 + length(text) % 7) * 1000 AS ts FROM v_lines),
f AS (SELECT job_id, page_num, 1 AS cnt, ts AS last, false AS mark FROM c WHERE page_num = 1
  UNION ALL
  SELECT c.job_id, c.page_num, CASE WHEN m THEN 0 ELSE n END, CASE WHEN m THEN c.ts ELSE last END, m
  FROM (SELECT c.*, f.cnt + 1 AS n, f.last, f.cnt + 1 >= 5 OR c.ts - f.last >= 30000 AS m
    FROM f JOIN c ON c.job_id = f.job_id AND c.page_num = f.page_num + 1) c)
SELECT job_id, page_num, mark FROM f"""


@query(_MARKS)
def checkpoint_marks(spark, sf_dir):
    """W9 on document lines."""
    seconds = F.col("page_num") * 9 + F.length("text") % 7
    pages = s.document_pages(spark, sf_dir).select(
        "job_id",
        "page_num",
        (moment(datetime(2024, 1, 1)) + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))).alias("completed_at"),
    )
    return ot.checkpoint_marks(pages).drop("completed_at")


SNAPSHOT_SQL = """
WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY created_at, chunk_sequence) AS n FROM v_line_chunks),
f AS (SELECT job_id, n, CASE WHEN is_final THEN 0 ELSE 1 END AS cnt, created_at AS last, is_final AS mark FROM c WHERE n = 1
  UNION ALL
  SELECT job_id, n, CASE WHEN m THEN 0 ELSE k END, CASE WHEN m THEN created_at ELSE last END, m
  FROM (SELECT c.*, f.cnt + 1 AS k, f.last, c.is_final OR f.cnt + 1 >= 4 OR c.created_at - f.last >= INTERVAL 100 MILLISECOND AS m
    FROM f JOIN c ON c.job_id = f.job_id AND c.n = f.n + 1)),
g AS (SELECT c.*, f.mark, coalesce(sum(f.mark::INT) OVER (PARTITION BY c.job_id ORDER BY c.n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS no
  FROM c JOIN f USING (job_id, n)),
d AS (SELECT job_id, CAST(no AS BIGINT) AS snapshot_no, count(*) AS tokens, max(created_at) AS flushed_at, bool_or(is_final) AS is_final,
    string_agg(chunk_text, '' ORDER BY n) AS delta FROM g GROUP BY 1, 2 HAVING bool_or(mark))
SELECT job_id, 1 AS page_num, snapshot_no, CAST((snapshot_no - 1) // 64 AS BIGINT) AS part, tokens, flushed_at, is_final,
  string_agg(delta, '') OVER (PARTITION BY job_id, (snapshot_no - 1) // 64 ORDER BY snapshot_no) AS part_text FROM d"""


@query(SNAPSHOT_SQL)
def text_snapshots(spark, sf_dir):
    """T3 batch form, flushing after 4 chunks or 100 ms."""
    return ot.throttle_snapshots(s.line_chunks(spark, sf_dir), ms=100, tokens=4)
