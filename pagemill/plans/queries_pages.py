"""Registered queries over pages and documents."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from pagemill.functions import layout as fl
from pagemill.functions import text as ft
from pagemill.operators import catalog as oc
from pagemill.operators import documents as od
from pagemill.operators import jobs as oj
from pagemill.operators import mutations as om
from pagemill.plans.registry import query
from pagemill.session import scratch_dir
from pagemill.sources import documents as sd
from pagemill.sources import files as sf
from pagemill.sources import standins as s


@query("""
SELECT j.job_id, j.status, j.parent_batch_id, p.pages, p.embedded_pages, p.ocr_pages, p.hybrid_pages,
  p.total_time, p.avg_time, d.text, d.n_chars
FROM v_jobs j JOIN (
  SELECT job_id, count(*) AS pages, count(*) FILTER (method = 'embedded') AS embedded_pages,
    count(*) FILTER (method = 'ocr') AS ocr_pages, count(*) FILTER (method = 'hybrid') AS hybrid_pages,
    sum(processing_time) AS total_time, round(avg(processing_time), 6) AS avg_time
  FROM v_pages GROUP BY 1) p ON p.job_id = j.job_id
JOIN documents d ON d.doc_id = j.file_id""")
def document_overview(spark, sf_dir):
    """Text, page count, methods and status of every document (upsert, A1, J6)."""
    pages = oj.document_summary(s.page_results(spark, sf_dir))
    texts = s.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "text", "n_chars")
    jobs = s.jobs(spark, sf_dir).select("job_id", "file_id", "status", "parent_batch_id")
    return (
        jobs.join(pages.withColumn("avg_time", F.round("avg_time", 6)), "job_id").join(texts, "file_id").drop("file_id")
    )


@query("""
SELECT page_id, url, length(html) AS size_bytes,
  length(regexp_replace(html, '^\\s+|\\s+$', '', 'g')) >= 10 AS has_text FROM pages""")
def page_source(spark, sf_dir):
    """S2, F7 on web pages."""
    pages = s.table(spark, sf_dir, "pages").withColumn("embedded_text", F.col("html"))
    return od.with_has_text(pages).select(
        "page_id", "url", F.length("html").cast("bigint").alias("size_bytes"), "has_text"
    )


@query("SELECT DISTINCT job_id, page_num FROM v_changes WHERE is_done")
def completed_pages(spark, sf_dir):
    """S4."""
    return od.list_completed_pages(s.page_changes(spark, sf_dir).where("is_done"))


@query("SELECT job_id, page_num, method, processing_time, completed_at, ocr_text, merge_text, is_done FROM v_pages "
       "WHERE job_id IN (SELECT job_id FROM v_jobs)")
def page_upsert(spark, sf_dir):
    """S8."""
    return om.upsert_page_results(
        s.page_changes(spark, sf_dir), s.jobs(spark, sf_dir), F.col("version"), s.PAGE_COLUMNS
    )


@query("""
SELECT job_id, page_num FROM (SELECT *, max(page_num) OVER (PARTITION BY job_id) AS n FROM v_pages)
WHERE page_num BETWEEN greatest(1, 2) AND least(n, 5)""")
def page_range(spark, sf_dir):
    """F6 with both bounds."""
    return od.select_page_range(s.page_results(spark, sf_dir), start=2, end=5).select("job_id", "page_num")


@query("SELECT job_id, page_num FROM v_pages WHERE page_num <= 3")
def page_range_first(spark, sf_dir):
    """F6 with a page limit; the lone start bound is ignored."""
    return od.select_page_range(s.page_results(spark, sf_dir), start=2, max_pages=3).select("job_id", "page_num")


@query("""
SELECT doc_id, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 10 AS has_text FROM documents""")
def embedded_text_flag(spark, sf_dir):
    """F7."""
    docs = s.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("embedded_text"))
    return od.with_has_text(docs).select("doc_id", "has_text")


@query("""
SELECT job_id, page_num, CASE WHEN m.method = 'ocr' THEN 'ocr' WHEN length(text) < 10 THEN 'ocr'
  WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 10 THEN 'ocr'
  WHEN m.method = 'extract' THEN 'embedded' ELSE 'hybrid' END AS route, m.method
FROM v_lines JOIN (VALUES ('en', 'auto'), ('fr', 'extract'), ('de', 'ocr'), ('es', 'hybrid')) m(lang, method)
USING (lang)""")
def page_routes(spark, sf_dir):
    """F8 with the method chosen by language."""
    lang = F.col("lang")
    method = F.when(lang == "en", "auto").when(lang == "fr", "extract").when(lang == "de", "ocr").otherwise("hybrid")
    pages = s.document_pages(spark, sf_dir).withColumn("method", method)
    route = od.page_route(
        F.col("method"), F.lit(False), ft.has_embedded_text(F.col("text")), F.col("text")
    )
    return pages.select("job_id", "page_num", route.alias("route"), "method")


@query("SELECT job_id, page_num, text, 'scan ' || length(text) AS ocr_text FROM v_lines WHERE length(text) >= 10")
def pages_with_ocr(spark, sf_dir):
    """Pages with a result."""
    pages = s.document_pages(spark, sf_dir)
    ocr = pages.where(F.length("text") >= 10).select(
        "job_id", "page_num", F.concat(F.lit("scan "), F.length("text")).alias("ocr_text")
    )
    joined, _ = od.attach_ocr(pages.select("job_id", "page_num", "text"), ocr)
    return joined


@query("SELECT job_id, page_num FROM v_lines WHERE length(text) < 10")
def pages_without_ocr(spark, sf_dir):
    """Pages that fail the all-pages-must-match rule."""
    pages = s.document_pages(spark, sf_dir)
    ocr = pages.where(F.length("text") >= 10).select("job_id", "page_num", F.col("text").alias("ocr_text"))
    _, missing = od.attach_ocr(pages.select("job_id", "page_num"), ocr)
    return missing


@query("SELECT job_id, page_num FROM v_pages EXCEPT SELECT job_id, page_num FROM v_changes WHERE is_done")
def resume_pages(spark, sf_dir):
    """J2."""
    changes = s.page_changes(spark, sf_dir)
    pages = changes.select("job_id", "page_num").distinct()
    return od.pages_to_do(pages, changes.where("is_done"))


@query("""
SELECT p.job_id, p.page_num, p.text, c.context FROM v_lines p LEFT JOIN (
  SELECT job_id, string_agg(text, chr(10) || chr(10) ORDER BY page_num) AS context
  FROM v_lines WHERE page_num <= 2 GROUP BY 1) c USING (job_id) WHERE p.page_num > 2""")
def few_shot_pages(spark, sf_dir):
    """J11."""
    pages = s.document_pages(spark, sf_dir).select("job_id", "page_num", "text")
    return od.few_shot_context(pages, 2)


@query("SELECT job_id, page_num, CASE WHEN page_num <= 2 THEN 'calibration' ELSE 'rest' END AS phase FROM v_pages")
def calibrated_union(spark, sf_dir):
    """U1."""
    pages = s.page_results(spark, sf_dir).select("job_id", "page_num")
    first = pages.where("page_num <= 2").withColumn("phase", F.lit("calibration"))
    rest = pages.where("page_num > 2").withColumn("phase", F.lit("rest"))
    return od.union_calibrated(first, rest)


_BATCHES = """
SELECT job_id, page_num, (rn - 1) // 4 AS batch_no, (rn - 1) % 4 AS batch_index FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY page_num) AS rn FROM v_pages)"""


def _batched(spark, sf_dir):
    pages = s.page_changes(spark, sf_dir).select("job_id", "page_num").distinct()
    return od.page_batches(pages, size=4)


@query(_BATCHES)
def page_batches(spark, sf_dir):
    """W4."""
    return _batched(spark, sf_dir)


def _batch_results(spark, sf_dir):
    """Outputs for every page whose number is not its job's third, failing on text-less ones."""
    results = (
        s.page_results(spark, sf_dir)
        .where("page_num <> 3")
        .select(
            "job_id",
            "page_num",
            F.col("ocr_text").alias("text"),
            F.col("ocr_text").isNotNull().alias("success"),
            F.when(F.col("ocr_text").isNull(), "Processing failed").alias("error"),
        )
    )
    batches = _batched(spark, sf_dir)
    return batches, batches.join(results, ["job_id", "page_num"]).drop("page_num")


@query(f"""
SELECT b.job_id, b.page_num, b.batch_no, b.batch_index,
  CASE WHEN p.page_num = 3 THEN '' ELSE coalesce(p.ocr_text, '') END AS text,
  p.page_num <> 3 AND p.ocr_text IS NOT NULL AS success,
  CASE WHEN p.page_num <> 3 AND p.ocr_text IS NULL THEN 'Processing failed' END AS error
FROM ({_BATCHES}) b JOIN v_pages p USING (job_id, page_num)""")
def batch_outputs(spark, sf_dir):
    """J8."""
    return od.attach_batch_results(*_batch_results(spark, sf_dir))


@query(f"""
SELECT b.job_id, b.batch_no, count(*) AS total,
  count(*) FILTER (p.page_num <> 3 AND p.ocr_text IS NOT NULL) AS successful,
  count(*) FILTER (p.page_num = 3 OR p.ocr_text IS NULL) AS failed,
  bool_and(p.page_num <> 3 AND p.ocr_text IS NOT NULL) AS batch_success
FROM ({_BATCHES}) b JOIN v_pages p USING (job_id, page_num) GROUP BY 1, 2""")
def batch_scoring_totals(spark, sf_dir):
    """A14."""
    return od.scoring_totals(od.attach_batch_results(*_batch_results(spark, sf_dir)))


_MARKED = (
    "'<!-- Page ' || page_num || ' | Method: ' || upper(method) || ' | Time: ' ||"
    " printf('%.2f', processing_time) || 's | Chars: ' || length(text) || ' -->' || chr(10) ||"
    " text || chr(10) || chr(10)"
)


@query(f"""
SELECT job_id, CAST((page_num - 1) // 512 AS BIGINT) AS part, count(*) AS pages,
  string_agg({_MARKED}, '' ORDER BY page_num) AS content FROM v_text_pages GROUP BY 1, 2""")
def assembled_documents(spark, sf_dir):
    """A13, S7, X1."""
    df = od.assemble_documents(s.text_pages(spark, sf_dir))
    return df


@query("""
SELECT job_id, CAST((page_num - 1) // 512 AS BIGINT) AS part,
  CASE WHEN min(page_num) > 512 THEN chr(10) || chr(10) ELSE '' END ||
  string_agg('--- Page ' || page_num || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY page_num)
    AS ocr_content FROM v_lines GROUP BY 1, 2""")
def stage1_text(spark, sf_dir):
    """A11."""
    return od.stage1_text(s.document_pages(spark, sf_dir).withColumnRenamed("text", "ocr_text"))


@query("""
SELECT job_id, CAST((page_num - 1) // 512 AS BIGINT) AS part, string_agg(page_num || ':' || processing_time::BIGINT, ',' ORDER BY page_num)
  AS pages, any_value(n) AS total_pages
FROM (SELECT *, count(*) OVER (PARTITION BY job_id) AS n FROM v_pages) GROUP BY 1, 2""")
def ocr_listing(spark, sf_dir):
    """A12; the lists are flattened to text for comparison."""
    df = od.ocr_output(s.page_results(spark, sf_dir))
    shown = F.transform(
        "pages", lambda p: F.concat_ws(":", p["page_num"], p["processing_time"].cast("bigint"))
    )
    return df.withColumn("pages", F.array_join(shown, ","))


@query("SELECT job_id, page_num, completed_at FROM v_pages")
def ordered_pages(spark, sf_dir):
    """O1."""
    return od.pages_in_order(s.page_results(spark, sf_dir).select("job_id", "page_num", "completed_at"))


@query("""
SELECT job_id, string_agg(line, chr(10) ORDER BY src, pos) AS merge_text FROM (
  SELECT doc_id AS job_id, 1 AS src, pos, line FROM (
    SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos,
      unnest(string_split(text, chr(10))) AS line FROM documents) WHERE pos % 5 <> 0
  UNION ALL
  SELECT doc_id, 2, pos, line FROM (
    SELECT doc_id, generate_subscripts(string_split(text || chr(10) || 'scanned copy ' || doc_id, chr(10)), 1) AS pos,
      unnest(string_split(text || chr(10) || 'scanned copy ' || doc_id, chr(10))) AS line FROM documents) o
  WHERE trim(line) <> '' AND NOT EXISTS (
    SELECT 1 FROM (SELECT doc_id AS d, generate_subscripts(string_split(text, chr(10)), 1) AS p,
      unnest(string_split(text, chr(10))) AS known FROM documents) e
    WHERE e.d = o.doc_id AND e.p % 5 <> 0
      AND lower(trim(regexp_replace(e.known, '\\s+', ' ', 'g'))) = lower(trim(regexp_replace(o.line, '\\s+', ' ', 'g'))))
) GROUP BY 1""")
def rule_merged_text(spark, sf_dir):
    """M3 built-in rule, lines compared as in SQL; a document without an id has no OCR twin there."""
    pages = s.ocr_lines(spark, sf_dir).withColumn("ocr_text", F.when(F.col("job_id").isNotNull(), F.col("ocr_text")))
    return od.merge_by_key(pages, ["job_id"])


@query("SELECT job_id, page_num, block_type, count(*) AS blocks FROM v_blocks GROUP BY 1, 2, 3")
def block_types(spark, sf_dir):
    """X4."""
    blocks = od.classify_blocks(s.text_blocks(spark, sf_dir))
    return blocks.groupBy("job_id", "page_num", "block_type").agg(F.count(F.lit(1)).alias("blocks"))


@query("""
SELECT job_id, page_num, bool_or(block_type = 'line_number') AS has_line_numbers,
  bool_or(block_type = 'header') AS has_headers, count(*) AS blocks,
  count(*) FILTER (block_type = 'line_number') AS line_number_blocks,
  count(*) FILTER (block_type = 'header') AS header_blocks,
  count(*) FILTER (block_type = 'qa_marker') AS qa_marker_blocks,
  count(*) FILTER (block_type = 'footer') AS footer_blocks,
  count(*) FILTER (block_type = 'body') AS body_blocks
FROM v_blocks GROUP BY 1, 2""")
def page_structure(spark, sf_dir):
    """A23."""
    return od.page_structure(od.classify_blocks(s.text_blocks(spark, sf_dir)))


@query("""
SELECT job_id, count(*) AS pages, CAST(sum(captured) AS BIGINT) AS captured,
  round(avg(captured) / 25 * 100, 6) AS capture_rate, round(stddev_pop(captured), 6) AS consistency
FROM (SELECT job_id, page_num, count(*) FILTER (block_type = 'line_number') AS captured FROM v_blocks GROUP BY 1, 2)
GROUP BY 1""")
def capture_consistency(spark, sf_dir):
    """A22."""
    blocks = od.classify_blocks(s.text_blocks(spark, sf_dir))
    return od.capture_consistency(blocks, 25).withColumns(
        {"capture_rate": F.round("capture_rate", 6), "consistency": F.round("consistency", 6)}
    )


@query("""
SELECT job_id, stage, page_num, count(*) OVER (PARTITION BY job_id, stage ORDER BY page_num) AS pages_completed,
  total_pages, round(CASE stage WHEN 'ocr' THEN 60.0 * count(*) OVER (PARTITION BY job_id, stage ORDER BY page_num) / total_pages
    ELSE 60 + 30.0 * count(*) OVER (PARTITION BY job_id, stage ORDER BY page_num) / total_pages END, 6) AS progress_pct
FROM (
  SELECT job_id, page_num, 'ocr' AS stage, count(*) OVER (PARTITION BY job_id) AS total_pages FROM v_pages
  UNION ALL
  SELECT job_id, page_num, 'merge', n FROM (
    SELECT *, count(*) OVER (PARTITION BY job_id) AS n FROM v_pages) WHERE is_done)""")
def stage_progress(spark, sf_dir):
    """W8."""
    pages = s.page_results(spark, sf_dir).select("job_id", "page_num", "is_done")
    totals = pages.groupBy("job_id").agg(F.count(F.lit(1)).alias("total_pages"))
    events = (
        pages.withColumn("stage", F.explode(F.when(F.col("is_done"), F.array(F.lit("ocr"), F.lit("merge"))).otherwise(F.array(F.lit("ocr")))))
        .drop("is_done")
    )
    return od.stage_progress(events, totals).withColumn("progress_pct", F.round("progress_pct", 6))


@query("""
SELECT job_id, page_num, length(text) AS char_count,
  len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS word_count,
  greatest(1, length(text) // 4) AS text_tokens, CASE WHEN length(text) < 300 THEN 64 ELSE 256 END AS vision_tokens
FROM v_lines""")
def page_text_measures(spark, sf_dir):
    """X2, X3."""
    mode = F.when(F.length("text") < 300, "tiny").otherwise("gundam")
    text = F.col("text")
    return s.document_pages(spark, sf_dir).select(
        "job_id",
        "page_num",
        ft.char_count(text).cast("bigint").alias("char_count"),
        ft.word_count(text).cast("bigint").alias("word_count"),
        ft.estimated_text_tokens(text).cast("bigint").alias("text_tokens"),
        ft.vision_tokens(mode).alias("vision_tokens"),
    )


@query("""
SELECT vec, w, h, CASE WHEN greatest(w, h) <= 1024 THEN w ELSE CAST(trunc(w * (1024.0::DOUBLE / greatest(w, h))) AS INTEGER) END AS fit_w,
  CASE WHEN greatest(w, h) <= 1024 THEN h ELSE CAST(trunc(h * (1024.0::DOUBLE / greatest(w, h))) AS INTEGER) END AS fit_h,
  CASE WHEN w > h THEN 4096 ELSE CAST(trunc(4096.0::DOUBLE / h * w) AS INTEGER) END AS big_w,
  CASE WHEN w > h THEN CAST(trunc(4096.0::DOUBLE / w * h) AS INTEGER) ELSE 4096 END AS big_h,
  CAST(10 * (w / CAST(h AS DOUBLE)) AS DOUBLE) AS x_scaled,
  w / 72.0::DOUBLE AS zoom
FROM (SELECT p_partkey AS vec, p_size * 40 + 1 AS w, CAST(p_retailprice AS INTEGER) + 1 AS h FROM part)""")
def image_geometry(spark, sf_dir):
    """X5, X6, X7 on part sizes as image sizes."""
    w, h = F.col("w"), F.col("h")
    box = F.struct(*[F.lit(10.0).alias(n) for n in ("x0", "y0", "x1", "y1")])
    fit, big = fl.fit_within(w, h), fl.resize_longest(w, h)
    return (
        s.table(spark, sf_dir, "part")
        .select(
            F.col("p_partkey").alias("vec"),
            (F.col("p_size") * 40 + 1).alias("w"),
            (F.bround("p_retailprice").cast("int") + 1).alias("h"),
        )
        .select(
            "vec",
            "w",
            "h",
            fit["width"].alias("fit_w"),
            fit["height"].alias("fit_h"),
            big["width"].alias("big_w"),
            big["height"].alias("big_h"),
            fl.scale_box(box, h, h, w, h)["x0"].alias("x_scaled"),
            fl.zoom(w).alias("zoom"),
        )
    )


@query("""
SELECT o_orderkey AS job_id, array_to_string(list_filter([300, 200, 150, 100, 72],
  lambda d: d <= CAST(left(o_orderpriority, 1) AS INTEGER) * 60 AND d >= 80) || [80], ',') AS ladder FROM orders""")
def dpi_ladders(spark, sf_dir):
    """X7 fallback resolutions."""
    dpi = F.substring("o_orderpriority", 1, 1).cast("int") * 60
    return s.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.array_join(fl.dpi_ladder(dpi, 80).cast("array<string>"), ",").alias("ladder"),
    )


@query("""
SELECT job_id, page_num, CASE WHEN page_num IS NULL THEN 'page_num missing' END AS reject
FROM (SELECT job_id, nullif(page_num, 7) AS page_num FROM v_changes)""")
def page_result_validity(spark, sf_dir):
    """F17; results of page 7 have lost their number."""
    number = F.expr("nullif(page_num, 7)").alias("page_num")
    ok, rejects = om.split_valid_page_results(s.page_changes(spark, sf_dir).select("job_id", number))
    none = F.lit(None).cast("string")
    return ok.withColumn("reject", none).unionByName(rejects.withColumn("reject", F.lit("page_num missing")))


@query("""
SELECT p_partkey AS image_id, CASE WHEN least(w, h) < 100 THEN 'Image too small: ' || w || 'x' || h || '. Minimum size is 100x100'
  WHEN greatest(w, h) > 1500 THEN 'Image too large: ' || w || 'x' || h || '. Maximum size is 1500x1500'
  WHEN mode NOT IN ('RGB', 'RGBA', 'L', 'P') THEN 'Unsupported image mode: ' || mode || '. Allowed modes: (''RGB'', ''RGBA'', ''L'', ''P'')'
  END AS error, round_even(w / 64.0::DOUBLE, 2) AS aspect
FROM (SELECT p_partkey, p_size * 40 + 1 AS w, CAST(p_retailprice AS INTEGER) + 1 AS h,
  CASE WHEN p_size < 10 THEN 'CMYK' WHEN p_size < 30 THEN 'RGB' ELSE 'L' END AS mode FROM part)""")
def image_validity(spark, sf_dir):
    """F9, X9 on part sizes as image sizes."""
    size = F.col("p_size")
    images = s.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("image_id"),
        (size * 40 + 1).alias("width"),
        (F.bround("p_retailprice").cast("int") + 1).alias("height"),
        F.when(size < 10, "CMYK").when(size < 30, "RGB").otherwise("L").alias("mode"),
    )
    checked = oc.image_errors(images, min_size=100, max_size=1500)
    return checked.select("image_id", "error", fl.aspect_ratio(F.col("width"), F.lit(64)).alias("aspect"))


@query("""
SELECT job_id, CAST((page_num - 1) // 40 + 1 AS INTEGER) AS page_num, string_agg(CAST(length(text) AS VARCHAR), ',' ORDER BY page_num DESC) AS lengths
FROM v_lines GROUP BY 1, 2""")
def blocks_in_reading_order(spark, sf_dir):
    """The blocks of each page read from the bottom up; a page holds at most 40."""
    line = F.col("page_num") - 1
    pages = (
        s.document_pages(spark, sf_dir)
        .groupBy("job_id", (F.floor(line / 40) + 1).cast("int").alias("page_num"))
        .agg(F.array_sort(F.collect_list(F.struct(line.alias("pos"), F.length("text").alias("n")))).alias("blocks"))
    )
    order = F.reverse(F.sequence(F.lit(0), F.size("blocks") - 1))
    read = od.blocks_in_reading_order(pages.withColumn("reading_order", order))
    return read.select(
        "job_id", "page_num", F.array_join(F.transform("ordered_blocks", lambda b: b["n"].cast("string")), ",").alias("lengths")
    )


@query("""
SELECT doc_id, CAST(n AS INTEGER) AS text_tokens, t AS vision_tokens,
  (q + CASE WHEN 2 * r > t OR 2 * r = t AND q %% 2 = 1 THEN 1 ELSE 0 END) / 100.0::DOUBLE AS ratio
FROM (SELECT *, 100 * n // t AS q, 100 * n %% t AS r FROM (SELECT doc_id, greatest(1, length(text) // 4) AS n, CASE lang WHEN 'en' THEN %d WHEN 'fr' THEN %d ELSE %d END AS t FROM documents))""" % (
    ft.VISION_TOKENS["tiny"], ft.VISION_TOKENS["large"], ft.DEFAULT_VISION_TOKENS))
def compression_ratios(spark, sf_dir):
    """X3 over whole texts, with a mode for each language."""
    mode = F.when(F.col("lang") == "en", "tiny").when(F.col("lang") == "fr", "large").otherwise(F.lit("no such mode"))
    return s.table(spark, sf_dir, "documents").select(
        "doc_id",
        ft.estimated_text_tokens(F.col("text")).alias("text_tokens"),
        ft.vision_tokens(mode).alias("vision_tokens"),
        ft.compression_ratio(F.col("text"), mode).alias("ratio"),
    )


@query("SELECT source AS folder, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS size_bytes FROM documents GROUP BY 1")
def registered_files(spark, sf_dir):
    """Texts written as files by Spark, then registered; sizes summed per folder."""
    path = scratch_dir(spark, "uploads")
    s.table(spark, sf_dir, "documents").select("source", F.col("text").alias("value")).write.partitionBy("source").text(path)
    files = sf.register_files(spark, path, "user", datetime(2024, 1, 1))
    folder = F.regexp_extract("storage_path", "source=([^/]*)/", 1)
    return files.groupBy(folder.alias("folder")).agg(F.sum("size_bytes").alias("size_bytes"))


@query("""
SELECT job_id, CAST((page_num - 1) // 512 AS BIGINT) AS part, count(*) AS pages,
  string_agg('<!-- Page ' || page_num || ' | Method: ' || upper(method) || ' | Time: ' || printf('%.2f', processing_time)
    || 's | Chars: ' || length(text) || ' -->' || chr(10) || text || chr(10) || chr(10), '' ORDER BY page_num) AS content
FROM v_text_pages GROUP BY 1, 2""")
def delivered_documents(spark, sf_dir):
    """The documents written as a table and read back."""
    path = scratch_dir(spark, "documents")
    sd.write_document(s.text_pages(spark, sf_dir), path, "parquet")
    return spark.read.parquet(path)
