"""SQL twins of the stand-in entities, written independently of the Spark code."""

from __future__ import annotations

import re

_VERSION = (
    "l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC,"
    " l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC"
)


def _newest(expr: str, name: str) -> str:
    return f"first({expr} ORDER BY {_VERSION}) FILTER ({expr} IS NOT NULL) AS {name}"


VIEWS = {
    "v_users": "SELECT c_custkey AS user_id, c_name AS email, c_acctbal > 0 AS is_active FROM customer",
    "v_files": """
SELECT *, uploaded_at + INTERVAL 6 HOUR AS expires_at,
  CASE WHEN size_bytes < 100 THEN uploaded_at + INTERVAL 1 HOUR END AS deleted_at
FROM (SELECT doc_id AS file_id, source AS user_id, source AS storage_bucket,
  'scan_' || doc_id || CASE lang WHEN 'en' THEN '.pdf' WHEN 'fr' THEN '.PNG' WHEN 'de' THEN '.jpeg'
    ELSE '.docx' END AS filename,
  CASE lang WHEN 'de' THEN 'image/jpeg' WHEN 'es' THEN 'text/plain' END AS content_type,
  n_chars AS size_bytes,
  TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS uploaded_at FROM documents)""",
    "v_jobs": """
SELECT job_id, user_id, parent_batch_id, file_id, status, created_at,
  CASE WHEN status <> 'queued' THEN created_at END AS started_at,
  CASE WHEN status IN ('completed', 'failed') THEN created_at + to_seconds(floor(price)) END AS completed_at,
  CASE status WHEN 'completed' THEN 100.0::DOUBLE
    WHEN 'processing' THEN (CAST(round(price * 100) AS BIGINT) % 10000) / 100.0::DOUBLE
    ELSE 0.0::DOUBLE END AS progress_pct,
  CASE WHEN status = 'failed' THEN 'extraction failed' END AS error_message,
  CASE prio WHEN '1-URGENT' THEN 'qwen3-vl-8b' WHEN '2-HIGH' THEN 'qwen3-vl-4b' ELSE 'deepseek-ocr' END AS model,
  CASE prio WHEN '5-LOW' THEN 'text' ELSE 'markdown' END AS output_format,
  CASE WHEN prio <> '4-NOT SPECIFIED' THEN CAST(left(prio, 1) AS INTEGER) * 100 END AS dpi,
  CASE WHEN prio = '3-MEDIUM' THEN 'hybrid' END AS method
FROM (SELECT o_orderkey AS job_id, o_custkey AS user_id, o_custkey AS parent_batch_id,
  o_orderkey % (SELECT count(*) FROM documents) AS file_id,
  CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'processing'
    WHEN o_orderpriority LIKE '1%' THEN 'failed' ELSE 'queued' END AS status,
  o_orderdate AS created_at, o_totalprice AS price, o_orderpriority AS prio FROM orders)""",
    "v_batches": """
SELECT parent_batch_id AS batch_job_id, min(created_at) AS created_at,
  CASE WHEN count(*) FILTER (status IN ('processing', 'queued')) > 0 THEN 'processing'
    WHEN count(*) FILTER (status = 'completed') > 0 THEN 'completed' ELSE 'failed' END AS status,
  count(*) AS total_documents
FROM v_jobs GROUP BY 1""",
    "v_changes": """
SELECT l_orderkey AS job_id, l_linenumber AS page_num,
  CASE l_returnflag WHEN 'A' THEN 'ocr' WHEN 'N' THEN 'hybrid' ELSE 'embedded' END AS method,
  l_quantity AS processing_time, l_shipdate AS completed_at,
  CASE WHEN l_linestatus = 'F' THEN 'ocr ' || l_partkey END AS ocr_text,
  CASE WHEN l_returnflag = 'N' THEN 'merge ' || l_suppkey END AS merge_text,
  l_linestatus = 'F' AS is_done FROM lineitem""",
    "v_pages": f"""
SELECT l_orderkey AS job_id, l_linenumber AS page_num,
  {_newest("CASE l_returnflag WHEN 'A' THEN 'ocr' WHEN 'N' THEN 'hybrid' ELSE 'embedded' END", "method")},
  {_newest("l_quantity", "processing_time")},
  {_newest("l_shipdate", "completed_at")},
  {_newest("CASE WHEN l_linestatus = 'F' THEN 'ocr ' || l_partkey END", "ocr_text")},
  {_newest("CASE WHEN l_returnflag = 'N' THEN 'merge ' || l_suppkey END", "merge_text")},
  {_newest("l_linestatus = 'F'", "is_done")}
FROM lineitem GROUP BY 1, 2""",
    "v_lines": """
SELECT doc_id AS job_id, CAST(pos AS INTEGER) AS page_num, source, lang, text FROM (
  SELECT doc_id, source, lang, generate_subscripts(string_split(text, chr(10)), 1) AS pos,
    unnest(string_split(text, chr(10))) AS text FROM documents)""",
    "v_text_pages": """
SELECT job_id, page_num, CASE WHEN length(text) < 10 THEN 'ocr' WHEN length(text) < 300 THEN 'hybrid'
  ELSE 'embedded' END AS method, length(text) / 4.0::DOUBLE AS processing_time, text FROM v_lines""",
    "v_log": """
SELECT event_id, user_id AS job_id, ts AS timestamp,
  CASE WHEN event_type = 'click' THEN 'metric' WHEN event_type IN ('view', 'purchase') THEN 'page_completion'
    WHEN event_type = 'signup' THEN 'stage_transition' ELSE 'error' END AS event_type,
  CASE event_type WHEN 'view' THEN 'ocr' WHEN 'purchase' THEN 'merge' END AS stage,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS page_number, value AS page_duration_s,
  CAST(round(value * 100) AS BIGINT) % 10000 / 100.0::DOUBLE AS cpu_percent,
  CAST(round(value * 200) AS BIGINT) % 10000 / 100.0::DOUBLE AS ram_percent,
  CAST(event_id % 2 AS INTEGER) AS gpu_id, value AS memory_used_mb, 512.0::DOUBLE AS memory_total_mb,
  CAST(round(value * 100) AS BIGINT) % 10000 / 100.0::DOUBLE AS progress_pct
FROM events""",
    "v_blocks": """
SELECT job_id, page_num, CASE WHEN x0 < 50 AND length(text) < 4 AND regexp_full_match(text, '[0-9]+')
      AND CAST(text AS INTEGER) BETWEEN 1 AND 25 THEN 'line_number'
    WHEN y0 < 100 AND font_size > 14 THEN 'header'
    WHEN text IN ('Q', 'A') OR starts_with(text, 'Q   ') OR starts_with(text, 'A   ') THEN 'qa_marker'
    WHEN y0 + 20 > 700 THEN 'footer' ELSE 'body' END AS block_type
FROM (SELECT job_id, CAST((page_num - 1) // 40 + 1 AS INTEGER) AS page_num,
  CASE WHEN length(text) < 100 THEN 10 ELSE 50 END AS x0, (page_num - 1) % 40 * 25 AS y0,
  CASE WHEN length(text) < 100 THEN CAST(length(text) % 30 AS VARCHAR) ELSE text END AS text,
  CASE WHEN length(text) % 7 = 0 THEN 18 ELSE 12 END AS font_size FROM v_lines)""",
    "v_line_chunks": """
SELECT job_id, page_num AS chunk_sequence, text AS chunk_text,
  TIMESTAMP '2024-01-01' + to_milliseconds(page_num * 30 + length(text) % 50) AS created_at,
  page_num = max(page_num) OVER (PARTITION BY job_id) AS is_final FROM v_lines""",
    "v_commands": """
SELECT user_id AS job_id, CAST(floor(CAST(json_extract_string(props, '$.k') AS INTEGER) / 25) AS INTEGER) AS page_num,
  event_id AS order_no, CASE event_type WHEN 'click' THEN 'snapshot' WHEN 'view' THEN 'stage' WHEN 'signup' THEN 'stage'
    WHEN 'purchase' THEN 'complete' ELSE 'failed' END AS kind,
  CASE event_type WHEN 'click' THEN 'merge' WHEN 'view' THEN 'ocr' WHEN 'signup' THEN 'merge' END AS stage,
  CASE WHEN event_type IN ('click', 'purchase') THEN 'text ' || event_id END AS snapshot_text,
  CASE WHEN event_type = 'click' THEN value > 100 END AS is_final,
  CASE WHEN event_type = 'error' THEN 'error ' || event_id END AS error, ts AS updated_at FROM events""",
    "v_prompts": "SELECT 'prompt ' || item_id AS name, text FROM benchmark",
}


def with_views(sql: str) -> str:
    """Prefixes a query with the views it uses, in order of definition."""

    def used(text: str) -> set[str]:
        found = {v for v in VIEWS if re.search(rf"\b{v}\b", text)}
        for v in list(found):
            found |= used(VIEWS[v]) - {v}
        return found

    names = [v for v in VIEWS if v in used(sql)]
    if not names:
        return sql.strip()
    ctes = ",\n".join(f"{v} AS ({VIEWS[v].strip()})" for v in names)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
