"""Registered queries over prompts, chat commands and message payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import commands as fc
from pagemill.functions import messages as fm
from pagemill.functions import progress as fp
from pagemill.functions import prompts as fpr
from pagemill.operators import prompts as op
from pagemill.plans.registry import query
from pagemill.sources import standins as s

_TEMPLATES = """
(SELECT conv_id, turn, role, CASE role WHEN 'user' THEN 'ocr' WHEN 'assistant' THEN 'merge' ELSE 'table' END AS prompt_type,
  CASE WHEN turn % 2 = 0 THEN '{image} ' || text ELSE text || '{ocr_text}' END AS template,
  CASE WHEN turn % 3 = 0 THEN 'qwen3-vl-8b' ELSE 'deepseek-ocr' END AS model FROM conversations)"""


def _templates(spark, sf_dir):
    """Chat turns turned into prompt templates of several types."""
    role, turn, text = F.col("role"), F.col("turn"), F.col("text")
    return s.table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        "role",
        F.when(role == "user", "ocr").when(role == "assistant", "merge").otherwise("table").alias("prompt_type"),
        F.when(turn % 2 == 0, F.concat(F.lit("{image} "), text))
        .otherwise(F.concat(text, F.lit("{ocr_text}")))
        .alias("template"),
        F.when(turn % 3 == 0, "qwen3-vl-8b").otherwise("deepseek-ocr").alias("model"),
    )


_MISSING = """CASE WHEN prompt_type = 'merge' THEN CASE WHEN contains(template, '{image}') THEN 'embedded_text, ocr_text'
    ELSE 'image, embedded_text' END
  WHEN contains(template, '{image}') THEN '' ELSE 'image' END"""


@query(f"SELECT conv_id, turn, {_MISSING} AS missing FROM {_TEMPLATES}")
def missing_prompt_variables(spark, sf_dir):
    """U2."""
    df = op.missing_variables(_templates(spark, sf_dir))
    return df.select("conv_id", "turn", F.array_join("missing", ", ").alias("missing"))


@query(f"""
SELECT conv_id, turn, array_to_string(regexp_extract_all(template, '\\{{(\\w+)\\}}', 1), ',') AS found, m = '' AS valid,
  CASE WHEN m <> '' THEN 'Missing required variables: ' || m ELSE array_to_string(list_filter([
    CASE WHEN length(template) < 20 THEN 'Prompt template is very short, may not be effective'
      WHEN length(template) > 2000 THEN 'Prompt template is very long, may cause token limits' END,
    CASE WHEN starts_with(model, 'qwen') AND NOT contains(template, '<|im_start|>') THEN 'Qwen models typically use <|im_start|> tags in prompts' END,
    CASE WHEN starts_with(model, 'deepseek') AND NOT contains(template, '<image>') THEN 'DeepSeek models require <image> tag for vision input' END],
    lambda x: x IS NOT NULL), ' / ') END AS warnings
FROM (SELECT *, {_MISSING} AS m FROM {_TEMPLATES})""")
def prompt_checks(spark, sf_dir):
    """X12."""
    df = op.validate_prompts(_templates(spark, sf_dir))
    return df.select(
        "conv_id",
        "turn",
        F.array_join("found", ",").alias("found"),
        "valid",
        F.array_join("warnings", " / ").alias("warnings"),
    )


@query("""
SELECT conv_id, turn, 'Embedded: ' || text || ' | OCR: ' || role || ' {embedded_text} | ' || text AS prompt FROM conversations""")
def filled_prompts(spark, sf_dir):
    """Values holding placeholders stay as they are."""
    values = {
        "embedded_text": F.col("text"),
        "ocr_text": F.concat("role", F.lit(" {embedded_text}")),
    }
    template = F.lit("Embedded: {embedded_text} | OCR: {ocr_text} | {embedded_text}")
    return s.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", fpr.fill_template(template, values).alias("prompt")
    )


_CHAT = """
(SELECT conv_id, turn, CASE turn % 12 WHEN 0 THEN 'Parse page ' || conv_id
  WHEN 2 THEN 'parse pages ' || conv_id || '-' || (conv_id * turn) WHEN 4 THEN ' show as JSON ' WHEN 6 THEN 'get the results'
  ELSE text END AS text FROM conversations WHERE role = 'user')"""


def _chat(spark, sf_dir):
    turn, conv = F.col("turn"), F.col("conv_id").cast("string")
    return s.chat(spark, sf_dir).withColumn(
        "text",
        F.when(turn % 12 == 0, F.concat(F.lit("Parse page "), conv))
        .when(turn % 12 == 2, F.concat(F.lit("parse pages "), conv, F.lit("-"), (F.col("conv_id") * turn).cast("string")))
        .when(turn % 12 == 4, " show as JSON ")
        .when(turn % 12 == 6, "get the results")
        .otherwise(F.col("text")),
    )


@query(f"""
SELECT conv_id, turn, text, type, page_number, start_page, end_page, format,
  CASE WHEN page_number < 1 THEN 'Page number must be a positive integer'
    WHEN start_page < 1 OR end_page < 1 THEN 'Page numbers must be positive integers'
    WHEN start_page > end_page THEN 'Start page must be less than or equal to end page' END AS error
FROM (SELECT *,
  CASE WHEN type = 'parse_page' THEN CAST(regexp_extract(t, 'parse page (\\d+)', 1) AS BIGINT) END AS page_number,
  CASE WHEN type = 'parse_range' THEN CAST(regexp_extract(t, 'parse pages? (\\d+)[-\\s]?(?:to|through)?\\s?(\\d+)', 1) AS BIGINT) END AS start_page,
  CASE WHEN type = 'parse_range' THEN CAST(regexp_extract(t, 'parse pages? (\\d+)[-\\s]?(?:to|through)?\\s?(\\d+)', 2) AS BIGINT) END AS end_page,
  CASE WHEN type = 'change_format' THEN regexp_extract(t, '(?:show|output|format) (?:as |in )?(\\w+)', 1) END AS format
  FROM (SELECT *, CASE
    WHEN regexp_matches(t, 'parse (the )?(whole |entire )?(directory|batch|all files)') THEN 'parse_directory'
    WHEN regexp_matches(t, 'parse (the )?(whole |entire )?(document|file|pdf)') THEN 'parse_all'
    WHEN regexp_matches(t, 'parse page (\\d+)') THEN 'parse_page'
    WHEN regexp_matches(t, 'parse pages? (\\d+)[-\\s]?(?:to|through)?\\s?(\\d+)') THEN 'parse_range'
    WHEN regexp_extract(t, '(?:show|output|format) (?:as |in )?(\\w+)', 1) IN ('markdown', 'text', 'json') THEN 'change_format'
    WHEN regexp_matches(t, 'status|progress') THEN 'check_status'
    WHEN regexp_matches(t, '(get|show|display) (the )?results?') THEN 'get_results'
    WHEN regexp_matches(t, 'cancel|stop') THEN 'cancel' ELSE 'unknown' END AS type
    FROM (SELECT *, lower(trim(text)) AS t FROM {_CHAT})))""")
def chat_commands(spark, sf_dir):
    """X14."""
    return op.parse_commands(_chat(spark, sf_dir))


@query("""
SELECT conv_id, turn, typed, array_to_string(list_filter(['Parse the whole document', 'Parse page 5', 'Parse pages 1 to 10',
  'Parse the whole directory', 'Parse directory', 'Show as JSON', 'Show as markdown', 'Show as text', 'Check status',
  'Get results'], lambda x: contains(lower(x), lower(typed))), '|') AS suggestions
FROM (SELECT conv_id, turn, unnest(list_distinct(string_split(text, ' '))) AS typed FROM conversations WHERE role = 'user')""")
def command_suggestions(spark, sf_dir):
    """X15 for every word typed."""
    typed = F.explode(F.array_distinct(F.split("text", " "))).alias("typed")
    return s.chat(spark, sf_dir).select("conv_id", "turn", typed).select(
        "conv_id", "turn", "typed", F.array_join(fc.suggestions(F.col("typed")), "|").alias("suggestions")
    )


@query("""
SELECT prompt_type, coalesce(c.template, d.template) AS template FROM
  (SELECT 'item ' || item_id AS prompt_type, text AS template FROM benchmark) d FULL JOIN
  (SELECT 'item ' || conv_id AS prompt_type, min(text) AS template FROM conversations GROUP BY 1) c USING (prompt_type)""")
def merged_prompts(spark, sf_dir):
    """J7."""
    defaults = s.table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("item "), "item_id").alias("prompt_type"), F.col("text").alias("template")
    )
    custom = (
        s.table(spark, sf_dir, "conversations")
        .groupBy(F.concat(F.lit("item "), "conv_id").alias("prompt_type"))
        .agg(F.min("text").alias("template"))
    )
    return op.merge_prompts(defaults, custom)


_INCOMING = "(SELECT 'prompt ' || conv_id AS name, text FROM conversations)"


@query(f"""
SELECT name, text FROM v_prompts UNION ALL SELECT name, text FROM {_INCOMING}
WHERE name NOT IN (SELECT name FROM v_prompts)""")
def added_prompts(spark, sf_dir):
    """U3."""
    incoming = s.table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("prompt "), "conv_id").alias("name"), "text"
    )
    return op.add_new_prompts(s.prompt_library(spark, sf_dir), incoming)


@query(f"""
SELECT name, text FROM v_prompts UNION ALL SELECT name, text FROM {_INCOMING}
WHERE name NOT IN (SELECT name FROM v_prompts)""")
def imported_prompts(spark, sf_dir):
    """Exported as JSON and imported again."""
    incoming = s.table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("prompt "), "conv_id").alias("name"), "text"
    )
    exported = op.export_prompts(incoming)
    return op.import_prompts(s.prompt_library(spark, sf_dir), exported)


@query("""
SELECT job_id, model, 'ocr' AS prompt_type, custom_prompt, coalesce(custom_prompt, CASE WHEN model = 'deepseek-ocr'
  THEN '<image>' || chr(10) || 'Free OCR. ' ELSE '<|im_start|>user' || chr(10) || '<image>' || chr(10) ||
  'Extract all text from this image. Return only the text, preserving the original layout and formatting.' ||
  '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) END) AS prompt
FROM (SELECT job_id, model, CASE WHEN output_format = 'text' THEN 'plain text of file ' || file_id END AS custom_prompt FROM v_jobs)""")
def resolved_prompts(spark, sf_dir):
    """M10, S13."""
    jobs = s.jobs(spark, sf_dir).select(
        "job_id",
        "model",
        F.lit("ocr").alias("prompt_type"),
        F.when(F.col("output_format") == "text", F.concat(F.lit("plain text of file "), "file_id")).alias("custom_prompt"),
    )
    return op.resolve_prompts(jobs, op.model_catalog(spark))


@query("""
SELECT conv_id, turn, 'Read ' || text || ' thanks' AS prompt, 'QUJD' || turn AS image FROM conversations""")
def flattened_messages(spark, sf_dir):
    """X25."""
    part = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("text"))
    image = F.struct(
        F.lit("image_url").alias("type"),
        F.struct(F.concat(F.lit("data:image/png;base64,QUJD"), "turn").alias("url")).alias("image_url"),
    )
    remote = F.struct(
        F.lit("image_url").alias("type"), F.struct(F.lit("https://example.org/a.png").alias("url")).alias("image_url")
    )
    content = F.concat(
        F.lit("["), F.to_json(part("text", F.col("text"))), F.lit(","), F.to_json(image), F.lit(","), F.to_json(remote), F.lit("]")
    )
    messages = F.concat(
        F.lit('[{"role":"system","content":"Read"},{"role":"user","content":'),
        content,
        F.lit('},{"role":"user","content":"thanks"}]'),
    )
    return (
        s.table(spark, sf_dir, "conversations")
        .withColumn("messages", messages)
        .select(
            "conv_id",
            "turn",
            fm.message_prompt(F.col("messages")).alias("prompt"),
            fm.message_image(F.col("messages")).alias("image"),
        )
    )


@query("SELECT conv_id, turn, CASE WHEN text = '' THEN 1 ELSE 2 END::BIGINT AS chunks, text || role AS text FROM conversations")
def sse_texts(spark, sf_dir):
    """One event stream per turn, with a blank line, bad JSON and an end mark."""

    def data(value):
        delta = F.struct(F.struct(value.alias("content")).alias("delta"))
        return F.concat(F.lit("data: "), F.to_json(F.struct(F.array(delta).alias("choices"))))

    lines = F.array(
        data(F.col("text")), F.lit(""), F.lit("data: {broken"), F.lit(": comment"), data(F.col("role")),
        F.lit("data: [DONE]"), data(F.lit("late")),
    )
    texts = F.filter(F.transform(fm.sse_chunks(lines), fm.chunk_text), lambda t: t.isNotNull())
    return (
        s.table(spark, sf_dir, "conversations")
        .select("conv_id", "turn", F.size(texts).cast("bigint").alias("chunks"), F.array_join(texts, "").alias("text"))
    )


@query("""
SELECT doc_id, quality = 1 AND toxic = 0 AS valid, CASE WHEN quality = 1 AND toxic = 0 THEN ''
  WHEN quality = 0 AND toxic = 1 THEN 'low quality | toxic' WHEN quality = 0 THEN 'low quality' ELSE 'toxic' END AS issues
FROM labels""")
def ensemble_verdicts(spark, sf_dir):
    """X29."""
    def verdict(valid, issue):
        return F.struct(valid.alias("valid"), F.when(valid, "").otherwise(issue).alias("issues"))

    both = F.array(verdict(F.col("quality") == 1, "low quality"), verdict(F.col("toxic") == 0, "toxic"))
    result = fp.ensemble_verdict(both)
    return s.table(spark, sf_dir, "labels").select(
        "doc_id", result["valid"].alias("valid"), result["issues"].alias("issues")
    )


@query("""
SELECT job_id, status = 'completed' AND coalesce(dpi = 300, true) AND coalesce(method = 'hybrid', true) AS usable FROM v_jobs""")
def usable_checkpoints(spark, sf_dir):
    """X30."""
    saved = F.struct(
        F.lit("in.pdf").alias("input_path"),
        F.lit("out.md").alias("output_path"),
        F.when(F.col("status") == "completed", "merge").otherwise("init").alias("stage"),
        F.col("dpi").alias("dpi"),
        F.col("method").alias("method"),
        F.col("output_format").alias("format"),
    )
    current = F.struct(
        F.lit("in.pdf").alias("input_path"),
        F.lit("out.md").alias("output_path"),
        F.lit(300).alias("dpi"),
        F.lit("hybrid").alias("method"),
        F.lit(None).cast("string").alias("format"),
    )
    return s.jobs(spark, sf_dir).select("job_id", fp.checkpoint_is_usable(saved, current).alias("usable"))
