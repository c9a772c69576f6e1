"""Prompt catalog, prompt libraries and chat commands as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import commands as fc
from pagemill.functions import prompts as fp

# The models, their prompts and the strategy map.
DEFAULT_MODEL = "qwen3-vl-8b"
QWEN_OPEN, QWEN_CLOSE = "<|im_start|>user\n<image>\n", "<|im_end|>\n<|im_start|>assistant\n"
_MERGE = (
    "Compare and merge these two text versions from the same document page:\n\n"
    "Embedded Text (from PDF):\n{embedded_text}\n\nOCR Text (from image):\n{ocr_text}\n\n"
    "Provide the most accurate merged version by combining both sources, fixing any OCR errors,"
    " and preserving layout. Return only the final text."
)
_SMALL_MERGE = (
    "Compare and merge these two text versions from the same document:\n\n"
    "Embedded Text:\n{embedded_text}\n\nOCR Text:\n{ocr_text}\n\n"
    "Provide the most accurate merged version. Return only the final text."
)
_OCR = "Extract all text from this image. Return only the text, preserving the original layout and formatting."
_MARKDOWN = "Convert this document to markdown format. Preserve headings, lists, tables, and formatting."
_STRUCTURED = "Extract structured data from this document in JSON format."
PROMPTS = {
    "qwen3-vl-8b": {
        "ocr": QWEN_OPEN + _OCR + QWEN_CLOSE,
        "markdown": QWEN_OPEN + _MARKDOWN + QWEN_CLOSE,
        "structured": QWEN_OPEN + _STRUCTURED + QWEN_CLOSE,
        "merge": QWEN_OPEN + _MERGE + QWEN_CLOSE,
    },
    "qwen3-vl-4b": {
        "ocr": QWEN_OPEN + _OCR + QWEN_CLOSE,
        "markdown": QWEN_OPEN + _MARKDOWN + QWEN_CLOSE,
        "structured": QWEN_OPEN + _STRUCTURED + QWEN_CLOSE,
        "merge": QWEN_OPEN + _MERGE + QWEN_CLOSE,
    },
    "qwen3-vl-2b": {
        "ocr": QWEN_OPEN + _OCR + QWEN_CLOSE,
        "markdown": QWEN_OPEN + "Convert this document to markdown format." + QWEN_CLOSE,
        "merge": QWEN_OPEN + _SMALL_MERGE + QWEN_CLOSE,
    },
    "deepseek-ocr": {
        "ocr": "<image>\nFree OCR. ",
        "markdown": "<image>\n<|grounding|>Convert the document to markdown. ",
        "structured": "<image>\n<|grounding|>Extract structured data. ",
        "merge": "<image>\n<|grounding|>Compare these texts:\n\nEmbedded: {embedded_text}\n\n"
        "OCR: {ocr_text}\n\nMerge accurately: ",
    },
}
FALLBACK_PROMPTS = {"deepseek": "<image>\nFree OCR. ", "qwen": "Extract all text from this image."}


def model_catalog(spark: SparkSession) -> DataFrame:
    """One row per (model, prompt_type) with its template and the default flag."""
    rows = [
        (model, kind, template, model == DEFAULT_MODEL)
        for model, prompts in PROMPTS.items()
        for kind, template in prompts.items()
    ]
    return spark.createDataFrame(rows, "model string, prompt_type string, template string, is_default boolean")


def resolve_prompts(jobs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds ``prompt``: the job's own, else the catalog's, else the family default.

    ``jobs`` has model, prompt_type and custom_prompt. The catalog is a fixed
    list of a few rows, which Spark broadcasts by itself.
    """
    known = catalog.select("model", "prompt_type", "template")
    family = F.when(F.lower("model").contains("deepseek"), FALLBACK_PROMPTS["deepseek"]).otherwise(
        FALLBACK_PROMPTS["qwen"]
    )
    return (
        jobs.join(known, ["model", "prompt_type"], "left")
        .withColumn("prompt", F.coalesce("custom_prompt", "template", family))
        .drop("template")
    )


def merge_prompts(defaults: DataFrame, custom: DataFrame) -> DataFrame:
    """Default prompts overlaid by custom ones; extra custom keys are kept."""
    d = defaults.select("prompt_type", F.col("template").alias("__default"))
    c = custom.select("prompt_type", F.col("template").alias("__custom"))
    return d.join(c, "prompt_type", "full").select(
        "prompt_type", F.coalesce("__custom", "__default").alias("template")
    )


def missing_variables(prompts: DataFrame) -> DataFrame:
    """Adds ``missing``, the required variables each template lacks."""
    return prompts.withColumn("missing", fp.missing_variables(F.col("template"), F.col("prompt_type")))


def validate_prompts(prompts: DataFrame) -> DataFrame:
    """Adds found variables, validity and warnings."""
    template, kind, model = F.col("template"), F.col("prompt_type"), F.col("model")
    return prompts.withColumns(
        {
            "found": fp.template_variables(template),
            "valid": F.size(fp.missing_variables(template, kind)) == 0,
            "warnings": fp.prompt_warnings(template, kind, model),
        }
    )


def export_prompts(lib: DataFrame) -> DataFrame:
    """One JSON text per prompt; written as JSON lines it is the library file."""
    return lib.select(F.to_json(F.struct("name", "text")).alias("json"))


def import_prompts(lib: DataFrame, incoming: DataFrame) -> DataFrame:
    """Adds prompts of unseen names from JSON arrays or objects; known names keep their text."""
    objects = F.from_json("json", "array<struct<name:string,text:string>>")
    rows = incoming.select(F.explode(objects).alias("p")).select("p.name", "p.text")
    return add_new_prompts(lib, rows.where("name IS NOT NULL"))


def add_new_prompts(lib: DataFrame, incoming: DataFrame) -> DataFrame:
    """Union by name; existing names win and incoming order does not matter."""
    return lib.unionByName(incoming.join(lib.select("name"), "name", "left_anti"))


def parse_commands(turns: DataFrame) -> DataFrame:
    """Adds the parsed command of each chat turn and its error, if any."""
    return turns.withColumn("__c", fc.parse_command(F.col("text"))).select(
        *turns.columns, "__c.*", fc.command_error(F.col("__c")).alias("error")
    )
