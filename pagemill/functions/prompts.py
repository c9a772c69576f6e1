"""Prompt templates: variables, checks and one-pass filling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Variables each prompt type must contain.
REQUIRED_VARIABLES = {
    "ocr": ["image"],
    "markdown": ["image"],
    "merge": ["image", "embedded_text", "ocr_text"],
    "structured": ["image"],
}
SHORT_WARNING = "Prompt template is very short, may not be effective"
LONG_WARNING = "Prompt template is very long, may cause token limits"
QWEN_WARNING = "Qwen models typically use <|im_start|> tags in prompts"
DEEPSEEK_WARNING = "DeepSeek models require <image> tag for vision input"


def template_variables(template: Column) -> Column:
    """Names in braces, in order of appearance."""
    return F.regexp_extract_all(template, F.lit(r"\{(\w+)\}"), 1)


def required_variables(prompt_type: Column) -> Column:
    """Variables a prompt of this type needs; unknown types need the image."""
    pairs: list[Column] = []
    for kind, names in REQUIRED_VARIABLES.items():
        pairs += [F.lit(kind), F.array(*[F.lit(n) for n in names])]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), prompt_type), F.array(F.lit("image")))


def missing_variables(template: Column, prompt_type: Column) -> Column:
    """Required variables the template lacks."""
    return F.array_except(required_variables(prompt_type), template_variables(template))


def prompt_warnings(template: Column, prompt_type: Column, model: Column) -> Column:
    """Warnings; a prompt with missing variables carries only that one."""
    missing = missing_variables(template, prompt_type)
    n = F.length(template)
    soft = F.array_compact(
        F.array(
            F.when(n < 20, SHORT_WARNING).when(n > 2000, LONG_WARNING),
            F.when(model.startswith("qwen") & ~template.contains("<|im_start|>"), QWEN_WARNING),
            F.when(model.startswith("deepseek") & ~template.contains("<image>"), DEEPSEEK_WARNING),
        )
    )
    hard = F.array(F.concat(F.lit("Missing required variables: "), F.array_join(missing, ", ")))
    return F.when(F.size(missing) > 0, hard).otherwise(soft)


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Replaces each ``{name}`` once; text put in is never expanded again.

    The template is split at its placeholders and rejoined with the values, so
    a value that itself contains a placeholder or regex syntax stays as it is.
    """
    pattern = r"\{(" + "|".join(values) + r")\}"
    literals = F.split(template, pattern, -1)
    names = F.regexp_extract_all(template, F.lit(pattern), 1)

    def value_of(name: Column) -> Column:
        filled = F.lit("")
        for key, value in values.items():
            filled = F.when(name == key, F.coalesce(value, F.lit(""))).otherwise(filled)
        return filled

    return F.array_join(F.zip_with(literals, names, lambda lit, name: F.concat(lit, value_of(name))), "")
