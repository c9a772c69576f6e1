"""Progress, remaining time, alerts and verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.times import micros

WARN_PERCENT, ERROR_PERCENT = 85, 95
WARN_CELSIUS, ERROR_CELSIUS = 80, 90


def elapsed_seconds(started: Column, completed: Column) -> Column:
    """Completed minus started in seconds, 0 when either is missing."""
    return F.coalesce((micros(completed) - micros(started)) / 1e6, F.lit(0.0))


def eta_seconds(status: Column, pct: Column, started: Column, now: Column) -> Column:
    """Whole seconds left; null unless the job is running and has progressed."""
    elapsed = (micros(now) - micros(started)) / 1e6
    left = elapsed / (pct / 100.0) - elapsed
    return F.when((status == "processing") & (pct > 0) & started.isNotNull(), left.cast("bigint"))


def percent(value: Column) -> Column:
    """Values above 1 are taken as percent, others as fractions."""
    return F.when(value > 1, value).otherwise(value * 100)


def fraction(value: Column) -> Column:
    """The same as a fraction of 1."""
    return F.when(value > 1, value / 100).otherwise(value)


def stage_percent(stage_page: Column, total_pages: Column) -> Column:
    """Percent after the 0-based page, one decimal; null without pages."""
    pct = (stage_page + 1) / F.when(total_pages > 0, total_pages) * 100
    return F.bround(pct, 1)


def _alert(value: Column, warn: float, error: float, subject: Column, high: str, unit: str, shown: Column) -> Column:
    level = F.when(value >= error, "error").when(value >= warn, "warning")
    word = F.when(value >= error, "critical").otherwise(high)
    message = F.concat(subject, F.lit(" "), word, F.lit(": "), shown, F.lit(unit))
    return F.when(level.isNotNull(), F.struct(level.alias("type"), message.alias("message")))


def percent_alert(value: Column, subject: Column) -> Column:
    """Warning from 85 %, error from 95 %; null below."""
    return _alert(value, WARN_PERCENT, ERROR_PERCENT, subject, "high", "%", F.format_string("%.1f", value))


def temperature_alert(celsius: Column, subject: Column) -> Column:
    """Warning from 80 degrees, error from 90; null below or when unknown."""
    return _alert(
        celsius, WARN_CELSIUS, ERROR_CELSIUS, subject, "high", "°C",
        F.regexp_replace(celsius.cast("string"), r"\.0$", ""),
    )


def gpu_alerts(gpus: Column) -> Column:
    """Alerts of an array of device samples, device by device; null without samples."""

    def of(gpu: Column) -> Column:
        name = F.concat(F.lit("GPU "), gpu["id"].cast("string"))
        used = F.try_divide(gpu["memory_used_mb"], gpu["memory_total_mb"]) * 100
        return F.array(
            percent_alert(used, F.concat(name, F.lit(" memory"))),
            temperature_alert(gpu["temperature_c"], F.concat(name, F.lit(" temperature"))),
        )

    return F.array_compact(F.flatten(F.transform(gpus, of)))


def host_alerts(cpu_percent: Column, ram_percent: Column) -> Column:
    """Alerts of the host's CPU and memory use."""
    return F.array_compact(
        F.array(percent_alert(cpu_percent, F.lit("CPU usage")), percent_alert(ram_percent, F.lit("RAM usage")))
    )


def ensemble_verdict(verdicts: Column) -> Column:
    """Combined verdict of an ordered array of struct(valid, issues).

    All valid: valid without issues. None valid: every non-empty issue, joined.
    Mixed: the issues of the first verdict that is invalid.
    """
    invalid = F.filter(verdicts, lambda v: ~v["valid"])
    texts = F.filter(F.transform(verdicts, lambda v: v["issues"]), lambda t: t != "")
    return F.struct(
        (F.size(invalid) == 0).alias("valid"),
        F.when(F.size(invalid) == 0, F.lit(""))
        .when(F.size(invalid) == F.size(verdicts), F.array_join(texts, " | "))
        .otherwise(F.get(invalid, F.lit(0))["issues"])
        .alias("issues"),
    )


def same_or_absent(left: Column, right: Column) -> Column:
    """Equal, or missing on at least one side."""
    return F.coalesce(left == right, F.lit(True))


def checkpoint_is_usable(saved: Column, current: Column, stages: tuple[str, ...] = ("ocr", "merge", "completed")) -> Column:
    """A saved state fits the run: same paths, same settings where both name them, known stage."""
    return (
        F.coalesce(saved["input_path"] == current["input_path"], F.lit(False))
        & F.coalesce(saved["output_path"] == current["output_path"], F.lit(False))
        & F.coalesce(saved["stage"].isin(*stages), F.lit(False))
        & same_or_absent(saved["dpi"], current["dpi"])
        & same_or_absent(saved["method"], current["method"])
        & same_or_absent(saved["format"], current["format"])
    )
