"""Text measures, page markers, error classes and human-readable formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vision tokens per resolution mode.
VISION_TOKENS = {
    "tiny": 64,
    "small": 100,
    "base": 256,
    "large": 400,
    "gundam": 256,
    "gundam-m": 400,
}
DEFAULT_VISION_TOKENS = 256

# (?U) makes \s cover every Unicode white space, as the page text may hold.
EDGE_SPACE = r"(?U)^\s+|\s+$"
SPACE_RUN = r"(?U)\s+"

# White space as the SQL has it: \s is that of ASCII, and trim takes all space separators, but no tabs or line ends.
SQL_SPACE_RUN = r"[\t\n\f\r ]+"
SQL_TRIMMED = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Text without leading and trailing white space of any kind."""
    return F.regexp_replace(text, EDGE_SPACE, "")


def lower_each(text: Column) -> Column:
    """Lower case letter by letter: a capital sigma at the end of a word and a capital I with a dot become one plain letter."""
    return F.lower(F.replace(F.replace(text, F.lit("\u03a3"), F.lit("\u03c3")), F.lit("\u0130"), F.lit("i")))


def has_embedded_text(text: Column, min_chars: int = 10) -> Column:
    """at least ``min_chars`` characters once stripped; null text has none.

    Looks for a first and a last character that are no white space, so it stops as soon as enough text is seen.
    """
    if min_chars < 1:
        return text.isNotNull()
    enough = r"(?Us)\S" if min_chars == 1 else rf"(?Us)\S.{{{min_chars - 2},}}?\S"
    return F.coalesce(text.rlike(enough), F.lit(False))


def char_count(text: Column) -> Column:
    """Characters (code points)."""
    return F.length(text)


def word_count(text: Column) -> Column:
    """Runs of non-space characters."""
    return F.size(F.filter(F.split(text, SPACE_RUN), lambda w: w != ""))


def page_marker(page_num: Column, method: Column, seconds: Column, text: Column) -> Column:
    """The comment line written before each page."""
    return F.format_string(
        "<!-- Page %d | Method: %s | Time: %.2fs | Chars: %d -->",
        page_num,
        F.upper(method),
        seconds.cast("double"),
        F.length(text),
    )


def page_block(page_num: Column, method: Column, seconds: Column, text: Column) -> Column:
    """One page as written to a document: marker line, text, blank line."""
    body = F.coalesce(text, F.lit(""))
    return F.concat(page_marker(page_num, method, seconds, body), F.lit("\n"), body, F.lit("\n\n"))


def estimated_text_tokens(text: Column) -> Column:
    """A quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def vision_tokens(resolution_mode: Column) -> Column:
    """Vision tokens of a resolution mode; unknown modes count as base."""
    pairs = [F.lit(v) for kv in VISION_TOKENS.items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), resolution_mode), F.lit(DEFAULT_VISION_TOKENS))


def compression_ratio(text: Column, resolution_mode: Column) -> Column:
    """Text tokens per vision token, two decimals, ties to even."""
    return F.bround(estimated_text_tokens(text) / vision_tokens(resolution_mode), 2)


def is_out_of_memory(message: Column, wide: bool = True) -> Column:
    """Memory-class errors; the narrow form leaves out a bare ``oom``."""
    pattern = "out of memory|cuda|oom" if wide else "out of memory|cuda"
    return F.coalesce(F.lower(message).rlike(pattern), F.lit(False))


def _trimmed_number(value: Column) -> Column:
    """Two decimals without trailing zeros."""
    return F.regexp_replace(F.format_string("%.2f", value), r"\.?0+$", "")


def format_bytes(size: Column) -> Column:
    """1024-based size with at most two decimals; GB is the largest unit."""
    b = size.cast("double")
    return (
        F.when(b == 0, F.lit("0 B"))
        .when(b < 1024, F.concat(_trimmed_number(b), F.lit(" B")))
        .when(b < 1024**2, F.concat(_trimmed_number(b / 1024), F.lit(" KB")))
        .when(b < 1024**3, F.concat(_trimmed_number(b / 1024**2), F.lit(" MB")))
        .otherwise(F.concat(_trimmed_number(b / 1024**3), F.lit(" GB")))
    )


def format_duration(seconds: Column) -> Column:
    """``12.3s``, ``4m 5s`` or ``2h 7m``."""
    s = seconds.cast("double")
    minutes = F.floor(s / 60).cast("bigint")
    return (
        F.when(s < 60, F.format_string("%.1fs", s))
        .when(minutes < 60, F.format_string("%dm %ds", minutes, F.floor(s % 60).cast("bigint")))
        .otherwise(F.format_string("%dh %dm", F.floor(minutes / 60).cast("bigint"), minutes % 60))
    )


def truncate(text: Column, max_length: int) -> Column:
    """Cut to ``max_length`` characters, the last three being dots."""
    cut = F.concat(F.substring(text, 1, max_length - 3), F.lit("..."))
    return F.when(F.length(text) <= max_length, text).otherwise(cut)


def relative_time(ts: Column, now: Column) -> Column:
    """``Just now``, minutes ago, clock time today, days ago, or the date."""
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(ts.cast("timestamp"))
    minutes = F.floor(age / 60).cast("bigint")
    days = F.floor(age / 86400).cast("bigint")

    def ago(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n > 1, "s").otherwise(""), F.lit(" ago"))

    return (
        F.when(age < 60, F.lit("Just now"))
        .when(age < 3600, ago(minutes, "minute"))
        .when(F.to_date(ts) == F.to_date(now), F.date_format(ts, "h:mm a"))
        .when(age < 7 * 86400, ago(F.greatest(days, F.lit(0)), "day"))
        .when(F.year(ts) == F.year(now), F.date_format(ts, "MMM d"))
        .otherwise(F.date_format(ts, "MMM d, yyyy"))
    )


def batch_status_label(status: Column, done: Column, total: Column) -> Column:
    """Display label of a batch status; unknown ones are shown as they are."""
    return (
        F.when(status == "processing", F.format_string("Processing (%d/%d)", done, total))
        .when(status.isin("queued", "completed", "failed", "cancelled"), F.initcap(status))
        .otherwise(status)
    )
