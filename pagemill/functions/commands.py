"""Rule-based reading of chat commands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import strip

# The command grammar, in order of precedence.
DIRECTORY = r"parse (the )?(whole |entire )?(directory|batch|all files)"
DOCUMENT = r"parse (the )?(whole |entire )?(document|file|pdf)"
PAGE = r"parse page (\d+)"
RANGE = r"parse pages? (\d+)[-\s]?(?:to|through)?\s?(\d+)"
FORMAT = r"(?:show|output|format) (?:as |in )?(\w+)"
STATUS = r"(check |get |show )?(status|progress)"
RESULTS = r"(get|show|display) (the )?results?"
CANCEL = r"cancel|stop"
FORMATS = ("markdown", "text", "json")
SUGGESTIONS = (
    "Parse the whole document",
    "Parse page 5",
    "Parse pages 1 to 10",
    "Parse the whole directory",
    "Parse directory",
    "Show as JSON",
    "Show as markdown",
    "Show as text",
    "Check status",
    "Get results",
)


def command_type(text: Column) -> Column:
    """Class of a chat command; the first rule that matches wins."""
    t = F.lower(strip(text))
    return (
        F.when(t.rlike(DIRECTORY), "parse_directory")
        .when(t.rlike(DOCUMENT), "parse_all")
        .when(t.rlike(PAGE), "parse_page")
        .when(t.rlike(RANGE), "parse_range")
        .when(F.regexp_extract(t, FORMAT, 1).isin(*FORMATS), "change_format")
        .when(t.rlike(STATUS), "check_status")
        .when(t.rlike(RESULTS), "get_results")
        .when(t.rlike(CANCEL), "cancel")
        .otherwise("unknown")
    )


def parse_command(text: Column) -> Column:
    """Struct of type, page_number, start_page, end_page and format."""
    t = F.lower(strip(text))
    kind = command_type(text)

    def number(pattern: str, group: int) -> Column:
        return F.regexp_extract(t, pattern, group).try_cast("bigint")

    return F.struct(
        kind.alias("type"),
        F.when(kind == "parse_page", number(PAGE, 1)).alias("page_number"),
        F.when(kind == "parse_range", number(RANGE, 1)).alias("start_page"),
        F.when(kind == "parse_range", number(RANGE, 2)).alias("end_page"),
        F.when(kind == "change_format", F.regexp_extract(t, FORMAT, 1)).alias("format"),
    )


def command_error(command: Column) -> Column:
    """Why a parsed command cannot run; null when it can."""
    kind = command["type"]
    page, start, end = command["page_number"], command["start_page"], command["end_page"]
    bad_page = page.isNull() | (page < 1)
    bad_range = start.isNull() | end.isNull() | (start < 1) | (end < 1)
    return (
        F.when((kind == "parse_page") & bad_page, "Page number must be a positive integer")
        .when((kind == "parse_range") & bad_range, "Page numbers must be positive integers")
        .when(
            (kind == "parse_range") & (start > end), "Start page must be less than or equal to end page"
        )
        .when(
            (kind == "change_format") & ~command["format"].isin(*FORMATS),
            "Format must be one of: markdown, text, json",
        )
    )


def suggestions(text: Column) -> Column:
    """Suggestions that contain the typed text, ignoring case; all for empty input."""
    typed = F.lower(strip(text))
    every = F.array(*[F.lit(s) for s in SUGGESTIONS])
    return F.filter(every, lambda s: F.contains(F.lower(s), typed))
