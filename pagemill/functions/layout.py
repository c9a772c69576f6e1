"""Geometry and layout rules for pages, images and text blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import strip

# Fixed values; X8 is the two ladders of scales and resolutions, consumed by the retry scorer.
DPI_STEPS = (300, 200, 150, 100, 72)
SCALE_STEPS = (1.0, 0.75, 0.5, 0.35, 0.25)
RESOLUTION_STEPS = (1024, 768, 512)
MAX_LINE_NUMBER = 25
IMAGE_MODES = ("RGB", "RGBA", "L", "P")


def block_type(x0: Column, y0: Column, y1: Column, text: Column, font_size: Column) -> Column:
    """line_number, header, qa_marker, footer or body; the first rule that holds wins."""
    bare = strip(text)
    is_number = (x0 < 50) & (F.length(bare) < 4) & bare.rlike("^[0-9]+$")
    in_range = bare.try_cast("int").between(1, MAX_LINE_NUMBER)
    is_marker = bare.isin("Q", "A") | text.startswith("Q   ") | text.startswith("A   ")
    return (
        F.when(is_number & in_range, F.lit("line_number"))
        .when((y0 < 100) & (font_size > 14), F.lit("header"))
        .when(is_marker, F.lit("qa_marker"))
        .when(y1 > 700, F.lit("footer"))
        .otherwise(F.lit("body"))
    )


def scale_box(box: Column, page_width: Column, page_height: Column, width: Column, height: Column) -> Column:
    """A box in page points mapped to image pixels."""
    sx, sy = width / page_width, height / page_height
    return F.struct(
        (box["x0"] * sx).alias("x0"),
        (box["y0"] * sy).alias("y0"),
        (box["x1"] * sx).alias("x1"),
        (box["y1"] * sy).alias("y1"),
    )


def fit_within(width: Column, height: Column, max_side: int = 1024) -> Column:
    """Size after shrinking the longest side to ``max_side``; smaller images keep theirs."""
    ratio = F.lit(float(max_side)) / F.greatest(width, height)
    fits = F.greatest(width, height) <= max_side
    return F.struct(
        F.when(fits, width.cast("int")).otherwise((width * ratio).cast("int")).alias("width"),
        F.when(fits, height.cast("int")).otherwise((height * ratio).cast("int")).alias("height"),
    )


def resize_longest(width: Column, height: Column, max_side: int = 4096) -> Column:
    """The longest side becomes exactly ``max_side``, growing small images too."""
    wide = width > height
    side = F.lit(max_side)
    return F.struct(
        F.when(wide, side).otherwise((side / height * width).cast("int")).alias("width"),
        F.when(wide, (side / width * height).cast("int")).otherwise(side).alias("height"),
    )


def zoom(dpi: Column) -> Column:
    """Rendering zoom; pages are measured in points of 1/72 inch."""
    return dpi / 72


def dpi_ladder(start_dpi: Column, min_dpi: int = 72) -> Column:
    """Resolutions to try from ``start_dpi`` down; the minimum always comes last."""
    steps = F.array(*[F.lit(d) for d in DPI_STEPS])
    usable = F.filter(steps, lambda d: (d <= start_dpi) & (d >= min_dpi))
    return F.when(F.array_contains(usable, min_dpi), usable).otherwise(F.array_append(usable, F.lit(min_dpi)))


def aspect_ratio(width: Column, height: Column) -> Column:
    """Width over height with two decimals."""
    return F.bround(width / height, 2)


def in_reading_order(blocks: Column, reading_order: Column) -> Column:
    """Blocks picked by the stored 0-based order."""
    return F.transform(reading_order, lambda i: F.get(blocks, i))
