"""File names, extensions, MIME types and expiry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ALLOWED_MIME_TYPES = (
    "application/pdf",
    "image/png",
    "image/jpeg",
    "image/jpg",
    "image/tiff",
    "image/bmp",
)
ALLOWED_EXTENSIONS = (".jpg", ".jpeg", ".png", ".pdf", ".tiff", ".tif")
MIME_BY_EXTENSION = {
    ".pdf": "application/pdf",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".tiff": "image/tiff",
    ".tif": "image/tiff",
    ".bmp": "image/bmp",
    ".gif": "image/gif",
    ".txt": "text/plain",
    ".md": "text/markdown",
    ".json": "application/json",
    ".html": "text/html",
    ".zip": "application/zip",
}
# Types under which an original upload is handed back.
ORIGINAL_TYPES = {
    ".pdf": "application/pdf",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".tiff": "image/tiff",
    ".tif": "image/tiff",
}
FORMAT_MEDIA_TYPES = {"markdown": "text/markdown", "text": "text/plain", "json": "application/json"}
FORMAT_EXTENSIONS = {"text": ".txt", "markdown": ".md", "json": ".json"}
DEFAULT_MIME = "application/octet-stream"


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(v) for kv in table.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def extension(path: Column) -> Column:
    """Lower-case suffix of the last path part with its dot; empty when there is none."""
    return F.lower(F.regexp_extract(path, r"[^/.](\.[^./]+)$", 1))


def file_stem(path: Column) -> Column:
    """Last path part without its suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def guess_mime(path: Column) -> Column:
    """MIME type by extension; null when unknown."""
    return _lookup(MIME_BY_EXTENSION, extension(path))


def effective_mime(content_type: Column, path: Column) -> Column:
    """The stated type, else the guessed one, else the generic one."""
    stated = F.when(content_type != "", content_type)
    return F.coalesce(stated, guess_mime(path), F.lit(DEFAULT_MIME))


def original_media_type(path: Column) -> Column:
    """X11: media type under which the original file is returned."""
    return F.coalesce(_lookup(ORIGINAL_TYPES, extension(path)), F.lit(DEFAULT_MIME))


def format_media_type(output_format: Column) -> Column:
    """X11: media type of a result in ``output_format``."""
    return F.coalesce(_lookup(FORMAT_MEDIA_TYPES, output_format), F.lit("text/plain"))


def download_name(path: Column, output_format: Column) -> Column:
    """X11: the stem of the input with the output format as suffix."""
    return F.concat(file_stem(path), F.lit("."), output_format)


def format_of_path(path: Column) -> Column:
    """Output format implied by the extension; text unless .md or .json."""
    ext = extension(path)
    return F.when(ext == ".md", "markdown").when(ext == ".json", "json").otherwise("text")


def format_mismatch(output_format: Column, path: Column) -> Column:
    """Error text when the stated format and the extension disagree, else null."""
    expected = F.coalesce(_lookup(FORMAT_EXTENSIONS, output_format), F.lit(".txt"))
    message = F.format_string(
        "Format '%s' conflicts with output extension '%s'. Expected extension '%s' for format '%s'.",
        output_format,
        extension(path),
        expected,
        output_format,
    )
    return F.when(output_format != format_of_path(path), message)


def expires_at(uploaded_at: Column, hours: int = 6) -> Column:
    """Upload time plus the retention."""
    return uploaded_at + F.expr(f"INTERVAL {int(hours)} HOURS")


def is_expired(expiry: Column, now: Column) -> Column:
    """Strictly past the expiry; a null expiry never passes."""
    return F.coalesce(now > expiry, F.lit(False))
