"""Formats, upload checks and routing, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Media types and endings of the ten formats.
MIME = {
    "application/pdf": "pdf",
    "application/json": "json",
    "text/plain": "txt",
    "text/markdown": "md",
    "text/csv": "csv",
    "text/html": "html",
    "application/epub+zip": "epub",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
}
ENDINGS = {x: x for x in ("pdf", "json", "txt", "md", "csv", "html", "epub", "docx", "xlsx", "pptx")} | {"htm": "html"}
CATEGORY = {"pptx": "presentation", "csv": "tabular", "xlsx": "tabular"}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def detect_format(mime: Column, filename: Column) -> Column:
    """By media type, else by the last ending; null if neither is known."""
    ending = F.lower(F.element_at(F.split(filename, r"\."), -1))
    return F.coalesce(_lookup(MIME, mime), _lookup(ENDINGS, ending))


def category(fmt: Column) -> Column:
    return F.coalesce(_lookup(CATEGORY, F.lower(fmt)), F.lit("document"))


def name_error(filename: Column) -> Column:
    """INVALID_FILENAME for a name that is missing, empty, longer than 255 characters or holds a path; else null."""
    base = F.element_at(F.split(filename, "/"), -1)
    good = (base == filename) & F.length(filename).between(1, 255)
    return F.when(~F.coalesce(good, F.lit(False)), "INVALID_FILENAME")


def upload_error(size: Column, mime: Column, filename: Column, max_mb: int = 50) -> Column:
    """FILE_TOO_LARGE, else INVALID_FORMAT, else what name_error says, else null. Both lists are looked at: a known ending makes up for an
    unknown media type, and the other way round."""
    return F.when(size > max_mb * 1024 * 1024, "FILE_TOO_LARGE").when(detect_format(mime, filename).isNull(), "INVALID_FORMAT").otherwise(name_error(filename))


def ocr_applied(mode: Column, chars: Column, pages: Column) -> Column:
    """Whether text was recognised: always if forced, and in auto mode where a page has under 50 characters."""
    return (mode == "force") | ((mode == "auto") & (chars / F.greatest(F.lit(1), F.coalesce(pages, F.lit(0))) < 50))


def needs_password(content: Column) -> Column:
    """Whether a PDF's bytes name an encryption dictionary; false for null."""
    return F.coalesce(F.contains(content, F.lit(b"/Encrypt")), F.lit(False))


def conversion_error(markdown: Column, error: Column, chunks: Column) -> Column:
    failed = F.coalesce(F.trim(markdown), F.lit("")) == ""
    return F.when(failed & F.upper(F.coalesce(error, F.lit(""))).contains("PASSWORD"), "PASSWORD_PROTECTED").when(failed, "CORRUPT_FILE").when(chunks == 0, "INTERNAL_ERROR")


def page_count(*counts: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit(0)) for c in counts], F.lit(1))
