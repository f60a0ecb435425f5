"""Lists and details of documents, chunks, runs and profiles: filters, order, one page, and totals beside it.

Filters reach the scan as plain predicates. A page is taken in a total order before anything is joined to it, so what is joined and nested is a
page's worth of keys.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.numbers import iso, pages
from textquarry.operators.analytics import Period, within
from textquarry.operators.quality import in_band
from textquarry.operators.relational import any_of, contains_ci, equal_filters, nested, non_empty, ordered, page, with_child_count

#: What lists may be sorted by.
DOCUMENT_SORTS = ("created_at", "filename", "file_size")
CHUNK_SORTS = {"tokenCount": "token_count", "qualityScore": "quality_score"}
METRIC_SORTS = ("total_time_ms", "avg_quality_score", "created_at")


@dataclass(frozen=True)
class DocumentFilter:
    status: str | None = None
    is_active: bool | None = None
    connection_state: str | None = None
    source_type: str | None = None
    search: str | None = None


def filter_documents(documents: DataFrame, f: DocumentFilter) -> DataFrame:
    out = equal_filters(documents, **{x.name: getattr(f, x.name) for x in fields(f) if x.name != "search"})
    if f.search is not None:
        if len(f.search) > 100:
            raise ValueError("search has at most 100 characters")
        out = out.where(contains_ci(F.col("filename"), f.search))
    return out


def list_documents(documents: DataFrame, chunks: DataFrame, f: DocumentFilter = DocumentFilter(), sort: str = "created_at", descending: bool = True, limit: int = 20, offset: int = 0) -> DataFrame:
    """One page of documents with their number of chunks (null for none)."""
    if sort not in DOCUMENT_SORTS:
        raise ValueError(f"sort is one of {DOCUMENT_SORTS}")
    rows = page(filter_documents(documents, f), [ordered(sort, descending), F.col("id")], limit, offset)
    few = chunks.join(F.broadcast(rows.select(F.col("id").alias("document_id"))), "document_id", "left_semi")  # a page of keys
    out = with_child_count(rows, few, "id", "document_id", "n")
    done = F.col("status") == "COMPLETED"
    return out.select("id", "filename", "status", "file_size", "source_type", "is_active", "connection_state", F.nullif("n", F.lit(0)).alias("chunk_count"), iso(F.col("created_at")).alias("created_at"), done.alias("has_processed_content"))


def totals(df: DataFrame, limit: int) -> DataFrame:
    """(total, total_pages) of a filtered list."""
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn("total_pages", pages(F.col("total"), limit))


def status_of(documents: DataFrame, chunks: DataFrame, key) -> DataFrame:
    """A document's state; its number of chunks only once it is completed."""
    row = documents.where(F.col("id") == F.lit(key))
    n = chunks.where(F.col("document_id") == F.lit(key)).agg(F.count(F.lit(1)).alias("n"))
    return row.join(F.broadcast(n)).select("id", "filename", "status", "fail_reason", F.when(F.col("status") == "COMPLETED", F.col("n")).alias("chunk_count"))


def availability_error(status: Column, content: Column) -> Column:
    """Why a document can't be exported: not there, not ready, no content; else null."""
    return F.when(status.isNull(), "NOT_FOUND").when(status != "COMPLETED", "NOT_READY").when(F.coalesce(content, F.lit("")) == "", "NO_CONTENT")


def export_json(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, error, json): each document with its chunks in order, or why there is none."""
    shown = ("id", "content", "index", "qualityScore", "qualityFlags", "chunkType", "breadcrumbs", "tokenCount")
    named = chunks.select("document_id", *[F.col(c).alias(n) for c, n in zip(("id", "content", "chunk_index", "quality_score", "quality_flags", "chunk_type", "breadcrumbs", "token_count"), shown, strict=True)])
    ready = documents.where(availability_error(F.col("status"), F.col("processed_content")).isNull())
    full = nested(ready.select("id", "filename", "format", F.col("processed_content").alias("processedContent")), named, "id", "document_id", "index", "chunks")
    body = F.to_json(F.struct("id", "filename", "format", "processedContent", "chunks"), {"ignoreNullFields": "false"})
    error = availability_error(F.col("status"), F.col("processed_content"))
    return documents.select("id", error.alias("error")).join(full.select("id", body.alias("json")), "id", "left")


def export_markdown(documents: DataFrame) -> DataFrame:
    """(id, error, name, markdown) of each document."""
    error = availability_error(F.col("status"), F.col("processed_content"))
    return documents.select("id", error.alias("error"), F.concat("filename", F.lit(".md")).alias("name"), F.when(error.isNull(), F.col("processed_content")).alias("markdown"))


@dataclass(frozen=True)
class ChunkFilter:
    document_id: int | str | None = None
    quality: str | None = None
    chunk_type: str | None = None
    flags: str | None = None
    search: str | None = None
    context: bool | None = None


def filter_chunks(chunks: DataFrame, f: ChunkFilter) -> DataFrame:
    """``flags``: any of those named, parted by commas; ``context``: whether there are breadcrumbs."""
    out = equal_filters(chunks, document_id=f.document_id, chunk_type=f.chunk_type)
    if f.quality is not None:
        out = out.where(in_band(F.col("quality_score"), f.quality))
    if f.flags is not None:
        out = out.where(any_of(F.col("quality_flags"), f.flags.split(",")))
    if f.search is not None:
        out = out.where(contains_ci(F.col("content"), f.search))
    if f.context is not None:
        out = out.where(non_empty(F.col("breadcrumbs")) == f.context)
    return out


def list_chunks(chunks: DataFrame, documents: DataFrame, f: ChunkFilter = ChunkFilter(), sort: str | None = None, descending: bool = True, limit: int = 20, page_number: int = 1) -> DataFrame:
    """One page of chunks with their documents' names; by document and place unless a sort is given."""
    place = [F.col("document_id"), F.col("chunk_index")]
    order = [ordered(CHUNK_SORTS[sort], descending), *place] if sort else place
    rows = page(filter_chunks(chunks, f), order, limit, (page_number - 1) * limit)
    return with_document(rows, documents)


def with_document(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with the name, format and category of their document; those without one are left out."""
    d = documents.select(F.col("id").alias("document_id"), "filename", "format", "format_category")
    return chunks.join(d, "document_id")


def chunk_detail(chunks: DataFrame, documents: DataFrame, key) -> DataFrame:
    """One chunk with all it has and its document, or no row."""
    return with_document(chunks.where(F.col("id") == F.lit(key)), documents)


def document_chunks(chunks: DataFrame, documents: DataFrame, key, limit: int = 20, page_number: int = 1) -> DataFrame:
    """One page of a document's chunks in their order, with its name; no row for an unknown document."""
    rows = page(chunks.where(F.col("document_id") == F.lit(key)), [F.col("chunk_index")], limit, (page_number - 1) * limit)
    return with_document(rows, documents)


def list_runs(metrics: DataFrame, documents: DataFrame, period: Period = None, sort: str = "created_at", descending: bool = True, limit: int = 20, page_number: int = 1) -> DataFrame:
    """One page of run metrics, each with its document."""
    if sort not in METRIC_SORTS:
        raise ValueError(f"sort is one of {METRIC_SORTS}")
    rows = page(within(metrics, period), [ordered(sort, descending), F.col("document_id")], limit, (page_number - 1) * limit)
    d = documents.select(F.col("id").alias("document_id"), "filename", "format", "file_size", "format_category", "status", F.col("created_at").alias("document_created_at"))
    return rows.join(d, "document_id")


def list_profiles(profiles: DataFrame, documents: DataFrame, archived: bool = False) -> DataFrame:
    """Profiles with their number of documents: the default one first, then active ones, then the newest; archived ones only on request."""
    rows = profiles if archived else profiles.where(~F.col("is_archived"))
    out = with_child_count(rows, documents, "id", "processing_profile_id", "document_count")
    return out.orderBy(F.desc("is_default"), F.desc("is_active"), F.desc("created_at"), "id")


def folders_with_profiles(folders: DataFrame, profiles: DataFrame) -> DataFrame:
    """Folders with their profile's name; null where they have none."""
    p = profiles.select(F.col("id").alias("processing_profile_id"), F.col("name").alias("profile_name"))
    return folders.join(p, "processing_profile_id", "left")
