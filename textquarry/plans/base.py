"""Tables of the kind the operators work on, derived from the driver's tables: made dirty, null and skewed on purpose where those are clean.

Each is a list of (name, expression) that Spark and DuckDB both read; where they differ the expression is a pair. ``sql(...)`` gives the same
tables as common table expressions.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = datetime(2024, 2, 10, 12, 0, 0)


def _hours(expression: str, start: str = "2024-01-01 00:00:00") -> tuple[str, str]:
    return f"timestampadd(HOUR, CAST({expression} AS INT), TIMESTAMP '{start}')", f"TIMESTAMP '{start}' + to_hours(CAST({expression} AS INT))"


DOCUMENTS = [
    ("id", "doc_id"),
    ("filename", "concat('File_', doc_id % 97, CASE doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.HTML' WHEN 2 THEN '.csv' ELSE '.md' END)"),
    ("format", "CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'html' WHEN 2 THEN 'csv' ELSE 'md' END"),
    ("format_category", "CASE doc_id % 4 WHEN 2 THEN 'tabular' ELSE 'document' END"),
    ("status", "CASE WHEN doc_id % 10 < 6 THEN 'COMPLETED' WHEN doc_id % 10 < 8 THEN 'FAILED' WHEN doc_id % 10 = 8 THEN 'PROCESSING' ELSE 'PENDING' END"),
    ("fail_reason", "CASE doc_id % 10 WHEN 6 THEN 'REMOVED_FROM_DRIVE' WHEN 7 THEN 'TEXT_TOO_SHORT' END"),
    ("retry_count", "CAST(doc_id % 4 AS INT)"),
    ("source_type", "CASE doc_id % 3 WHEN 0 THEN 'DRIVE' ELSE 'MANUAL' END"),
    ("connection_state", "CASE doc_id % 6 WHEN 0 THEN 'LINKED' ELSE 'STANDALONE' END"),
    ("is_active", "doc_id % 7 <> 0"),
    ("file_size", "CASE WHEN doc_id % 13 = 0 THEN NULL ELSE n_chars END"),
    ("processed_content", "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE text END"),
    ("md5_hash", "md5(text)"),
    ("drive_file_id", "CASE doc_id % 3 WHEN 0 THEN concat('drive-', doc_id) END"),
    ("drive_folder_id", "CASE doc_id % 3 WHEN 0 THEN doc_id % 5 END"),
    ("processing_profile_id", "doc_id % 6"),
    ("created_at", _hours("doc_id * 7 % 960")),
]
CHUNKS = [
    ("id", "doc_id * 100000 + pos"),
    ("document_id", "doc_id"),
    ("chunk_index", "CAST(pos AS INT)"),
    ("content", "line"),
    ("quality_score", "CASE WHEN (doc_id + pos) % 13 = 0 THEN NULL ELSE ((doc_id * 7 + pos * 31) % 101) / 100.0D END"),
    ("quality_flags", ("CASE (doc_id + pos) % 4 WHEN 0 THEN array('TOO_SHORT', 'FRAGMENT') WHEN 1 THEN array('NO_CONTEXT') WHEN 2 THEN CAST(array() AS array<string>) ELSE array('FRAGMENT') END",
                       "CASE (doc_id + pos) % 4 WHEN 0 THEN ['TOO_SHORT', 'FRAGMENT'] WHEN 1 THEN ['NO_CONTEXT'] WHEN 2 THEN []::VARCHAR[] ELSE ['FRAGMENT'] END")),
    ("chunk_type", "CASE doc_id % 4 WHEN 2 THEN 'tabular' ELSE 'document' END"),
    ("breadcrumbs", ("CASE WHEN pos % 3 = 0 THEN array('Top', concat('S', pos)) WHEN pos % 3 = 1 THEN CAST(array() AS array<string>) END", "CASE WHEN pos % 3 = 0 THEN ['Top', concat('S', pos)] WHEN pos % 3 = 1 THEN []::VARCHAR[] END")),
    ("token_count", "CASE WHEN pos % 5 = 4 THEN NULL ELSE CAST(floor(length(line) / 4) AS INT) END"),
    ("sync_status", "CASE (doc_id + pos) % 5 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'PENDING' WHEN 2 THEN 'OTHER' ELSE 'SYNCED' END"),
    ("created_at", _hours("(doc_id * 7 + pos) % 960")),
]
METRICS = [
    ("document_id", "CASE WHEN doc_id % 29 = 0 THEN -doc_id ELSE doc_id END"),
    ("page_count", "CAST(doc_id % 9 AS INT)"),
    ("ocr_applied", "doc_id % 5 = 0"),
    ("queue_time_ms", "doc_id * 37 % 4999"),
    ("conversion_time_ms", "doc_id * 53 % 3001"),
    ("chunking_time_ms", "doc_id * 11 % 701"),
    ("embedding_time_ms", "doc_id * 17 % 1301"),
    ("total_time_ms", "CASE WHEN doc_id % 17 = 0 THEN NULL ELSE doc_id * 53 % 3001 + doc_id * 11 % 701 + doc_id * 17 % 1301 END"),
    ("user_wait_time_ms", "doc_id * 37 % 4999 + 10"),
    ("total_chunks", "doc_id % 12"),
    ("total_tokens", "doc_id % 12 * 111"),
    ("avg_quality_score", "CASE WHEN doc_id % 19 = 0 THEN NULL ELSE (doc_id % 1000) / 999.0D END"),
    ("quality_flags", ("CASE doc_id % 3 WHEN 0 THEN map('FRAGMENT', doc_id % 4, 'TOO_SHORT', 1L) WHEN 1 THEN map('NO_CONTEXT', doc_id % 5) END", "CASE doc_id % 3 WHEN 0 THEN MAP {'FRAGMENT': doc_id % 4, 'TOO_SHORT': 1::BIGINT} WHEN 1 THEN MAP {'NO_CONTEXT': doc_id % 5} END")),
    ("created_at", _hours("doc_id * 7 % 960")),
]
PROFILES = [
    ("id", "CAST(n_nationkey AS BIGINT)"),
    ("name", "CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN concat(n_name, ' v2') ELSE concat(n_name, ' v19') END"),
    ("is_default", "n_nationkey = 0"),
    ("is_active", "n_nationkey = 1"),
    ("is_archived", "n_nationkey % 5 = 4"),
    ("created_at", _hours("n_nationkey * 13 % 24")),
]
FOLDERS = [
    ("id", "CAST(r_regionkey AS BIGINT)"),
    ("folder_name", "r_name"),
    ("processing_profile_id", "CASE WHEN r_regionkey = 3 THEN NULL ELSE CAST(r_regionkey * 2 AS BIGINT) END"),
    ("sync_status", "CASE r_regionkey WHEN 1 THEN 'ERROR' ELSE 'IDLE' END"),
    ("sync_error", "CASE r_regionkey WHEN 1 THEN 'lost' END"),
    ("last_synced_at", _hours("r_regionkey")),
]


def _select(columns, i: int) -> list[str]:
    return [f"{e if isinstance(e, str) else e[i]} AS {n}" for n, e in columns]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark, d) -> DataFrame:
    return table(spark, d, "documents").selectExpr(*_select(DOCUMENTS, 0))


def chunks(spark, d) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.selectExpr(*_select(CHUNKS, 0))


def metrics(spark, d) -> DataFrame:
    return table(spark, d, "documents").selectExpr(*_select(METRICS, 0))


def profiles(spark, d) -> DataFrame:
    return table(spark, d, "nation").selectExpr(*_select(PROFILES, 0))


def folders(spark, d) -> DataFrame:
    return table(spark, d, "region").selectExpr(*_select(FOLDERS, 0))


def _duck(columns, source: str) -> str:
    return f"(SELECT {', '.join(_select(columns, 1))} FROM {source})".replace("0D ", "0::DOUBLE ")


_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"
SQL = {"d": _duck(DOCUMENTS, "documents"), "c": _duck(CHUNKS, _LINES), "m": _duck(METRICS, "documents"), "p": _duck(PROFILES, "nation"), "f": _duck(FOLDERS, "region")}


def sql(tables: str, query: str) -> str:
    """``query`` with the tables it names by letter: d documents, c chunks, m metrics, p profiles, f folders."""
    return "WITH " + ", ".join(f"{t} AS {SQL[t]}" for t in tables) + " " + query


def text_of(name: str) -> str:
    """A timestamp as text, the same in both engines."""
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S')"


def show(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss")


def placed(c: Column, before: str, gap: str, after: str = "") -> Column:
    """What an operator made of a text, with the place of an empty one: ``gap`` between what comes before the text and after it (patterns), where
    nothing else is. Operators leave empty paragraphs and blanks at a line's end out, as they should; the SQL counts them."""
    return F.regexp_replace(c, rf"\A({before})(?={after}\z)", f"$1{gap}")


# rounding by exact binary value, said in SQL: the product with the scale in two exact halves, and where its middle lies
_SPLIT = "(({x}) * 134217729::DOUBLE - (({x}) * 134217729::DOUBLE - ({x})))"


def exact_sql(x: str, digits: int, even: bool) -> str:
    s = f"{10**digits}::DOUBLE"
    n = f"round_even(({x}) * {s}, 0)"
    hi = _SPLIT.format(x=x)
    off = f"(({hi} * {s} - {n}) + (({x}) - {hi}) * {s})"
    up = f"CASE WHEN {n} % 2 = 0 THEN {n} ELSE {n} + 1 END" if even else f"{n} + 1"
    down = f"CASE WHEN {n} % 2 = 0 THEN {n} ELSE {n} - 1 END" if even else n
    return f"(CASE WHEN {off} > 0.5 THEN {n} + 1 WHEN {off} = 0.5 THEN {up} WHEN {off} < -0.5 THEN {n} - 1 WHEN {off} = -0.5 THEN {down} ELSE {n} END / {s})"


def js_sql(x: str) -> str:
    return f"CAST(floor(({x}) + 0.5) AS BIGINT)"
