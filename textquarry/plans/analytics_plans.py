"""Reports over documents, chunks and runs."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from textquarry.functions import numbers as N
from textquarry.operators import analytics as A
from textquarry.plans import PlanSet
from textquarry.plans import base as B
from textquarry.plans.base import exact_sql, js_sql, sql

plans = PlanSet()
WEEKS = (B.NOW - timedelta(days=30), B.NOW)
_IN = "created_at BETWEEN TIMESTAMP '2024-01-11 12:00:00' AND TIMESTAMP '2024-02-10 12:00:00'"
_mean = lambda c: f"{js_sql(f'coalesce(avg({c}), 0)')} AS avg_{c}"
_pct = lambda a, b: f"CASE WHEN {b} > 0 THEN {js_sql(f'CAST({a} AS DOUBLE) / {b} * 100')} ELSE 0 END"


@plans.add(
    "a1_a2_a4_overview",
    sql("dcm", f"""SELECT * FROM (SELECT count(*) FILTER (status = 'COMPLETED') AS total_documents,
    {exact_sql("CAST(count(*) FILTER (status = 'COMPLETED') AS DOUBLE) / count(*) FILTER (status IN ('COMPLETED', 'FAILED')) * 100", 2, False)} AS success_rate FROM d WHERE {_IN}),
    (SELECT count(*) FILTER ({_IN}) AS total_chunks, count(*) FILTER (sync_status = 'PENDING') AS sync_pending, count(*) FILTER (sync_status = 'SYNCED') AS sync_synced, count(*) FILTER (sync_status = 'FAILED') AS sync_failed FROM c),
    (SELECT {_mean('total_time_ms')}, {_mean('queue_time_ms')}, {_mean('user_wait_time_ms')}, {exact_sql('coalesce(avg(avg_quality_score), 0)', 3, False)} AS avg_quality_score, coalesce(sum(total_tokens), 0)::BIGINT AS total_tokens FROM m WHERE {_IN})"""),
)
def a1_a2_a4_overview(spark, d):
    return A.overview(B.documents(spark, d), B.chunks(spark, d), B.metrics(spark, d), WEEKS)


@plans.add("a3_format_counts", sql("d", f"SELECT format, count(*) AS n FROM d WHERE {_IN} GROUP BY 1"))
def a3_format_counts(spark, d):
    return A.format_counts(B.documents(spark, d), WEEKS)


@plans.add("a4_sync_counts", sql("c", "SELECT s AS sync_status, count(id) AS n FROM (VALUES ('PENDING'), ('SYNCED'), ('FAILED')) v(s) LEFT JOIN c ON sync_status = s GROUP BY 1"))
def a4_sync_counts(spark, d):
    return A.sync_counts(B.chunks(spark, d))


@plans.add("a5_a6_a7_processing", sql("dm", f"""SELECT count(*) AS documents_processed, {_pct('count(*) FILTER (ocr_applied)', 'count(*)')} AS ocr_usage_percent,
    CASE WHEN sum(page_count) > 0 THEN {js_sql('sum(conversion_time_ms)::DOUBLE / sum(page_count)')} ELSE 0 END AS avg_conversion_time_per_page, {', '.join(map(_mean, A.STAGES))}
    FROM m WHERE {_IN} AND document_id IN (SELECT id FROM d WHERE format = 'pdf')"""))
def a5_a6_a7_processing(spark, d):
    return A.processing(B.metrics(spark, d), B.documents(spark, d), WEEKS, "pdf")


@plans.add("a5_processing_of_nothing", "SELECT 0::BIGINT AS documents_processed, 0::BIGINT AS ocr_usage_percent, 0::BIGINT AS avg_conversion_time_per_page, " + ", ".join(f"0::BIGINT AS avg_{c}" for c in A.STAGES))
def a5_processing_of_nothing(spark, d):
    return A.processing(B.metrics(spark, d), B.documents(spark, d), WEEKS, "pptx")


@plans.add("a8_run_trends", sql("dm", f"SELECT strftime(date_trunc('day', m.created_at), '%Y-%m-%d %H:%M:%S') AS date, count(*) AS n, {_mean('total_time_ms')}, {_mean('queue_time_ms')} FROM m JOIN d ON document_id = id WHERE m.{_IN} AND format = 'pdf' GROUP BY 1"))
def a8_run_trends(spark, d):
    return A.trends(B.metrics(spark, d), B.documents(spark, d), WEEKS, "day", "pdf").withColumn("date", B.show("date"))


_flag = lambda f: f"(SELECT coalesce(sum(coalesce(quality_flags['{f}'], 0)), 0) FROM m WHERE {_IN})"
_chunks = f"(SELECT sum(total_chunks) FROM m WHERE {_IN})"


@plans.add(
    "a9_a13_quality",
    sql("cm", f"""SELECT count(quality_score) AS total_chunks, {exact_sql('coalesce(avg(quality_score), 0)', 3, False)} AS avg_quality_score, count(*) FILTER (quality_score >= 0.85) AS excellent,
    count(*) FILTER (quality_score >= 0.7 AND quality_score < 0.85) AS good, count(*) FILTER (quality_score < 0.7) AS low, {_pct('count(*) FILTER (len(breadcrumbs) > 0)', 'count(*)')} AS context_injection_rate,
    {_pct(_flag('FRAGMENT'), _chunks)} AS fragment_rate, {_pct(_flag('NO_CONTEXT'), _chunks)} AS no_context_rate, {_pct(_flag('TOO_SHORT'), _chunks)} AS too_short_rate,
    {js_sql(f'(SELECT sum(total_tokens)::DOUBLE / sum(total_chunks) FROM m WHERE {_IN})')} AS avg_tokens_per_chunk FROM c WHERE {_IN}"""),
)
def a9_a13_quality(spark, d):
    return A.quality(B.chunks(spark, d), B.metrics(spark, d), WEEKS)


@plans.add("a10_flag_counts", sql("m", f"SELECT flag, sum(quality_flags[flag])::BIGINT AS n FROM m, LATERAL unnest(map_keys(quality_flags)) u(flag) WHERE {_IN} GROUP BY 1"))
def a10_flag_counts(spark, d):
    return A.flag_counts(B.metrics(spark, d), WEEKS)


@plans.add("a14_chunk_metrics", sql("c", "SELECT document_id, count(*) AS total_chunks, round(avg(length(content)), 6) AS avg_chunk_size, count(*) FILTER (length(content) > 1500) AS oversized_chunks FROM c GROUP BY 1"))
def a14_chunk_metrics(spark, d):
    return A.chunk_metrics(B.chunks(spark, d)).withColumn("avg_chunk_size", F.round("avg_chunk_size", 6))


@plans.add(
    "a15_quality_summary",
    sql("c", """, x AS (SELECT document_id, unnest(quality_flags) AS flag FROM c), y AS (SELECT document_id, flag, count(*) AS n FROM x GROUP BY 1, 2),
    z AS (SELECT document_id, string_agg(concat(flag, '=', n), ',' ORDER BY flag) AS flags FROM y GROUP BY 1)
    SELECT c.document_id, round(coalesce(avg(quality_score), 0), 6) AS avg_quality_score, coalesce(sum(token_count), 0)::BIGINT AS total_tokens, coalesce(any_value(flags), '') AS flags FROM c LEFT JOIN z USING (document_id) GROUP BY 1"""),
)
def a15_quality_summary(spark, d):
    shown = F.array_join(F.transform(F.map_entries("quality_flags"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return A.quality_summary(B.chunks(spark, d)).select("document_id", F.round("avg_quality_score", 6).alias("avg_quality_score"), "total_tokens", shown.alias("flags"))


@plans.add("a16_stage_times", sql("m", "SELECT document_id, greatest(0, CAST(trunc(queue_time_ms / 3.0) AS BIGINT) - embedding_time_ms) AS chunking_time_ms, conversion_time_ms + greatest(0, CAST(trunc(queue_time_ms / 3.0) AS BIGINT) - embedding_time_ms) + embedding_time_ms AS total_time_ms FROM m"))
def a16_stage_times(spark, d):
    rows = B.metrics(spark, d).withColumn("pipeline_time_ms", F.col("queue_time_ms") / 3.0)
    return A.stage_times(rows).select("document_id", "chunking_time_ms", "total_time_ms")


@plans.add("a18_status_counts", sql("d", "SELECT " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s.lower()}" for s in ("PENDING", "PROCESSING", "COMPLETED", "FAILED")) + ", count(*) FILTER (is_active) AS active, count(*) FILTER (NOT is_active) AS inactive FROM d"))
def a18_status_counts(spark, d):
    return A.status_counts(B.documents(spark, d))


@plans.add(
    "a20_dashboard",
    sql("dcm", f""", f AS (SELECT format, count(*) AS n FROM d WHERE {_IN} GROUP BY 1)
    SELECT (SELECT format FROM f ORDER BY n DESC, format DESC LIMIT 1) AS top_format, CAST({exact_sql(f"(SELECT max(n) FROM f)::DOUBLE / (SELECT count(*) FROM d WHERE status = 'COMPLETED' AND {_IN}) * 100", 0, False)} AS BIGINT) AS top_format_percent,
    {js_sql(f"(SELECT floor(avg(chunking_time_ms) + 0.5) * count(*) FROM m WHERE {_IN}) / (SELECT count(quality_score) FROM c WHERE {_IN})")} AS avg_chunking_time_per_chunk"""),
)
def a20_dashboard(spark, d):
    return A.dashboard(B.documents(spark, d), B.chunks(spark, d), B.metrics(spark, d), WEEKS)


@plans.add("k8_exposition", sql("d", "SELECT concat('documents_total{status=\"', status, '\",format=\"', format, '\"} ', count(*)) AS line FROM d GROUP BY status, format"))
def k8_exposition(spark, d):
    return A.exposition(B.documents(spark, d), "documents_total", ["status", "format"])


_X = "(doc_id * 7919 % 100000) / 1000.0"


@plans.add("r1_r4_rounding", f"""SELECT doc_id, {exact_sql(f'CAST({_X} AS DOUBLE)', 2, True)} AS python, {exact_sql(f'CAST({_X} AS DOUBLE)', 2, False)} AS fixed, {js_sql(f'CAST({_X} AS DOUBLE) * 10')} AS js,
    CAST(ceil(doc_id / 20.0) AS BIGINT) AS pages FROM documents""")
def r1_r4_rounding(spark, d):
    x = F.expr("CAST(doc_id * 7919 % 100000 AS DOUBLE) / 1000.0D")
    return B.table(spark, d, "documents").select("doc_id", N.round_python(x).alias("python"), N.to_fixed(x).alias("fixed"), N.round_js(x * 10).alias("js"), N.pages(F.col("doc_id"), 20).alias("pages"))


@plans.add("d1_d3_times", sql("dm", f"SELECT id, concat(strftime(d.created_at, '%Y-%m-%dT%H:%M:%S'), '.000Z') AS iso, greatest(0, date_diff('millisecond', d.created_at, TIMESTAMP '2024-01-20 00:00:00')) AS elapsed, {B.text_of('d.created_at - INTERVAL 7 DAY')} AS week_before FROM d"))
def d1_d3_times(spark, d):
    t = F.col("created_at")
    return B.documents(spark, d).select("id", N.iso(t).alias("iso"), N.elapsed_ms(t, F.lit("2024-01-20 00:00:00").cast("timestamp")).alias("elapsed"), F.date_format(t - F.expr("INTERVAL 7 DAY"), "yyyy-MM-dd HH:mm:ss").alias("week_before"))
