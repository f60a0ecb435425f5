"""Lists, details, filters, joins and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry.functions import numbers as N
from textquarry.operators import documents as D
from textquarry.operators import relational as R
from textquarry.operators.analytics import period_range, within
from textquarry.plans import PlanSet
from textquarry.plans import base as B
from textquarry.plans.base import sql, text_of

plans = PlanSet()
_ISO = "concat(strftime(created_at, '%Y-%m-%dT%H:%M:%S'), '.000Z')"
_LISTED = "status = 'COMPLETED' AND is_active AND connection_state = 'STANDALONE' AND source_type = 'MANUAL' AND contains(lower(filename), 'e_1')"


@plans.add("m3_f1_f2_o1_document_list", sql("dc", f"""SELECT id, filename, status, file_size, source_type, is_active, connection_state, nullif((SELECT count(*) FROM c WHERE document_id = x.id), 0) AS chunk_count,
    {_ISO} AS created_at, status = 'COMPLETED' AS has_processed_content FROM (SELECT * FROM d WHERE {_LISTED} ORDER BY file_size DESC NULLS FIRST, id LIMIT 15 OFFSET 5) x"""), text=("file_size", "chunk_count",))
def m3_f1_f2_o1_document_list(spark, d):
    f = D.DocumentFilter(status="COMPLETED", is_active=True, connection_state="STANDALONE", source_type="MANUAL", search="E_1")
    return D.list_documents(B.documents(spark, d), B.chunks(spark, d), f, "file_size", True, 15, 5)


@plans.add("a19_r4_list_totals", sql("d", f"SELECT count(*) AS total, CAST(ceil(count(*) / 15.0) AS BIGINT) AS total_pages FROM d WHERE {_LISTED}"))
def a19_r4_list_totals(spark, d):
    f = D.DocumentFilter(status="COMPLETED", is_active=True, connection_state="STANDALONE", source_type="MANUAL", search="E_1")
    return D.totals(D.filter_documents(B.documents(spark, d), f), 15)


@plans.add("m2_f14_status", sql("dc", "SELECT id, filename, status, fail_reason, CASE WHEN status = 'COMPLETED' THEN (SELECT count(*) FROM c WHERE document_id = d.id) END AS chunk_count FROM d WHERE id IN (11, 17)"), text=("chunk_count",))
def m2_f14_status(spark, d):
    docs, chunks = B.documents(spark, d), B.chunks(spark, d)
    return D.status_of(docs, chunks, 11).unionByName(D.status_of(docs, chunks, 17))


_CHUNK = "document_id, chunk_index, id, round(quality_score, 6) AS quality_score, token_count, filename, format, format_category"
_WHERE = "quality_score >= 0.7 AND quality_score < 0.85 AND chunk_type = 'document' AND list_has_any(quality_flags, ['TOO_SHORT', 'NO_CONTEXT']) AND contains(lower(content), 'the')"


def _chunk(df):
    return df.select("document_id", "chunk_index", "id", F.round("quality_score", 6).alias("quality_score"), "token_count", "filename", "format", "format_category")


@plans.add("m9_f3_f6_o2_chunk_list", sql("cd", f"SELECT {_CHUNK} FROM (SELECT * FROM c WHERE {_WHERE} ORDER BY token_count DESC NULLS FIRST, document_id, chunk_index LIMIT 25 OFFSET 25) x JOIN (SELECT id AS i, filename, format, format_category FROM d) ON i = document_id"), text=("token_count",))
def m9_f3_f6_o2_chunk_list(spark, d):
    f = D.ChunkFilter(quality="good", chunk_type="document", flags=" TOO_SHORT, NO_CONTEXT", search="THE")
    return _chunk(D.list_chunks(B.chunks(spark, d), B.documents(spark, d), f, "tokenCount", True, 25, 2))


@plans.add("f4_f5_f9_chunk_filters", sql("c", "SELECT count(*) FILTER (quality_score >= 0.85) AS excellent, count(*) FILTER (quality_score < 0.7) AS low, count(*) FILTER (list_has_any(quality_flags, ['FRAGMENT'])) AS fragments, count(*) FILTER (len(breadcrumbs) > 0) AS with_context, count(*) FILTER (coalesce(len(breadcrumbs), 0) = 0) AS without, count(*) FILTER (quality_score IS NOT NULL) AS scored FROM c"))
def f4_f5_f9_chunk_filters(spark, d):
    c = B.chunks(spark, d)
    holds = lambda condition, name: F.count_if(condition).alias(name)
    score = F.col("quality_score")
    return c.agg(holds(D.in_band(score, "excellent"), "excellent"), holds(D.in_band(score, "low"), "low"), holds(R.any_of(F.col("quality_flags"), ["FRAGMENT "]), "fragments"),
                 holds(R.non_empty(F.col("breadcrumbs")), "with_context"), holds(~R.non_empty(F.col("breadcrumbs")), "without"), holds(score.isNotNull(), "scored"))


@plans.add("o2_chunk_order", sql("c", "SELECT id, round(quality_score, 6) AS quality_score FROM c ORDER BY quality_score ASC NULLS LAST, document_id, chunk_index LIMIT 40"))
def o2_chunk_order(spark, d):
    rows = R.page(B.chunks(spark, d), [R.ordered("quality_score", False), F.col("document_id"), F.col("chunk_index")], 40)
    return rows.select("id", F.round("quality_score", 6).alias("quality_score"))


_RUN = "document_id, total_time_ms, round(avg_quality_score, 6) AS avg_quality_score, filename, format, status"


@plans.add("m10_j2_o3_runs", sql("md", f"SELECT {_RUN} FROM (SELECT * FROM m WHERE created_at BETWEEN TIMESTAMP '2024-02-03 12:00:00' AND TIMESTAMP '2024-02-10 12:00:00' ORDER BY avg_quality_score DESC NULLS FIRST, document_id LIMIT 30) JOIN d ON id = document_id"), text=("total_time_ms",))
def m10_j2_o3_runs(spark, d):
    rows = D.list_runs(B.metrics(spark, d), B.documents(spark, d), period_range("7d", B.NOW), "avg_quality_score", True, 30)
    return rows.select("document_id", "total_time_ms", F.round("avg_quality_score", 6).alias("avg_quality_score"), "filename", "format", "status")


@plans.add("f7_d2_periods", sql("m", "SELECT p, count(document_id) AS n FROM (VALUES ('24h', TIMESTAMP '2024-02-09 12:00:00'), ('7d', TIMESTAMP '2024-02-03 12:00:00'), ('30d', TIMESTAMP '2024-01-11 12:00:00'), ('all', TIMESTAMP '2000-02-10 12:00:00')) v(p, s) LEFT JOIN m ON created_at BETWEEN s AND TIMESTAMP '2024-02-10 12:00:00' GROUP BY 1"))
def f7_d2_periods(spark, d):
    m, out = B.metrics(spark, d), None
    for name in ("24h", "7d", "30d", "all"):
        one = within(m, period_range(name, B.NOW)).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("p"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@plans.add("j3_chunk_documents", sql("cd", f"SELECT {_CHUNK} FROM c JOIN (SELECT id AS i, filename, format, format_category FROM d) ON i = document_id"), text=("token_count",))
def j3_chunk_documents(spark, d):
    return _chunk(D.with_document(B.chunks(spark, d), B.documents(spark, d)))


@plans.add("j5_ordered_chunks", sql("dc", "SELECT d.id, count(c.id) AS n, md5(coalesce(string_agg(c.content, '|' ORDER BY chunk_index DESC), '')) AS digest FROM d LEFT JOIN (SELECT * FROM c WHERE chunk_index % 3 = 1) c ON document_id = d.id GROUP BY 1"))
def j5_ordered_chunks(spark, d):
    kids = B.chunks(spark, d).where("chunk_index % 3 = 1").select("document_id", "content", (-F.col("chunk_index")).alias("place"))
    rows = R.nested(B.documents(spark, d).select("id"), kids, "id", "document_id", "place", "kids")
    return rows.select("id", F.size("kids").cast("long").alias("n"), F.md5(F.array_join(F.transform("kids", lambda x: x["content"]), "|")).alias("digest"))


@plans.add("j6_o4_f13_profiles", sql("pd", "SELECT p.id, name, is_default, is_active, (SELECT count(*) FROM d WHERE processing_profile_id = p.id) AS document_count FROM p WHERE NOT is_archived"))
def j6_o4_f13_profiles(spark, d):
    return D.list_profiles(B.profiles(spark, d), B.documents(spark, d)).select("id", "name", "is_default", "is_active", "document_count")


@plans.add("o4_profile_order", sql("p", "SELECT row_number() OVER (ORDER BY is_default DESC, is_active DESC, created_at DESC, id) AS place, id FROM p QUALIFY place <= 10"))
def o4_profile_order(spark, d):
    rows = D.list_profiles(B.profiles(spark, d), B.documents(spark, d), archived=True).limit(10)
    return rows.agg(F.collect_list("id").alias("ids")).select(F.posexplode("ids").alias("place", "id")).select((F.col("place") + 1).cast("long").alias("place"), "id")


@plans.add("j7_folder_profiles", sql("fp", "SELECT f.id, folder_name, name AS profile_name FROM f LEFT JOIN (SELECT id AS i, name FROM p) ON i = processing_profile_id"))
def j7_folder_profiles(spark, d):
    return D.folders_with_profiles(B.folders(spark, d), B.profiles(spark, d)).select("id", "folder_name", "profile_name")


@plans.add("f11_o7_o8_takes", sql("d", "SELECT 'among' AS kind, id FROM d WHERE id IN (3, 5, 8, 999999999) UNION ALL (SELECT 'batch', id FROM d WHERE status = 'PENDING' ORDER BY id LIMIT 10) UNION ALL (SELECT 'first', id FROM d WHERE is_active AND status = 'FAILED' ORDER BY created_at, id LIMIT 1) UNION ALL SELECT 'key', id FROM d WHERE id = 4"))
def f11_o7_o8_takes(spark, d):
    docs = B.documents(spark, d)
    frames = {"among": R.among(docs, "id", [3, 5, 8, 999999999]), "batch": R.batch(docs.where("status = 'PENDING'"), 10, F.col("id")), "first": R.first_match(docs, F.col("is_active") & (F.col("status") == "FAILED"), F.col("created_at"), F.col("id")), "key": R.by_key(docs, "id", 4)}
    out = None
    for kind, df in frames.items():
        one = df.select(F.lit(kind).alias("kind"), "id")
        out = one if out is None else out.unionByName(one)
    return out


_ERROR = "CASE WHEN status <> 'COMPLETED' THEN 'NOT_READY' WHEN coalesce(processed_content, '') = '' THEN 'NO_CONTENT' END"


@plans.add("k5_m4_export_json", sql("dc", f"SELECT d.id, {_ERROR} AS error, CASE WHEN {_ERROR} IS NULL THEN (SELECT count(*) FROM c WHERE document_id = d.id) END AS n, CASE WHEN {_ERROR} IS NULL THEN (SELECT md5(string_agg(concat(chunk_index, ':', content), '|' ORDER BY chunk_index)) FROM c WHERE document_id = d.id) END AS digest FROM d"), text=("n",))
def k5_m4_export_json(spark, d):
    out = D.export_json(B.documents(spark, d), B.chunks(spark, d))
    back = F.from_json("json", "chunks array<struct<content:string,index:int>>")["chunks"]
    shown = F.array_join(F.transform(back, lambda c: F.concat_ws(":", c["index"].cast("string"), c["content"])), "|")
    return out.select("id", "error", F.when(F.col("json").isNotNull(), F.size(back)).cast("long").alias("n"), F.md5(shown).alias("digest"))


@plans.add("k5_export_markdown", sql("d", f"SELECT id, {_ERROR} AS error, concat(filename, '.md') AS name, CASE WHEN {_ERROR} IS NULL THEN md5(processed_content) END AS digest FROM d"))
def k5_export_markdown(spark, d):
    return D.export_markdown(B.documents(spark, d)).select("id", "error", "name", F.md5("markdown").alias("digest"))


@plans.add("n1_version_names", sql("p", r"SELECT id, CASE WHEN regexp_matches(name, ' v\d+$') THEN concat(regexp_replace(name, ' v\d+$', ''), ' v', CAST(regexp_extract(name, ' v(\d+)$', 1) AS INT) + 1) ELSE concat(name, ' v2') END AS name FROM p"))
def n1_version_names(spark, d):
    return B.profiles(spark, d).select("id", N.next_version_column(F.col("name")).alias("name"))


@plans.add("n2_clamped_settings", "SELECT doc_id, CASE WHEN doc_id % 9 - 3 >= 1 THEN doc_id % 9 - 3 ELSE 1 END AS value FROM documents")
def n2_clamped_settings(spark, d):
    value = F.col("doc_id") % 9 - 3
    return B.table(spark, d, "documents").select("doc_id", F.when(value >= 1, value).otherwise(F.lit(N.least_one("-2")).cast("long")).alias("value"))


@plans.add("created_range", sql("d", f"SELECT {text_of('min(created_at)')} AS first, {text_of('max(created_at)')} AS last FROM d"))
def created_range(spark, d):
    return B.documents(spark, d).agg(B.show(F.min("created_at")).alias("first"), B.show(F.max("created_at")).alias("last"))


@plans.add("m9_m10_chunk_details", sql("cd", f"SELECT 'one' AS kind, {_CHUNK} FROM c JOIN (SELECT id AS i, filename, format, format_category FROM d) ON i = document_id WHERE id = 300001 UNION ALL SELECT 'page', {_CHUNK} FROM (SELECT * FROM c WHERE document_id = 2 ORDER BY chunk_index LIMIT 3 OFFSET 3) JOIN (SELECT id AS i, filename, format, format_category FROM d) ON i = document_id"), text=("token_count",))
def m9_m10_chunk_details(spark, d):
    c, docs = B.chunks(spark, d), B.documents(spark, d)
    rows = [_chunk(D.chunk_detail(c, docs, 300001)).withColumn("kind", F.lit("one")), _chunk(D.document_chunks(c, docs, 2, 3, 2)).withColumn("kind", F.lit("page"))]
    return rows[0].unionByName(rows[1])
