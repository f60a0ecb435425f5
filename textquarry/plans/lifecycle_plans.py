"""Uploads, requests, sync and state."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry.functions.secrets import seal, unseal
from textquarry.operators import lifecycle as L
from textquarry.operators import relational as R
from textquarry.plans import PlanSet
from textquarry.plans import base as B
from textquarry.plans.base import sql
from textquarry.sinks import tables as K
from textquarry.sources.listing import listing
from textquarry.streaming import queues as Q

plans = PlanSet()


def files(spark, d):
    """Files to upload: every third text twice, some too large, some of unknown formats, some under bad names."""
    rows = B.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.expr("CASE doc_id % 3 WHEN 0 THEN concat('x', doc_id % 50) ELSE text END").alias("body"))
    name = F.expr("CASE id % 8 WHEN 1 THEN 'a/b.txt' WHEN 2 THEN 'c.exe' WHEN 3 THEN '' ELSE concat('f', id, '.MD') END")
    return rows.select("id", name.alias("filename"), F.expr("CASE id % 8 WHEN 3 THEN 'text/plain' ELSE 'x/y' END").alias("mime_type"), F.col("body").cast("binary").alias("content"))


_FILES = """f AS (SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN concat('x', doc_id % 50) ELSE text END AS body FROM documents),
    g AS (SELECT id, octet_length(encode(body)) AS file_size, md5(body) AS md5_hash, CASE WHEN octet_length(encode(body)) > 1048576 THEN 'FILE_TOO_LARGE' WHEN id % 8 = 2 THEN 'INVALID_FORMAT' WHEN id % 8 IN (1, 3) THEN 'INVALID_FILENAME' END AS e FROM f),
    s AS (SELECT md5(text) AS h, min(doc_id) AS sid FROM documents WHERE doc_id % 4 = 0 GROUP BY 1), q AS (SELECT md5_hash AS h, min(id) AS fid FROM g WHERE e IS NULL GROUP BY 1),
    x AS (SELECT g.*, coalesce(sid, CASE WHEN fid < id THEN fid END) AS twin FROM g LEFT JOIN s ON s.h = md5_hash LEFT JOIN q ON q.h = md5_hash)"""


@plans.add("m1_s2_s4_upload", f"WITH {_FILES} SELECT id, CAST(file_size AS INT) AS file_size, md5_hash, coalesce(e, CASE WHEN twin IS NOT NULL THEN 'DUPLICATE_FILE' END) AS error, CASE WHEN e IS NULL THEN twin END AS existing_id, CASE WHEN e IS NULL AND twin IS NULL THEN 'PENDING' END AS status FROM x", text=("existing_id",))
def m1_s2_s4_upload(spark, d):
    stored = B.documents(spark, d).where("id % 4 = 0")
    return L.upload(files(spark, d), stored, max_mb=1).select("id", "file_size", "md5_hash", "error", "existing_id", "status")


IDS = [3, 7, 8, 7, 999999999, 16, 27, 38]
_IDS = ", ".join(map(str, IDS))


@plans.add("m5_availability", sql("d", f"SELECT id, CASE WHEN id IN ({_IDS}) AND status = 'COMPLETED' THEN false ELSE is_active END AS is_active FROM d"))
def m5_availability(spark, d):
    return L.set_active(B.documents(spark, d), IDS, False).select("id", "is_active")


@plans.add("m6_j11_delete", sql("dc", f", gone AS (SELECT id FROM d WHERE id IN ({_IDS}) AND status <> 'PROCESSING') SELECT 'document' AS kind, id FROM d WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'chunk', id FROM c WHERE document_id NOT IN (SELECT id FROM gone)"))
def m6_j11_delete(spark, d):
    docs, chunks = L.delete_documents(B.documents(spark, d), B.chunks(spark, d), IDS)
    return docs.select(F.lit("document").alias("kind"), "id").unionByName(chunks.select(F.lit("chunk").alias("kind"), "id"))


@plans.add("m7_retry", sql("d", f"SELECT id, CASE WHEN id IN ({_IDS}) AND status = 'FAILED' THEN 'PENDING' ELSE status END AS status, CASE WHEN id IN ({_IDS}) AND status = 'FAILED' THEN 0 ELSE retry_count END AS retry_count, CASE WHEN id IN ({_IDS}) AND status = 'FAILED' THEN NULL ELSE fail_reason END AS fail_reason FROM d"))
def m7_retry(spark, d):
    return L.retry(B.documents(spark, d), IDS).select("id", "status", "retry_count", "fail_reason")


_ASKED = ", ".join(f"({i}, {x}::BIGINT)" for i, x in enumerate(IDS))


@plans.add("j10_a21_bulk_delete", sql("d", f", v(pos, id) AS (VALUES {_ASKED}), o AS (SELECT v.pos, v.id, CASE WHEN d.id IS NULL THEN 'not_found' WHEN status <> 'PROCESSING' THEN 'done' ELSE 'wrong_state' END AS outcome FROM v LEFT JOIN d ON d.id = v.id) SELECT count(*) FILTER (outcome = 'done') AS affected, string_agg(CASE WHEN outcome <> 'done' THEN concat(id, ':', outcome) END, ',' ORDER BY pos) AS failed FROM o"))
def j10_a21_bulk_delete(spark, d):
    return L.affected(L.bulk(spark, IDS, B.documents(spark, d), "delete")).withColumn("failed", F.array_join("failed", ","))


def _remote(spark, d):
    """Files of a remote folder: known, changed, moved and new ones."""
    rows = B.table(spark, d, "documents").where("doc_id % 2 = 0")
    md5 = F.expr("CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN md5(concat(text, '!')) ELSE md5(text) END")
    return rows.select(F.concat(F.lit("drive-"), "doc_id").alias("file_id"), md5.alias("md5"))


@plans.add(
    "j9_cascade_match",
    sql("d", """, r AS (SELECT concat('drive-', doc_id) AS file_id, CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN md5(concat(text, '!')) ELSE md5(text) END AS md5 FROM documents WHERE doc_id % 2 = 0),
    h AS (SELECT md5_hash, min(id) AS i2 FROM d GROUP BY 1)
    SELECT file_id, coalesce(d.id, i2) AS document_id, CASE WHEN d.id IS NOT NULL AND md5 IS NOT NULL AND md5 <> d.md5_hash THEN 'reprocess' WHEN d.id IS NOT NULL AND d.status = 'FAILED' AND d.fail_reason = 'REMOVED_FROM_DRIVE' THEN 'restore'
    WHEN d.id IS NOT NULL OR i2 IS NOT NULL THEN 'relink' ELSE 'insert' END AS action FROM r LEFT JOIN d ON drive_file_id = file_id LEFT JOIN h ON h.md5_hash = md5"""), text=("document_id",))
def j9_cascade_match(spark, d):
    return R.cascade_match(_remote(spark, d), B.documents(spark, d))


def _changes(spark, d):
    """A change feed over the events: some files change several times, some are removed, some are of unknown formats."""
    e = B.table(spark, d, "events")
    return e.select(F.concat(F.lit("drive-"), F.col("user_id") % 300).alias("file_id"), (F.col("event_type") == "error").alias("removed"), F.concat(F.lit("n"), F.col("event_id") % 9, F.expr("CASE event_id % 4 WHEN 0 THEN '.zip' ELSE '.txt' END")).alias("name"), F.lit("x/y").alias("mime_type"), F.md5(F.col("event_id").cast("string")).alias("md5"), F.col("event_id").alias("seq"))


_FEED = """, e AS (SELECT concat('drive-', user_id % 300) AS file_id, event_type = 'error' AS removed, event_id % 4 = 0 AS unknown, concat('n', event_id % 9, CASE event_id % 4 WHEN 0 THEN '.zip' ELSE '.txt' END) AS name, md5(CAST(event_id AS VARCHAR)) AS md5, row_number() OVER (PARTITION BY user_id % 300 ORDER BY event_id DESC) AS r FROM events),
    a AS (SELECT e.*, id, CASE WHEN removed THEN CASE WHEN id IS NOT NULL THEN 'removed' ELSE 'skipped' END WHEN unknown THEN 'skipped' WHEN id IS NULL THEN 'added' ELSE 'updated' END AS action FROM e LEFT JOIN d ON drive_file_id = file_id WHERE r = 1)"""


@plans.add("st4_s21_change_feed", sql("d", _FEED + """ SELECT d.id, CASE action WHEN 'updated' THEN 'PENDING' WHEN 'removed' THEN 'FAILED' ELSE status END AS status, CASE action WHEN 'updated' THEN NULL WHEN 'removed' THEN 'REMOVED_FROM_DRIVE' ELSE fail_reason END AS fail_reason,
    CASE action WHEN 'updated' THEN a.name ELSE filename END AS filename, CASE action WHEN 'updated' THEN a.md5 ELSE md5_hash END AS md5_hash FROM d LEFT JOIN (SELECT * FROM a WHERE id IS NOT NULL) a ON a.id = d.id"""))
def st4_s21_change_feed(spark, d):
    return L.apply_changes(B.documents(spark, d), _changes(spark, d))[0].select("id", "status", "fail_reason", "filename", "md5_hash")


@plans.add("st9_run_result", sql("d", _FEED + " SELECT count(*) FILTER (action = 'added') AS added, count(*) FILTER (action = 'updated') AS updated, count(*) FILTER (action = 'removed') AS removed, '' AS errors FROM a"))
def st9_run_result(spark, d):
    actions = L.apply_changes(B.documents(spark, d), _changes(spark, d))[1]
    return L.run_result(actions.withColumn("message", F.lit(None).cast("string")))


@plans.add("m18_reprocess", sql("dc", "SELECT d.id, CASE WHEN id % 9 = 4 THEN 'new.txt' ELSE filename END AS filename, CASE WHEN id % 9 = 4 THEN 'PENDING' ELSE status END AS status, CASE WHEN id % 9 = 4 THEN 'LINKED' ELSE connection_state END AS connection_state, CASE WHEN id % 9 <> 4 THEN md5(processed_content) END AS content, CASE WHEN id % 9 = 4 THEN 0 ELSE (SELECT count(*) FROM c WHERE document_id = d.id) END AS chunks FROM d"))
def m18_reprocess(spark, d):
    docs = B.documents(spark, d)
    changed = docs.where("id % 9 = 4").select("id", F.lit("new.txt").alias("filename"), F.lit("m").alias("md5_hash"))
    rows, chunks = L.reprocess(docs, B.chunks(spark, d), changed)
    return R.with_child_count(rows, chunks, "id", "document_id", "chunks").select("id", "filename", "status", "connection_state", F.md5("processed_content").alias("content"), "chunks")


@plans.add("m15_q4_callback", "SELECT doc_id AS document_id, CASE WHEN doc_id % 8 <> 0 AND length(regexp_replace(text, '\\s', '', 'g')) >= 50 AND length(regexp_replace(text, '[a-zA-Z0-9\\s]', '', 'g')) / length(text) <= 0.8 THEN 'COMPLETED' ELSE 'FAILED' END AS status, CASE WHEN doc_id % 8 = 0 THEN 'CORRUPT_FILE' WHEN length(regexp_replace(text, '\\s', '', 'g')) < 50 THEN 'TEXT_TOO_SHORT' WHEN length(regexp_replace(text, '[a-zA-Z0-9\\s]', '', 'g')) / length(text) > 0.8 THEN 'EXCESSIVE_NOISE' END AS fail_reason FROM documents")
def m15_q4_callback(spark, d):
    rows = B.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), (F.col("doc_id") % 8 != 0).alias("success"), F.col("text").alias("content"), F.lit("CORRUPT_FILE").alias("error_code"))
    return L.gate_result(rows).select("document_id", "status", "fail_reason")


@plans.add("k7_result_payload", "SELECT doc_id AS document_id, doc_id % 8 <> 0 AS success, CASE WHEN doc_id % 8 <> 0 THEN md5(text) END AS content, CASE WHEN doc_id % 8 = 0 THEN 'CORRUPT_FILE' END AS code FROM documents")
def k7_result_payload(spark, d):
    rows = B.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), (F.col("doc_id") % 8 != 0).alias("success"), F.col("text").alias("content"), F.lit(1).alias("pages"), F.lit("CORRUPT_FILE").alias("error_code"), F.lit("broken").alias("message"))
    read = lambda path: F.get_json_object("payload", path)
    return L.result_payload(rows).select(read("$.documentId").cast("long").alias("document_id"), read("$.success").cast("boolean").alias("success"), F.md5(read("$.result.processedContent")).alias("content"), read("$.error.code").alias("code"))


@plans.add("k1_store_chunks", sql("c", """, n AS (SELECT id + 50 AS id, document_id, chunk_index, quality_score, token_count FROM c WHERE document_id % 3 = 0 AND chunk_index < 2)
    SELECT id, document_id, chunk_index, round(nullif(quality_score, 0), 6) AS quality_score, nullif(token_count, 0) AS token_count, 'PENDING' AS sync_status FROM n
    UNION ALL SELECT id, document_id, chunk_index, round(quality_score, 6), token_count, sync_status FROM c WHERE document_id NOT IN (SELECT document_id FROM n)"""), text=("token_count",))
def k1_store_chunks(spark, d):
    c = B.chunks(spark, d)
    new = c.where("document_id % 3 = 0 AND chunk_index < 2").withColumn("id", F.col("id") + 50)
    return K.store_chunks(c, new).select("id", "document_id", "chunk_index", F.round("quality_score", 6).alias("quality_score"), "token_count", "sync_status")


@plans.add("k2_metrics_upsert", sql("dm", """, r AS (SELECT d.id AS document_id, greatest(0, date_diff('millisecond', d.created_at, TIMESTAMP '2024-01-20 00:00:00')) AS q, coalesce(m.total_time_ms, 0) AS t, coalesce(nullif(m.total_chunks, 0), 5) AS n FROM m JOIN d ON id = document_id WHERE id % 2 = 0)
    SELECT document_id, q AS queue_time_ms, t AS total_time_ms, q + t AS user_wait_time_ms, n AS total_chunks FROM r UNION ALL SELECT document_id, queue_time_ms, total_time_ms, user_wait_time_ms, total_chunks FROM m WHERE document_id NOT IN (SELECT document_id FROM r)"""), text=("total_time_ms",))
def k2_metrics_upsert(spark, d):
    m = B.metrics(spark, d)
    names = ("document_id", "queue_time_ms", "total_time_ms", "user_wait_time_ms", "total_chunks")
    runs = m.where("document_id % 2 = 0 AND document_id >= 0").select("document_id", "total_time_ms", "total_chunks", F.lit(5).alias("n_chunks"), F.lit("2024-01-20 00:00:00").cast("timestamp").alias("started_at"))
    return K.merged(m.select(*names), K.metric_rows(runs, B.documents(spark, d)).select(*names), "document_id")


def with_vectors(chunks):
    """Chunks with vectors of 4, some of the wrong size or without words."""
    dense = F.expr("CASE id % 6 WHEN 0 THEN array(1.0F, 2.0F) WHEN 1 THEN NULL ELSE array(CAST(id % 7 AS FLOAT), 1.0F, 2.0F, 3.0F) END")
    indices = F.expr("CASE id % 11 WHEN 0 THEN CAST(array() AS array<int>) ELSE array(1, 2) END")
    return chunks.withColumns({"dense_vector": dense, "sparse_indices": indices, "sparse_values": F.expr("array(0.5F, 0.25F)")})


@plans.add("f12_st3_sync_batch", sql("c", """, b AS (SELECT id, coalesce(id % 6 > 1 AND id % 11 <> 0, false) AS ok FROM c WHERE sync_status = 'PENDING' ORDER BY id LIMIT 100)
    SELECT c.id, CASE WHEN ok THEN 'SYNCED' ELSE sync_status END AS sync_status, CASE WHEN ok THEN 0 WHEN id % 6 = 0 THEN 2 WHEN id % 6 > 1 THEN 4 END AS size FROM c LEFT JOIN b USING (id)"""), text=("size",))
def f12_st3_sync_batch(spark, d):
    c = with_vectors(B.chunks(spark, d))
    after, _ = K.sync_batch(c, K.waiting(c), 4)
    return after.select("id", "sync_status", F.size("dense_vector").alias("size"))


@plans.add("st3_give_up", sql("c", "SELECT id, CASE WHEN sync_status = 'PENDING' AND document_id = 7 THEN 'FAILED' ELSE sync_status END AS sync_status FROM c"))
def st3_give_up(spark, d):
    return K.give_up(B.chunks(spark, d), 7).select("id", "sync_status")


@plans.add("k3_k4_points", sql("c", "SELECT id, document_id, md5(content) AS content FROM c WHERE (id % 6 > 1 AND id % 11 <> 0) AND document_id <> 7 AND id NOT IN (300000, 300001)"))
def k3_k4_points(spark, d):
    c = with_vectors(B.chunks(spark, d))
    ok = c.where(K.valid_vector(F.col("dense_vector"), F.col("sparse_indices"), F.col("sparse_values"), 4))
    points = K.upsert_points(K.upsert_points(None, ok.where("id % 2 = 0")), ok)
    return K.delete_points(points, [300000, 300001], 7).select("id", "payload.document_id", F.md5("payload.content").alias("content"))


@plans.add("st2_transitions", "WITH x AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'click' THEN 'PROCESSING' WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' ELSE 'OTHER' END AS state, ts FROM events), y AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM x) SELECT event_id, state, before, coalesce((before IS NULL AND state = 'PENDING') OR (before = 'PENDING' AND state = 'PROCESSING') OR (before = 'PROCESSING' AND state IN ('COMPLETED', 'FAILED', 'PENDING')) OR (before IN ('FAILED', 'COMPLETED') AND state = 'PENDING'), false) AS allowed FROM y")
def st2_transitions(spark, d):
    state = F.expr("CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'click' THEN 'PROCESSING' WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' ELSE 'OTHER' END")
    rows = B.table(spark, d, "events").select("user_id", "event_id", "ts", state.alias("state"))
    return L.transitions(rows, "user_id", "state", "ts", "event_id").select("event_id", "state", "before", "allowed")


_MESSAGE = "CASE doc_id % 5 WHEN 0 THEN concat('CORRUPT_FILE: ', text) WHEN 1 THEN 'fetch failed' WHEN 2 THEN concat('AI worker failed: 503 - CORRUPT_FILE ', text) WHEN 3 THEN 'AI worker failed: 400' END"


@plans.add("st1_st2_attempts", sql("d", f""", a AS (SELECT doc_id, coalesce({_MESSAGE}, '') AS msg, doc_id % 4 + 1 AS n FROM documents WHERE doc_id % 2 = 0),
    b AS (SELECT *, contains(msg, 'fetch failed') OR contains(msg, 'AI worker failed: 5') AS net FROM a), x AS (SELECT *, (contains(msg, 'CORRUPT_FILE') AND NOT net) OR n >= 3 AS over FROM b)
    SELECT id, CASE WHEN over THEN 'FAILED' ELSE status END AS status, md5(CASE WHEN over THEN CASE WHEN net AND n >= 3 THEN concat('AI_WORKER_UNREACHABLE: ', left(msg, 500)) ELSE left(msg, 500) END ELSE fail_reason END) AS reason, CASE WHEN over THEN n ELSE retry_count END AS retry_count, CAST(5000 * pow(2, id % 3) AS BIGINT) AS wait,
    NOT (status = 'COMPLETED' AND coalesce(processed_content, '') <> '') AS must_run FROM d LEFT JOIN x ON doc_id = id"""))
def st1_st2_attempts(spark, d):
    docs = B.documents(spark, d)
    tried = B.table(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.expr(_MESSAGE).alias("message"), (F.col("doc_id") % 4 + 1).alias("attempts"))
    rows = L.after_attempt(docs, tried).select("id", "status", F.md5("fail_reason").alias("reason"), F.col("retry_count").cast("long").alias("retry_count"), L.back_off_ms(F.col("id") % 3 + 1).alias("wait"))
    return rows.join(docs.select("id", L.must_run(F.col("status"), F.col("processed_content")).alias("must_run")), "id")


@plans.add("st5_event_lines", "SELECT event_id, md5(concat('event: document:', event_type, chr(10), 'data: {\"type\":\"document:', event_type, '\",\"payload\":\"', user_id, '\",\"timestamp\":\"', event_id, '\"}', chr(10), chr(10))) AS line FROM events")
def st5_event_lines(spark, d):
    rows = B.table(spark, d, "events").select("event_id", F.concat(F.lit("document:"), "event_type").alias("type"), F.col("user_id").cast("string").alias("payload"), F.col("event_id").cast("string").alias("timestamp"))
    return rows.select("event_id", F.md5(Q.event_column()).alias("line"))


@plans.add("st8_cron", "SELECT doc_id AS id FROM documents WHERE doc_id % 3 <> 0 AND CASE doc_id % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true ELSE false END")
def st8_cron(spark, d):
    cron = F.expr("CASE doc_id % 5 WHEN 0 THEN '*/15 * * * *' WHEN 1 THEN '30 9-17 * 2 1-5' WHEN 2 THEN '0 12 * * *' WHEN 3 THEN '0,30 10/2 * * 6,1' ELSE 'bad' END")
    rows = B.table(spark, d, "documents").select(F.col("doc_id").alias("id"), cron.alias("cron"), (F.col("doc_id") % 3 != 0).alias("enabled"))
    return Q.cron_due(rows, "2024-02-12 12:30:00").select("id")


@plans.add("m11_profiles", sql("p", "SELECT id, name, is_active, is_archived FROM (SELECT id, name, id = 5 AS is_active, is_archived OR id = 6 AS is_archived FROM p UNION ALL SELECT 1000, concat(name, ' v2'), false, false FROM p WHERE id = 0 UNION ALL SELECT 1001, 'brand new', false, false)"))
def m11_profiles(spark, d):
    p = L.activate_profile(L.activate_profile(B.profiles(spark, d), 5), 4)  # 4 is archived: nothing changes
    p = L.archive_profile(L.archive_profile(L.archive_profile(p, 6), 0), 5)  # the default and the active one stay
    p = L.duplicate_profile(p, 0, 1000)
    for key, name in ((1001, "brand new"), (1002, "brand new")):  # a name is given once
        p = L.create_profile(p, spark.createDataFrame([(key, name)], "id long, name string"))
    return p.select("id", "name", "is_active", "is_archived")


@plans.add("m11_delete_profile", sql("pdc", "SELECT (SELECT count(*) FROM p WHERE id <> 4) AS profiles, (SELECT count(*) FROM d WHERE processing_profile_id <> 4) AS documents, (SELECT count(*) FROM c WHERE document_id % 6 <> 4) AS chunks"))
def m11_delete_profile(spark, d):
    tables = B.profiles(spark, d), B.documents(spark, d), B.chunks(spark, d)
    tables = L.delete_profile(*L.delete_profile(*tables, 4, confirmed=False), 3)  # unconfirmed with documents, not archived: both stay
    tables = L.delete_profile(*tables, 4)
    counts = [df.agg(F.count(F.lit(1)).alias(n)) for df, n in zip(tables, ("profiles", "documents", "chunks"), strict=True)]
    from textquarry.operators.analytics import beside

    return beside(*counts)


@plans.add("m12_default_profile", sql("p", """, x AS (SELECT id, name, is_default FROM p), y AS (SELECT 'others' AS part, * FROM x WHERE NOT is_default UNION ALL SELECT 'all', * FROM x)
    SELECT * FROM y UNION ALL SELECT part, 0, 'Default', true FROM (SELECT part FROM y GROUP BY part HAVING NOT bool_or(is_default)) UNION ALL SELECT 'none', 0, 'Default', true"""))
def m12_default_profile(spark, d):
    """All profiles, those that aren't default, and none of them, with a default one where there is none."""
    p, now = B.profiles(spark, d).select("id", "name", "is_default"), "2024-01-01 00:00:00"
    parts = {"all": p, "others": p.where("NOT is_default"), "none": p.where("1 = 0")}
    made = [L.default_profile(spark, x, now).select(F.lit(n).alias("part"), "id", "name", "is_default") for n, x in parts.items()]
    return made[0].unionByName(made[1]).unionByName(made[2])


@plans.add("m13_m17_folders", sql("d", "SELECT id, CASE WHEN drive_folder_id = 2 THEN 'STANDALONE' WHEN drive_folder_id IS NOT NULL THEN 'LINKED' ELSE connection_state END AS connection_state, CASE WHEN drive_folder_id = 2 THEN NULL ELSE drive_folder_id END AS drive_folder_id FROM d"), text=("drive_folder_id",))
def m13_m17_folders(spark, d):
    _, docs = L.drop_folder(B.folders(spark, d), B.documents(spark, d), 2)
    return L.link_backfill(docs).select("id", "connection_state", "drive_folder_id")


@plans.add("m13_m14_folder_state", sql("f", f"SELECT id, folder_name, CASE id WHEN 1 THEN 'IDLE' WHEN 3 THEN 'SYNCING' WHEN 4 THEN 'ERROR' ELSE sync_status END AS sync_status, CASE WHEN id = 4 THEN 'gone' WHEN id IN (1, 3) THEN NULL ELSE sync_error END AS sync_error, CASE WHEN id = 1 THEN '2024-02-10 12:00:00' ELSE {B.text_of('last_synced_at')} END AS last_synced_at FROM f WHERE id <> 2 UNION ALL SELECT 9, 'new', NULL, NULL, NULL"))
def m13_m14_folder_state(spark, d):
    f = B.folders(spark, d)
    f = L.save_folder(f, spark.createDataFrame([(9, "new")], "id long, folder_name string"))
    f, _ = L.drop_folder(f, B.documents(spark, d), 2)
    f = L.sync_state(L.sync_state(L.sync_state(f, 1, "IDLE", "2024-02-10 12:00:00"), 3, "SYNCING"), 4, "ERROR", error="gone")
    return f.select("id", "folder_name", "sync_status", "sync_error", B.show("last_synced_at").alias("last_synced_at"))


@plans.add("f15_s20_remote_listing", "SELECT doc_id AS id FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 3 = 1")
def f15_s20_remote_listing(spark, d):
    mime = F.expr("CASE doc_id % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'text/csv' ELSE 'application/vnd.google-apps.folder' END")
    return listing(B.table(spark, d, "documents").select(F.col("doc_id").alias("id"), mime.alias("mime_type"), (F.col("doc_id") % 4 == 0).alias("trashed"))).select("id")


@plans.add("h2_encryption", "SELECT doc_id, md5(text) AS digest, 12 + octet_length(encode(text)) + 16 AS size FROM documents")
def h2_encryption(spark, d):
    key = F.lit("0123456789abcdef0123456789abcdef")
    rows = B.table(spark, d, "documents").select("doc_id", seal(F.col("text"), key).alias("sealed"))
    return rows.select("doc_id", F.md5(unseal(F.col("sealed"), key)).alias("digest"), F.octet_length("sealed").cast("long").alias("size"))


_LISTED = """, r AS (SELECT concat('drive-', doc_id) AS file_id, concat('n', doc_id, CASE doc_id % 8 WHEN 5 THEN '.exe' ELSE '.md' END) AS name, doc_id % 8 = 5 AS bad, CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN md5(concat(text, '!')) ELSE md5(text) END AS md5 FROM documents WHERE doc_id % 4 <> 2),
    g AS (SELECT * FROM r WHERE NOT bad), o AS (SELECT * FROM d WHERE drive_folder_id = 3), h AS (SELECT md5_hash, min(id) AS i2 FROM d GROUP BY 1),
    f AS (SELECT coalesce(g.file_id, o.drive_file_id) AS file_id, g.name, g.md5, CASE WHEN o.id IS NULL THEN 'add' WHEN g.file_id IS NULL THEN 'remove' WHEN g.md5 IS NOT NULL AND g.md5 <> o.md5_hash THEN 'update' ELSE 'skip' END AS act, o.id AS known FROM g FULL JOIN o ON o.drive_file_id = g.file_id),
    a AS (SELECT f.*, coalesce(k.id, i2) AS found, CASE WHEN act <> 'add' THEN act WHEN k.id IS NOT NULL AND f.md5 IS NOT NULL AND f.md5 <> k.md5_hash THEN 'reprocess' WHEN k.id IS NOT NULL AND k.status = 'FAILED' AND k.fail_reason = 'REMOVED_FROM_DRIVE' THEN 'restore' WHEN k.id IS NOT NULL OR i2 IS NOT NULL THEN 'relink' ELSE 'insert' END AS how
    FROM f LEFT JOIN d k ON act = 'add' AND k.drive_file_id = f.file_id LEFT JOIN h ON act = 'add' AND h.md5_hash = f.md5 WHERE act <> 'skip')"""


def _listed(spark, d):
    rows = B.table(spark, d, "documents").where("doc_id % 4 <> 2")
    md5 = F.expr("CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN md5(concat(text, '!')) ELSE md5(text) END")
    return rows.select(F.concat(F.lit("drive-"), "doc_id").alias("file_id"), F.concat(F.lit("n"), "doc_id", F.expr("CASE doc_id % 8 WHEN 5 THEN '.exe' ELSE '.md' END")).alias("name"), F.lit("x/y").alias("mime_type"), md5.alias("md5"))


@plans.add("m14_j8_full_sync", sql("d", _LISTED + """ SELECT d.id, CASE WHEN how IN ('update', 'reprocess') THEN 'PENDING' WHEN how = 'remove' THEN 'FAILED' WHEN how = 'restore' THEN 'COMPLETED' ELSE status END AS status, CASE WHEN how = 'remove' THEN 'REMOVED_FROM_DRIVE' WHEN how IN ('update', 'reprocess', 'restore') THEN NULL ELSE fail_reason END AS fail_reason,
    CASE WHEN how IN ('update', 'reprocess') THEN x.name ELSE filename END AS filename, CASE WHEN how IN ('update', 'reprocess', 'restore', 'relink') THEN 'LINKED' ELSE connection_state END AS connection_state, false AS is_new FROM d LEFT JOIN (SELECT DISTINCT ON (i) * FROM (SELECT coalesce(found, known) AS i, * FROM a WHERE coalesce(found, known) IS NOT NULL) ORDER BY i, file_id) x ON i = d.id
    UNION ALL SELECT 0, 'PENDING', NULL, name, 'LINKED', true FROM a WHERE how = 'insert'"""))
def m14_j8_full_sync(spark, d):
    docs, _ = L.full_sync(_listed(spark, d), B.documents(spark, d), 3)
    new = F.col("retry_count").isNull()
    return docs.select(F.when(new, F.lit(0)).otherwise(F.col("id")).alias("id"), "status", "fail_reason", "filename", "connection_state", new.alias("is_new"))


@plans.add("m14_st9_full_sync_result", sql("d", _LISTED + " SELECT count(*) FILTER (act = 'add') AS added, count(*) FILTER (act = 'update') AS updated, count(*) FILTER (act = 'remove') AS removed, (SELECT md5(string_agg(concat(name, ': Unsupported format: x/y'), '; ' ORDER BY name)) FROM r WHERE bad) AS errors FROM a"))
def m14_st9_full_sync_result(spark, d):
    _, actions = L.full_sync(_listed(spark, d), B.documents(spark, d), 3)
    return L.run_result(actions).withColumn("errors", F.md5("errors"))


@plans.add("m15_k1_k2_callbacks", sql("dcm", r""", v AS (SELECT doc_id, doc_id % 8 <> 0 AND length(regexp_replace(text, '\s', '', 'g')) >= 50 AND length(regexp_replace(text, '[a-zA-Z0-9\s]', '', 'g')) / length(text) <= 0.8 AS ok FROM documents WHERE doc_id % 2 = 0),
    k AS (SELECT document_id, count(*) FILTER (chunk_index < 2) AS two, count(*) AS n FROM c GROUP BY 1)
    SELECT d.id, CASE WHEN ok THEN 'COMPLETED' WHEN NOT ok THEN 'FAILED' ELSE status END AS status, CASE WHEN ok THEN md5(text) ELSE md5(processed_content) END AS content, CASE WHEN ok THEN two ELSE n END AS chunks, CASE WHEN ok AND m.document_id IS NOT NULL THEN greatest(0, date_diff('millisecond', d.created_at, TIMESTAMP '2024-01-20 00:00:00')) WHEN m.document_id IS NOT NULL THEN queue_time_ms ELSE -1 END AS queue_time_ms
    FROM d JOIN documents ON doc_id = d.id LEFT JOIN v ON v.doc_id = d.id LEFT JOIN k ON k.document_id = d.id LEFT JOIN m ON m.document_id = d.id"""))
def m15_k1_k2_callbacks(spark, d):
    docs, c, m = B.documents(spark, d), B.chunks(spark, d), B.metrics(spark, d)
    results = B.table(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("document_id"), (F.col("doc_id") % 8 != 0).alias("success"), F.col("text").alias("content"), F.lit("CORRUPT_FILE").alias("error_code"))
    runs = m.select("document_id", "total_time_ms", "total_chunks", F.lit(5).alias("n_chunks"), F.lit("2024-01-20 00:00:00").cast("timestamp").alias("started_at"))
    docs, c, m = L.apply_callbacks(results, docs, c, m, c.where("chunk_index < 2"), runs)
    rows = R.with_child_count(docs, c, "id", "document_id", "chunks").join(m.select(F.col("document_id").alias("id"), "queue_time_ms"), "id", "left")
    return rows.select("id", "status", F.md5("processed_content").alias("content"), "chunks", F.coalesce("queue_time_ms", F.lit(-1)).alias("queue_time_ms"))
