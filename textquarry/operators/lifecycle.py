"""What happens to stored rows: whole-table rewrites that a keyed sink (textquarry.sinks) writes.

Each function takes the stored frames and returns new ones; nothing is changed in place. Requests are short lists of ids or frames of events.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.functions.numbers import next_version
from textquarry.operators.quality import Profile, gated
from textquarry.operators.relational import among, bulk_outcome, cascade_match, snapshot_diff
from textquarry.sinks.tables import merged, metric_rows, store_chunks
from textquarry.sources.detect import detect_format, upload_error

#: Reason of documents that vanished from their remote folder, errors after which nothing is tried again, signs of an error of the
#: network (which is tried again whatever else it says), what a reason begins with when those ran out, and its greatest length.
REMOVED = "REMOVED_FROM_DRIVE"
PERMANENT = ("PASSWORD_PROTECTED", "CORRUPT_FILE", "UNSUPPORTED_FORMAT")
NETWORK = ("fetch failed", "ECONNREFUSED", "ETIMEDOUT", "AI worker failed: 5")
UNREACHABLE, REASON_CHARS = "AI_WORKER_UNREACHABLE: ", 500
ATTEMPTS, BACK_OFF_MS = 3, 5000


def upload(files: DataFrame, stored: DataFrame, max_mb: int = 50) -> DataFrame:
    """Each file (id, filename, mime_type, content) with what becomes of it: an error code, DUPLICATE_FILE with the id it doubles, or null and
    the new row's columns. Within one batch the least id of equal contents is the first."""
    size = F.octet_length("content")
    error = upload_error(size, F.col("mime_type"), F.col("filename"), max_mb)
    rows = files.select("id", "filename", "mime_type", size.alias("file_size"), F.md5("content").alias("md5_hash"), detect_format(F.col("mime_type"), F.col("filename")).alias("format"), error.alias("error"))
    known = stored.where("md5_hash IS NOT NULL").groupBy("md5_hash").agg(F.min("id").alias("stored_id"))
    first = rows.where("error IS NULL").groupBy("md5_hash").agg(F.min("id").alias("first_id"))
    x = rows.join(known, "md5_hash", "left").join(first, "md5_hash", "left")
    twin = F.coalesce("stored_id", F.when(F.col("first_id") < F.col("id"), F.col("first_id")))
    state = F.when(F.col("error").isNotNull(), F.col("error")).when(twin.isNotNull(), "DUPLICATE_FILE")
    return x.select("id", "filename", "mime_type", "file_size", "md5_hash", "format", state.alias("error"), F.when(F.col("error").isNull(), twin).alias("existing_id"), F.when(state.isNull(), "PENDING").alias("status"))


def set_active(documents: DataFrame, ids: list, active: bool) -> DataFrame:
    """Completed documents of the list get the flag; others stay as they are."""
    hit = F.col("id").isin(ids) & (F.col("status") == "COMPLETED")
    return documents.withColumn("is_active", F.when(hit, F.lit(active)).otherwise(F.col("is_active")))


def delete_documents(documents: DataFrame, chunks: DataFrame, ids: list) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) without those of the list that aren't in process."""
    gone = among(documents, "id", ids).where(F.col("status") != "PROCESSING").select("id")
    left = documents.join(F.broadcast(gone), "id", "left_anti")  # at most 100 ids
    return left, chunks.join(F.broadcast(gone.withColumnRenamed("id", "document_id")), "document_id", "left_anti")


def delete_chunks_of(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks without those of the given documents."""
    return chunks.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_anti")


def retry(documents: DataFrame, ids: list) -> DataFrame:
    """Failed documents of the list wait again, from the first attempt and with no profile of their own."""
    hit = F.col("id").isin(ids) & (F.col("status") == "FAILED")
    return documents.withColumns({"retry_count": F.when(hit, 0).otherwise(F.col("retry_count")), "fail_reason": F.when(~hit, F.col("fail_reason")), "status": F.when(hit, "PENDING").otherwise(F.col("status"))})


def bulk(spark: SparkSession, ids: list[int], documents: DataFrame, action: str) -> DataFrame:
    """(pos, id, outcome) of a request in its order: ``delete``, ``retry`` or ``availability``."""
    allowed = {"delete": F.col("status") != "PROCESSING", "retry": F.col("status") == "FAILED", "availability": F.col("status") == "COMPLETED"}
    return bulk_outcome(spark, ids, documents, "id", allowed[action])


def affected(outcomes: DataFrame) -> DataFrame:
    """(affected, failed): how many of a request's ids were changed, and the others in order."""
    bad = F.sort_array(F.collect_list(F.when(F.col("outcome") != "done", F.struct("pos", "id", "outcome"))))  # at most 100
    return outcomes.agg(F.count_if(F.col("outcome") == "done").alias("affected"), F.transform(bad, lambda x: F.concat_ws(":", x["id"].cast("string"), x["outcome"])).alias("failed"))


def _says(message: Column, signs: tuple[str, ...]) -> Column:
    said = F.coalesce(message, F.lit(""))
    return reduce(lambda a, b: a | b, [said.contains(x) for x in signs])


def failed_for_good(message: Column, attempts: Column, most: int = ATTEMPTS) -> Column:
    """Whether a failed attempt was the last: a permanent error that isn't one of the network, or no attempt left."""
    return (_says(message, PERMANENT) & ~_says(message, NETWORK)) | (attempts >= most)


def fail_reason(message: Column, attempts: Column, most: int = ATTEMPTS) -> Column:
    """The reason that is stored: the first 500 characters, marked where the network failed to the last."""
    cut = F.substring(F.coalesce(message, F.lit("")), 1, REASON_CHARS)
    return F.when(_says(message, NETWORK) & (attempts >= most), F.concat(F.lit(UNREACHABLE), cut)).otherwise(cut)


def must_run(status: Column, content: Column) -> Column:
    """Whether a queued job still has to run: not if its document is completed and has content."""
    return ~F.coalesce((status == "COMPLETED") & (F.coalesce(content, F.lit("")) != ""), F.lit(False))


def after_attempt(documents: DataFrame, attempts: DataFrame) -> DataFrame:
    """``documents`` after failed attempts (id, message, attempts): those that failed for good, with their reason and number of attempts."""
    x = documents.join(attempts.select("id", "message", "attempts"), "id", "left")
    over = F.coalesce(F.col("attempts").isNotNull() & failed_for_good(F.col("message"), F.col("attempts")), F.lit(False))
    out = x.withColumns({"status": F.when(over, "FAILED").otherwise(F.col("status")), "fail_reason": F.when(over, fail_reason(F.col("message"), F.col("attempts"))).otherwise(F.col("fail_reason")), "retry_count": F.when(over, F.col("attempts")).otherwise(F.col("retry_count")).cast(dict(documents.dtypes)["retry_count"])})
    return out.select(*documents.columns)


def back_off_ms(attempts: Column) -> Column:
    """Exponential: 5 s before the second attempt, 10 s before the third."""
    return (F.lit(BACK_OFF_MS) * F.pow(F.lit(2), attempts - 1)).cast("long")


#: The states a document may go to from each; nothing follows on a state that isn't listed.
STEPS = {None: ("PENDING",), "PENDING": ("PROCESSING",), "PROCESSING": ("COMPLETED", "FAILED", "PENDING"), "FAILED": ("PENDING",), "COMPLETED": ("PENDING",)}


def transitions(events: DataFrame, key: str, state: str, *order: str) -> DataFrame:
    """``events`` with the state before each and whether the step is allowed; the first event comes from nothing."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    allowed = F.lit(False)
    for old, after in STEPS.items():
        allowed = allowed | ((F.col("before").isNull() if old is None else F.col("before") == old) & F.col(state).isin(*after))
    return events.withColumn("before", before).withColumn("allowed", F.coalesce(allowed, F.lit(False)))


def apply_changes(stored: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, actions) after a batch of the change feed: (file_id, removed, name, mime_type, md5, seq). The last change of a file counts; a
    change to a format nobody reads is skipped; a removed file's document fails; an unknown one is added; another waits anew."""
    fmt = detect_format(F.col("mime_type"), F.col("name"))
    last = changes.groupBy("file_id").agg(F.max_by(F.struct("removed", "name", "mime_type", "md5", fmt.alias("format")), "seq").alias("c")).select("file_id", "c.*")
    x = last.join(stored.where("drive_file_id IS NOT NULL").select(F.col("drive_file_id").alias("file_id"), F.col("id").alias("known")), "file_id", "left")
    action = F.when(F.col("removed"), F.when(F.col("known").isNotNull(), "removed").otherwise("skipped")).when(F.col("format").isNull(), "skipped").when(F.col("known").isNull(), "added").otherwise("updated")
    actions = x.withColumn("action", action)
    hit = actions.where("action IN ('removed', 'updated')").select(F.col("known").alias("id"), "action", "name", "md5")
    y = stored.join(hit, "id", "left")
    updated, removed = F.coalesce(F.col("action") == "updated", F.lit(False)), F.coalesce(F.col("action") == "removed", F.lit(False))
    changed = {
        "status": F.when(updated, "PENDING").when(removed, "FAILED").otherwise(F.col("status")),
        "fail_reason": F.when(removed, REMOVED).when(~updated, F.col("fail_reason")),
        "filename": F.when(updated, F.col("name")).otherwise(F.col("filename")),
        "md5_hash": F.when(updated & F.col("md5").isNotNull(), F.col("md5")).otherwise(F.col("md5_hash")),
        "processed_content": F.when(~updated, F.col("processed_content")),
    }
    return y.withColumns(changed).select(*stored.columns), actions


def full_sync(remote: DataFrame, documents: DataFrame, folder: int) -> tuple[DataFrame, DataFrame]:
    """(documents, actions) after a whole listing (file_id, name, mime_type, md5) of a folder.

    Files the folder doesn't know are added: a document with that remote id or content anywhere is linked (restored if it had vanished, put back to
    waiting if its content changed), else there is a new one. Known ones whose content changed wait anew; documents whose file is gone fail.
    Files of formats that nobody reads are errors; the others go on.
    """
    own = F.coalesce(F.col("drive_folder_id") == folder, F.lit(False))
    fmt = detect_format(F.col("mime_type"), F.col("name"))
    files = remote.withColumn("format", fmt)
    mine = documents.where(own).select(F.col("drive_file_id").alias("file_id"), F.col("md5_hash").alias("md5"))
    diff = snapshot_diff(files.where("format IS NOT NULL").select("file_id", "md5"), mine, "file_id", "md5").where("action <> 'skip'")
    named = diff.join(files.select("file_id", "name", "mime_type", "md5", "format"), "file_id", "left")
    matched = cascade_match(named.where("action = 'add'").select("file_id", "md5"), documents).select("file_id", F.col("document_id").alias("found"), F.col("action").alias("how"))
    known = documents.where(own).groupBy(F.col("drive_file_id").alias("file_id")).agg(F.min("id").alias("known"))
    actions = named.join(matched, "file_id", "left").join(known, "file_id", "left").select("file_id", "name", "mime_type", "md5", "format", F.coalesce("how", "action").alias("how"), F.coalesce("found", "known").alias("id"))
    x = documents.join(actions.where("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("file_id", "name", "md5", "how")).alias("a")), "id", "left")
    how, anew = F.col("a.how"), F.col("a.how").isin("update", "reprocess")
    linked = how.isin("update", "reprocess", "restore", "relink")
    changed = {
        "status": F.when(anew, "PENDING").when(how == "remove", "FAILED").when(how == "restore", "COMPLETED").otherwise(F.col("status")),
        "fail_reason": F.when(how == "remove", REMOVED).when(~F.coalesce(anew | (how == "restore"), F.lit(False)), F.col("fail_reason")),
        "filename": F.when(anew, F.col("a.name")).otherwise(F.col("filename")),
        "md5_hash": F.when(anew & F.col("a.md5").isNotNull(), F.col("a.md5")).otherwise(F.col("md5_hash")),
        "processed_content": F.when(~F.coalesce(anew, F.lit(False)), F.col("processed_content")),
        "drive_file_id": F.when(linked, F.col("a.file_id")).otherwise(F.col("drive_file_id")),
        "drive_folder_id": F.when(linked, F.lit(folder).cast(dict(documents.dtypes)["drive_folder_id"])).otherwise(F.col("drive_folder_id")),
        "connection_state": F.when(linked, "LINKED").otherwise(F.col("connection_state")),
    }
    new = actions.where("how = 'insert'").select(F.xxhash64("file_id").alias("id"), F.col("name").alias("filename"), "format", F.lit("PENDING").alias("status"), F.col("md5").alias("md5_hash"), F.col("file_id").alias("drive_file_id"), F.lit(folder).cast("long").alias("drive_folder_id"), F.lit("LINKED").alias("connection_state"), F.lit("DRIVE").alias("source_type"))
    bad = files.where("format IS NULL").select("file_id", F.lit("error").alias("action"), F.concat("name", F.lit(": Unsupported format: "), F.coalesce("mime_type", F.lit(""))).alias("message"))
    counted = F.when(F.col("how") == "update", "updated").when(F.col("how") == "remove", "removed").otherwise("added")
    done = actions.select("file_id", counted.alias("action"), F.lit(None).cast("string").alias("message"))
    return x.withColumns(changed).select(*documents.columns).unionByName(new, allowMissingColumns=True), done.unionByName(bad)


def apply_callbacks(results: DataFrame, documents: DataFrame, chunks: DataFrame, metrics: DataFrame, new_chunks: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, chunks, metrics) after results came back: the gate decides; chunks and metrics of those that pass are stored, the others' are not."""
    done = gate_result(results).select(F.col("document_id").alias("id"), F.col("status").alias("new_status"), F.col("fail_reason").alias("new_reason"), F.col("content").alias("new_content"))
    good = done.where("new_status = 'COMPLETED'").select(F.col("id").alias("document_id"))
    passed = lambda df: df.join(good, "document_id", "left_semi")
    x, hit = documents.join(done, "id", "left"), F.col("new_status").isNotNull()
    changed = {
        "status": F.coalesce("new_status", "status"),
        "fail_reason": F.when(hit, F.col("new_reason")).otherwise(F.col("fail_reason")),
        "processed_content": F.when(F.col("new_status") == "COMPLETED", F.col("new_content")).otherwise(F.col("processed_content")),
    }
    stored = store_chunks(chunks, passed(new_chunks))
    rows = metric_rows(passed(runs), documents)
    return x.withColumns(changed).select(*documents.columns), stored, merged(metrics, rows.select(*[c for c in rows.columns if c in metrics.columns]), "document_id")


def run_result(actions: DataFrame) -> DataFrame:
    """One row: added, updated, removed, and errors in order, joined by semicolons."""
    n = lambda a: F.count_if(F.col("action") == a).alias(a)
    errors = F.array_join(F.sort_array(F.collect_list(F.when(F.col("action") == "error", F.col("message")))), "; ")
    return actions.agg(n("added"), n("updated"), n("removed"), errors.alias("errors"))


def reprocess(documents: DataFrame, chunks: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks): documents of ``changed`` (id, filename, md5_hash) wait anew with cleared results, and their chunks go."""
    new = changed.select("id", F.col("filename").alias("new_name"), F.col("md5_hash").alias("new_md5"), F.lit(True).alias("hit"))
    x = documents.join(new, "id", "left")
    hit = F.coalesce("hit", F.lit(False))
    out = x.withColumns({"filename": F.coalesce("new_name", "filename"), "md5_hash": F.coalesce("new_md5", "md5_hash"), "status": F.when(hit, "PENDING").otherwise(F.col("status")), "retry_count": F.when(hit, 0).otherwise(F.col("retry_count")), "fail_reason": F.when(~hit, F.col("fail_reason")), "processed_content": F.when(~hit, F.col("processed_content")), "connection_state": F.when(hit, "LINKED").otherwise(F.col("connection_state"))})
    return out.select(*documents.columns), delete_chunks_of(chunks, changed)


def gate_result(results: DataFrame) -> DataFrame:
    """Callback rows (document_id, success, content, error_code) with the state they lead to and its reason."""
    passed = F.col("verdict").isin("OK", "HIGH_NOISE_RATIO")
    out = gated(results, "content").withColumns({"status": F.when(F.col("success") & passed, "COMPLETED").otherwise("FAILED"), "fail_reason": F.when(~F.col("success"), F.col("error_code")).when(~passed, F.col("verdict"))})
    return out.drop("noise", "verdict")


def result_payload(results: DataFrame) -> DataFrame:
    """(document_id, payload): what is reported of a run, as JSON: a result or an error."""
    good = F.to_json(F.struct(F.col("document_id").alias("documentId"), F.lit(True).alias("success"), F.struct(F.col("content").alias("processedContent"), F.col("pages").alias("pageCount")).alias("result")))
    bad = F.to_json(F.struct(F.col("document_id").alias("documentId"), F.lit(False).alias("success"), F.struct(F.col("error_code").alias("code"), F.col("message")).alias("error")))
    return results.select("document_id", F.when(F.col("success"), good).otherwise(bad).alias("payload"))


# profiles and folders: small tables


def default_profile(spark: SparkSession, profiles: DataFrame | None, now: str) -> DataFrame:
    """The profiles, with a default one if there is none."""
    p = Profile()
    row = spark.createDataFrame([(0, "Default", True, True, False, p.chunk_size, p.chunk_overlap)], "id long, name string, is_default boolean, is_active boolean, is_archived boolean, chunk_size int, chunk_overlap int").withColumn("created_at", F.lit(now).cast("timestamp"))
    if profiles is None:
        return row
    has = profiles.where("is_default").limit(1)
    return profiles.unionByName(row.join(has, F.lit(True), "left_anti"), allowMissingColumns=True)


def duplicate_profile(profiles: DataFrame, key: int, new_key: int, name: str | None = None) -> DataFrame:
    """The profiles and a copy of one, neither default nor active, under a name nobody has."""
    taken = {r[0] for r in profiles.select("name").collect()}  # profiles are made by hand
    source = profiles.where(F.col("id") == key).first()
    if source is None:
        raise KeyError(key)
    name = name if name and name not in taken else next_version(name or source["name"], taken)
    copy = profiles.where(F.col("id") == key).withColumns({"id": F.lit(new_key).cast(dict(profiles.dtypes)["id"]), "name": F.lit(name), "is_default": F.lit(False), "is_active": F.lit(False), "is_archived": F.lit(False)})
    return profiles.unionByName(copy.select(*profiles.columns))


def create_profile(profiles: DataFrame, row: DataFrame) -> DataFrame:
    """The profiles and a new one, neither default nor active; unchanged where the name is taken."""
    new = row.withColumns({"is_default": F.lit(False), "is_active": F.lit(False), "is_archived": F.lit(False)})
    return profiles.unionByName(new.join(profiles.select("name"), "name", "left_anti"), allowMissingColumns=True)


def activate_profile(profiles: DataFrame, key: int) -> DataFrame:
    """That profile alone is active; unchanged where it is archived or not there."""
    able = profiles.agg(F.coalesce(F.bool_or((F.col("id") == key) & ~F.col("is_archived")), F.lit(False)).alias("able"))
    x = profiles.join(F.broadcast(able))  # one row
    return x.withColumn("is_active", F.when(F.col("able"), F.col("id") == key).otherwise(F.col("is_active"))).drop("able")


def archive_profile(profiles: DataFrame, key: int, archived: bool = True) -> DataFrame:
    """The default and the active profile can't be archived."""
    hit = (F.col("id") == key) & ~(F.lit(archived) & (F.col("is_default") | F.col("is_active")))
    return profiles.withColumn("is_archived", F.when(hit, F.lit(archived)).otherwise(F.col("is_archived")))


def delete_profile(profiles: DataFrame, documents: DataFrame, chunks: DataFrame, key: int, confirmed: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An archived profile, neither default nor active, goes with its documents and their chunks; without confirmation only if it has no documents."""
    gone = profiles.where((F.col("id") == key) & F.col("is_archived") & ~F.col("is_default") & ~F.col("is_active")).select("id")
    if not confirmed:
        gone = gone.join(documents.select(F.col("processing_profile_id").alias("id")), "id", "left_anti")
    doomed = documents.join(F.broadcast(gone.withColumnRenamed("id", "processing_profile_id")), "processing_profile_id", "left_semi").select("id")
    return profiles.join(F.broadcast(gone), "id", "left_anti"), documents.join(doomed, "id", "left_anti"), delete_chunks_of(chunks, doomed)


def drop_folder(folders: DataFrame, documents: DataFrame, key: int) -> tuple[DataFrame, DataFrame]:
    """The folder goes; its documents stay, by themselves."""
    hit = F.col("drive_folder_id") == key
    alone = documents.withColumns({"connection_state": F.when(hit, "STANDALONE").otherwise(F.col("connection_state")), "drive_folder_id": F.when(~F.coalesce(hit, F.lit(False)), F.col("drive_folder_id"))})
    return folders.where(F.col("id") != key), alone


def save_folder(folders: DataFrame, row: DataFrame) -> DataFrame:
    """Adds folder settings or puts them in place of those with the same id."""
    return folders.join(F.broadcast(row.select("id")), "id", "left_anti").unionByName(row, allowMissingColumns=True)


def sync_state(folders: DataFrame, key: int, state: str, now: str | None = None, error: str | None = None) -> DataFrame:
    """A folder's run: SYNCING, IDLE with its time, or ERROR with its message."""
    hit = F.col("id") == key
    done = hit & (F.lit(state) == "IDLE")
    return folders.withColumns({"sync_status": F.when(hit, state).otherwise(F.col("sync_status")), "sync_error": F.when(hit, F.lit(error)).otherwise(F.col("sync_error")), "last_synced_at": F.when(done, F.lit(now).cast("timestamp")).otherwise(F.col("last_synced_at"))})


def link_backfill(documents: DataFrame) -> DataFrame:
    """Documents with a remote folder that stand alone become linked."""
    hit = F.col("drive_folder_id").isNotNull() & (F.col("connection_state") == "STANDALONE")
    return documents.withColumn("connection_state", F.when(hit, "LINKED").otherwise(F.col("connection_state")))
