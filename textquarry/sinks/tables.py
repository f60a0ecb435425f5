"""Keyed tables in a folder: rows are replaced or merged by key, and readers see one whole version.

A version is a folder of Parquet files; ``_current`` names the one that counts. It is written after the version is whole, so a failed or
repeated write leaves the old version in place. One writer at a time, as ``foreachBatch`` gives.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions.numbers import elapsed_ms
from textquarry.operators.quality import coerce_falsy


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self.fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[str]:
        """Whole versions, oldest first."""
        mark = self._path(f"{self.path}/_current")
        if not self.fs.exists(mark):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(mark))

    def read(self) -> DataFrame | None:
        whole = self.versions()
        return self.spark.read.parquet(f"{self.path}/{whole[-1].split('.', 1)[1]}") if whole else None

    def write(self, df: DataFrame) -> None:
        """Makes ``df`` the table. It may be derived from what the table holds now."""
        name = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        whole = self.versions()
        n = int(whole[-1].split(".")[0]) + 1 if whole else 0
        self.fs.create(self._path(f"{self.path}/_current/{n:012d}.{name}"), False).close()
        for old in whole[: max(0, len(whole) + 1 - self.keep)]:
            self.fs.delete(self._path(f"{self.path}/{old.split('.', 1)[1]}"), True)
            self.fs.delete(self._path(f"{self.path}/_current/{old}"), False)

    def replace(self, rows: DataFrame, key: str, keys: DataFrame | None = None) -> None:
        """All rows of the keys of ``rows`` (and of ``keys``) go, ``rows`` come."""
        self.write(replaced(self.read(), rows, key, keys))

    def merge(self, rows: DataFrame, *key: str) -> None:
        self.write(merged(self.read(), rows, *key))


def replaced(stored: DataFrame | None, rows: DataFrame, key: str, keys: DataFrame | None = None) -> DataFrame:
    """``stored`` without the keys of ``rows`` and ``keys``, and ``rows``; columns that one side lacks are null."""
    if stored is None:
        return rows
    gone = rows.select(key) if keys is None else rows.select(key).unionByName(keys.select(key))
    return stored.join(gone.distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def merged(stored: DataFrame | None, rows: DataFrame, *key: str) -> DataFrame:
    """``stored`` with ``rows`` in place of those of the same key, and the others added."""
    if stored is None:
        return rows
    return stored.join(rows.select(*key), list(key), "left_anti").unionByName(rows, allowMissingColumns=True)


def store_chunks(stored: DataFrame | None, chunks: DataFrame, key: str = "document_id") -> DataFrame:
    """The chunk table after new chunks of some documents: all old ones of those go, the new ones wait to be synchronised. Zero scores, false and
    zero tokens are stored as null."""
    return replaced(stored, coerce_falsy(chunks).withColumn("sync_status", F.lit("PENDING")), key)


def metric_rows(runs: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows of the metrics table for runs (document_id, started_at, total_time_ms, total_chunks, n_chunks ...): queue time from the document's
    creation to the start, not under 0, and the wait, which is both. A missing number of chunks is the number that came."""
    d = documents.select(F.col("id").alias("document_id"), F.col("created_at").alias("enqueued_at"))
    total = F.coalesce("total_time_ms", F.lit(0)).cast("long")
    out = runs.join(d, "document_id").withColumn("queue_time_ms", elapsed_ms(F.col("enqueued_at"), F.col("started_at")))
    chunks = F.coalesce(F.nullif("total_chunks", F.lit(0)), "n_chunks").cast("long")
    return out.withColumns({"total_time_ms": total, "user_wait_time_ms": F.col("queue_time_ms") + total, "total_chunks": chunks}).drop("n_chunks")


def upsert_points(points: DataFrame | None, chunks: DataFrame) -> DataFrame:
    """The vector table after chunks were put in: one point an id, with what a search returns."""
    payload = F.struct("content", "document_id", "quality_score", "quality_flags", "chunk_type", "chunk_index", "breadcrumbs", "token_count")
    return merged(points, chunks.select("id", F.col("dense_vector").alias("dense"), "sparse_indices", "sparse_values", payload.alias("payload")), "id")


def delete_points(points: DataFrame, ids: list | None = None, document_id=None) -> DataFrame:
    """The vector table without some ids, or a document's points."""
    if ids:
        points = points.where(~F.col("id").isin(ids))
    return points if document_id is None else points.where(~F.col("payload.document_id").eqNullSafe(F.lit(document_id)))


def valid_vector(dense: Column, indices: Column, values: Column, size: int = 384) -> Column:
    """A dense vector of the right length and sparse arrays that aren't empty."""
    return F.coalesce((F.size(dense) == size) & (F.size(indices) > 0) & (F.size(values) > 0), F.lit(False))


def sync_batch(chunks: DataFrame, batch: DataFrame, size: int = 384) -> tuple[DataFrame, DataFrame]:
    """(chunks, points to put in) after one outbox batch of waiting chunks: valid ones are synchronised and their vectors cleared; if the batch
    has none, all of it counts as synchronised; invalid ones of a mixed batch go on waiting."""
    ok = valid_vector(F.col("dense_vector"), F.col("sparse_indices"), F.col("sparse_values"), size)
    marked = batch.select("id", ok.alias("ok"))
    any_ok = marked.agg(F.coalesce(F.bool_or("ok"), F.lit(False)).alias("any_ok"))
    x = chunks.join(F.broadcast(marked.join(F.broadcast(any_ok))), "id", "left")  # a batch of at most some hundreds
    done = F.coalesce(F.col("ok") | ~F.col("any_ok"), F.lit(False))
    return _cleared(x, done, F.coalesce("ok", F.lit(False)), chunks), batch.where(ok)


def synchronised(chunks: DataFrame, marked: DataFrame) -> DataFrame:
    """``chunks`` after those of ``marked`` (id, _ok) were synchronised; the vectors of those that are ok are cleared."""
    x = chunks.join(marked, "id", "left")
    return _cleared(x, F.col("_ok").isNotNull(), F.coalesce("_ok", F.lit(False)), chunks)


def _cleared(x: DataFrame, done: Column, clear: Column, chunks: DataFrame) -> DataFrame:
    out = x.withColumn("sync_status", F.when(done, "SYNCED").otherwise(F.col("sync_status")))
    for c in ("dense_vector", "sparse_indices", "sparse_values"):
        out = out.withColumn(c, F.when(clear, F.array().cast(dict(chunks.dtypes)[c])).otherwise(F.col(c)))
    return out.select(*chunks.columns)


def waiting(chunks: DataFrame, size: int = 100, document_id=None) -> DataFrame:
    """The next outbox batch: waiting chunks, of one document or of all, by id."""
    rows = chunks.where(F.col("sync_status") == "PENDING")
    rows = rows if document_id is None else rows.where(F.col("document_id") == F.lit(document_id))
    return rows.orderBy("id").limit(size)


def give_up(chunks: DataFrame, document_id=None) -> DataFrame:
    """What still waits after the last attempt has failed."""
    hit = (F.col("sync_status") == "PENDING") & (F.lit(True) if document_id is None else F.col("document_id") == F.lit(document_id))
    return chunks.withColumn("sync_status", F.when(hit, "FAILED").otherwise(F.col("sync_status")))
