"""Keyed tables in buckets: a change rewrites the buckets of its keys, and readers see one whole version.

Rows are dealt by hash of a column over a fixed number of buckets. A change writes new files of its buckets only, into a folder of its own; the marker of
a version, written last, says which folder holds each bucket. So a writer that fails at any point leaves the version before in place,
a reader keeps the version it began with, and what a change costs grows with its buckets, not with the table. Folders that no kept version
names are deleted after a write (and by ``clean``, those that failed writers left). One writer at a time, as ``foreachBatch`` gives.

A bucket should be some hundred MB: ``buckets`` is fixed when a table is first written. Within a write, buckets of many rows are split over files and
small ones put together (a rebalancing exchange), so a key of very many rows needs no task of its own size.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.sinks.tables import merged, replaced

BUCKET = "_bucket"


class BucketTable:
    def __init__(self, spark: SparkSession, path: str, by: str, buckets: int = 64, keep: int = 2):
        self.spark, self.path, self.by, self._buckets, self.keep = spark, path.rstrip("/"), by, buckets, max(1, keep)
        self._jpath = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._jpath(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _list(self, folder: str) -> list[str]:
        at = self._jpath(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def versions(self) -> list[str]:
        """Names of whole versions, oldest first."""
        return [n for n in self._list("_versions") if not n.startswith((".", "_"))]

    def manifest(self, version: str | None = None) -> dict | None:
        """{buckets, schema, at: folder of each bucket that has rows} of a version, the last by default."""
        version = version or (self.versions() or [None])[-1]
        if version is None:
            return None
        reader = self.fs.open(self._jpath(f"{self.path}/_versions/{version}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(reader, "UTF-8"))
        finally:
            reader.close()

    def bucket(self, column: str | Column | None = None, buckets: int | None = None) -> Column:
        return F.pmod(F.xxhash64(self.by if column is None else column), F.lit(buckets or self._count())).cast("int")

    def _count(self) -> int:
        now = self.manifest()
        return now["buckets"] if now else self._buckets

    def _rows(self, now: dict, only: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(now["schema"])
        folders = [f"{self.path}/{f}/{BUCKET}={b}" for b, f in sorted(now["at"].items()) if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, only: list[int] | None = None) -> DataFrame | None:
        """All rows, or those of some buckets; None before the first write."""
        now = self.manifest()
        return self._rows(now, only) if now else None

    def write(self, df: DataFrame) -> None:
        """Makes ``df`` the whole table. It may be derived from what the table holds now."""
        self._commit(df, None)

    def change(self, keys: DataFrame, make: Callable[[DataFrame | None], DataFrame]) -> list[int]:
        """Rewrites the buckets of ``keys`` (column ``by``) as ``make`` of their rows (None before the first write), which must stay within them. Returns them."""
        now = self.manifest()
        touched = sorted(r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect())  # at most as many as there are buckets
        if touched:
            self._commit(make(None if now is None else self._rows(now, touched)), touched)
        return touched

    def replace(self, rows: DataFrame, key: str | None = None, keys: DataFrame | None = None) -> list[int]:
        """All rows of the keys of ``rows`` (and of ``keys``) go, ``rows`` come. The key is ``by``, or another that settles it and that ``keys`` holds too."""
        asked = rows.select(self.by) if keys is None else rows.select(self.by).unionByName(keys.select(self.by))
        return self.change(asked, lambda stored: replaced(stored, rows, key or self.by, keys))

    def merge(self, rows: DataFrame, *key: str) -> list[int]:
        """``rows`` take the place of those of the same key, the others are added."""
        return self.change(rows, lambda stored: merged(stored, rows, *(key or (self.by,))))

    def _commit(self, df: DataFrame, touched: list[int] | None) -> None:
        now, name = self.manifest(), f"v-{uuid.uuid4().hex}"
        n = now["buckets"] if now else self._buckets
        placed = df.withColumn(BUCKET, self.bucket(buckets=n))
        placed.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{name}")
        made = {x.split("=", 1)[1] for x in self._list(name) if x.startswith(f"{BUCKET}=")}
        if touched is not None and not made <= {str(b) for b in touched}:
            self.fs.delete(self._jpath(f"{self.path}/{name}"), True)
            raise ValueError("a change may only write the buckets of its keys")
        held = {} if touched is None or not now else {b: f for b, f in now["at"].items() if int(b) not in touched}
        schema = json.loads(df.schema.json())
        if held and {f["name"]: f["type"] for f in now["schema"]["fields"]} != {f["name"]: f["type"] for f in schema["fields"]}:
            # columns that came in with a change are null elsewhere; a type never changes
            known = {f["name"]: f for f in schema["fields"]}
            clash = [f["name"] for f in now["schema"]["fields"] if f["name"] in known and known[f["name"]]["type"] != f["type"]]
            if clash:
                self.fs.delete(self._jpath(f"{self.path}/{name}"), True)
                raise ValueError(f"other types than the table's: {clash}")
            schema["fields"] = [*now["schema"]["fields"], *[f for f in schema["fields"] if f["name"] not in {x["name"] for x in now["schema"]["fields"]}]]
        for f in schema["fields"]:
            f["nullable"] = True
        self._mark(json.dumps({"buckets": n, "schema": schema, "at": held | dict.fromkeys(made, name)}))
        self.clean()

    def _mark(self, manifest: str) -> None:
        """Writes the marker under another name and renames it, so it is there whole or not at all."""
        whole = self.versions()
        turn = int(whole[-1].split(".")[0]) + 1 if whole else 0
        name = f"{turn:012d}.{uuid.uuid4().hex}"
        self.fs.mkdirs(self._jpath(f"{self.path}/_versions"))
        half = self._jpath(f"{self.path}/_versions/.{name}")
        out = self.fs.create(half, False)
        try:
            out.write(bytearray(manifest.encode()))
        finally:
            out.close()
        if not self.fs.rename(half, self._jpath(f"{self.path}/_versions/{name}")):
            raise OSError("the marker couldn't be renamed")

    def clean(self) -> None:
        """Deletes versions beyond ``keep`` and the folders that none of the others names."""
        whole = self.versions()
        for old in whole[: -self.keep]:
            self.fs.delete(self._jpath(f"{self.path}/_versions/{old}"), False)
        used = {f for v in whole[-self.keep :] for f in self.manifest(v)["at"].values()}
        for folder in self._list(""):
            if folder.startswith("v-") and folder not in used:
                self.fs.delete(self._jpath(f"{self.path}/{folder}"), True)
