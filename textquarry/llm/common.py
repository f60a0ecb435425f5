"""Helpers the training-data operators share: storage, sampling, hashing of spans."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zlib

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark runs in one
    process (tests). On a cluster a folder of this machine would lose data, so there it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        where = spark.conf.get("textquarry.scratch", None)
        if not where:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            where = "file://" + tempfile.mkdtemp(prefix="textquarry-")
            spark.conf.set("textquarry.scratch", where)
    return where


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Rows and bytes of an Arrow batch: long texts, and pairs of them, mustn't fill a worker. Smaller settings of the session stay.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch limits to BATCH. Spark has them by session only, so later queries of the session get them too; they
    change no result."""
    for name, most in BATCH.items():
        now = spark.conf.get(name, None)
        now = int(now) if now and now.isdigit() else 0
        if not 0 < now <= most:
            spark.conf.set(name, str(most))


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    bound_batches(spark)
    at = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes the folders of tables that ``materialise`` wrote, once nothing reads them any more."""
    for df in tables:
        for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(top)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(columns: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, with underscores added until none clashes with ``columns`` (whatever the case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_columns(df: DataFrame, added: str, make: Callable[[], Callable[[pa.RecordBatch], list]], drop: Iterable[str] = ()) -> DataFrame:
    """``df`` without ``drop`` and with the columns ``added`` (DDL) at the end, worked out a batch at a time in Python.

    ``make()`` runs once a task; what it gives takes a batch and returns the values of each added column. The other columns pass as
    Arrow arrays, so nulls and whole numbers beyond 2^53 stay what they are.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kept = [n for n in df.columns if n not in set(drop)]
    new = T.StructType.fromDDL(added).fields
    types, names = [to_arrow_type(f.dataType) for f in new], [*kept, *[f.name for f in new]]

    def run(batches):
        work = make()
        for b in batches:
            values = work(b)
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in kept], *[pa.array(v, t) for v, t in zip(values, types, strict=True)]], names=names)

    return df.mapInArrow(run, T.StructType([*[df.schema[n] for n in kept], *new]))


#: A key with more rows than HOT_ROWS and than one part in HOT_KEYS of all rows is dealt over HOT_SALTS; so there are fewer than HOT_KEYS.
HOT_ROWS, HOT_KEYS, HOT_SALTS = 100, 20_000, 64


def some(df: DataFrame) -> DataFrame | None:
    """``df``, or None if it has no row."""
    return None if df.isEmpty() else df


def hot_keys(counts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """The keys (one column) that hold too many of ``total`` rows for one task; fewer than HOT_KEYS rows."""
    return counts.where(F.col(n) > max(HOT_ROWS, total // HOT_KEYS)).select(key)


def dealt_join(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame | None, by: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` (one row a key) on ``key``. Rows of ``hot`` keys are dealt over salts by a hash of ``by``, and the table's
    row is copied to each salt; ``hot`` is broadcast, as hot_keys() bounds it. None: no key is hot, and the join is a plain one."""
    if hot is None:
        return rows.join(table, key, how)
    salt, mark = fresh({*rows.columns, *table.columns}, "salt", "mark")
    marked = F.broadcast(hot.select(key, F.lit(True).alias(mark)))
    left = rows.join(marked, key, "left").withColumn(salt, F.when(F.col(mark), F.pmod(F.xxhash64(by), F.lit(HOT_SALTS)).cast("int")).otherwise(0)).drop(mark)
    copies = F.when(F.col(mark), F.sequence(F.lit(0), F.lit(HOT_SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = table.join(marked, key, "left").withColumn(salt, F.explode(copies)).drop(mark)
    return left.join(right, [key, salt], how).drop(salt)


def whole_text(col: str | Column = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def trainable(doc_id: str | Column = "doc_id") -> Column:
    """True for the rows that models may learn from: crc32(doc_id as text) mod 3 is not 1."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary")) % 3 != 1


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(~trainable(doc_id), F.lit(False))


def open_fs(uri: str):
    """A pyarrow file system and path for a Hadoop-style address, so that Python tasks reach the same store as Spark."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)


def crc(data) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values evenly."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[[*range(48, 58), *range(97, 123), 95]] = True
_WORD_BYTE[128:] = True


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word of the lower-cased text, in order. Words: runs of letters, digits, ``_`` and non-ASCII."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(raw):
        return np.empty(0, dtype=np.uint64)
    inside = _WORD_BYTE[raw]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    # position inside its word is the exponent, so equal words hash alike wherever they stand
    lengths = end - start
    kept = raw[inside]
    offsets = np.arange(len(kept), dtype=np.int64) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    values = mix64(_BYTE_CODES[kept] + offsets.astype(np.uint64) * _BASE)
    sums = np.add.reduceat(values, np.cumsum(lengths) - lengths)
    return mix64(sums + lengths.astype(np.uint64))


def shingle_hashes(text: str, k: int = 5) -> np.ndarray:
    """Hashes of each run of ``k`` words; a text of fewer words is one shingle, of none is none."""
    words = word_hashes(text)
    if not len(words):
        return words
    if len(words) < k:
        k = len(words)
    out = np.zeros(len(words) - k + 1, dtype=np.uint64)
    for j in range(k):
        out = mix64(out * np.uint64(31) + words[j : j + len(out)])
    return out
