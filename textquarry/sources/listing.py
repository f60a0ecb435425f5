"""Folders and change feeds as frames: what is there, and what changed since the last look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.sources.detect import ENDINGS, MIME, detect_format

#: Fixed value: the media type of a folder.
FOLDER = "application/vnd.google-apps.folder"


def supported(mime: Column, trashed: Column) -> Column:
    """Whether a remote entry is a file that can be read, or a folder; trashed ones aren't."""
    return F.coalesce(~trashed & (mime.isin(*MIME) | (mime == FOLDER)), F.lit(False))


def listing(entries: DataFrame) -> DataFrame:
    """The readable files among remote entries (id, name, mime_type, trashed, ...)."""
    return entries.where(supported(F.col("mime_type"), F.col("trashed")) & (F.col("mime_type") != FOLDER))


def scan_folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, format, size, modified) of all files below a folder that can be read. Contents aren't read: the column is pruned."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    out = files.select("path", name.alias("name"), detect_format(F.lit(None).cast("string"), name).alias("format"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return out.where(F.col("format").isin(*set(ENDINGS.values())))


CHANGE = "file_id string, removed boolean, name string, mime_type string, md5 string, seq long"


def change_feed(spark: SparkSession, path: str, clean: str | None = None) -> DataFrame:
    """A stream of changes, as JSON lines that land in a folder. The checkpoint is the token; with ``trigger(availableNow=True)`` a run ends when
    the feed does. ``clean``: delete source files once they are done with."""
    reader = spark.readStream.schema(CHANGE)
    return (reader.option("cleanSource", clean) if clean else reader).json(path)


def relevant(changes: DataFrame) -> DataFrame:
    """Changes that say something: removals, and files whose format can be read."""
    return changes.where(F.col("removed") | detect_format(F.col("mime_type"), F.col("name")).isNotNull())
