"""CSV files of any size: read by splits, whose records are put together over the splits' edges.

A line end ends a record only outside quotes, and a split can't tell by itself whether it begins inside. So one pass counts the quotation marks of each split,
their running parity over a file's splits says how each begins, and a second pass joins lines to records: a task carries the open record of its
split, and what lies before a split's first record end (or after its last) is a piece that goes to the record begun before. Only pieces, at
most two a split, are shuffled. Marks are doubled inside quotes, as CSV has them, so their parity is all that counts.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.functions.batches import limit, parts

ROW = "path string, split long, line long, cells array<string>"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, split: where its split begins, line) of text files, each split's lines in order within one task."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("line"))


def parities(rows: DataFrame, quote: str = '"') -> DataFrame:
    """(path, split, inside, before): whether a split begins inside quotes, and the split before it. One row a split."""
    marks = F.length("line") - F.length(F.replace("line", F.lit(quote), F.lit("")))
    counted = rows.groupBy("path", "split").agg((F.sum(marks) % 2).alias("odd"))
    order = Window.partitionBy("path").orderBy("split")
    run = F.coalesce(F.sum("odd").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counted.select("path", "split", (run % 2 == 1).alias("inside"))


PIECE = "path string, split long, place long, text string, ends boolean, whole boolean"


def pieces(rows: DataFrame, known: DataFrame, quote: str = '"') -> DataFrame:
    """(path, split, place, text, ends, whole): whole records, and the pieces of those that cross a split's edge: one that ``ends`` there, or goes on."""
    # the order of lines in a task is that of the file, and a broadcast join keeps it; a row a split is some hundred bytes
    marked = rows.join(F.broadcast(known), ["path", "split"]).select("path", "split", "inside", "line")

    def run(batches):
        at, held, inside, place, first = None, [], False, 0, False
        for b in parts(batches):
            out: list[tuple] = []
            for path, split, begins, line in zip(*(b.column(c).to_pylist() for c in ("path", "split", "inside", "line")), strict=True):
                if (path, split) != at:
                    if held:
                        out.append((*at, place, "\n".join(held), False, False))
                    at, held, inside, place, first = (path, split), [], begins, 0, begins
                held.append(line)
                inside ^= line.count(quote) % 2 == 1
                if not inside:
                    out.append((*at, place, "\n".join(held), True, not first))
                    held, place, first = [], place + 1, False
            if out:
                yield _batch(out)
        if held:
            yield _batch([(*at, place, "\n".join(held), False, False)])

    def _batch(out):
        types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
        names = ["path", "split", "place", "text", "ends", "whole"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return marked.mapInArrow(run, PIECE)


def parsed(batches, delimiter: str = ",", quote: str = '"') -> Iterator[pa.RecordBatch]:
    """(path, split, line, cells) of (path, split, place, text) of records, blank ones left out."""
    csv.field_size_limit(1 << 31)  # a cell may be as long as its record; the library's own limit is 131,072
    for b in parts(batches):
        cells = [next(csv.reader(io.StringIO(t.removesuffix("\r"), newline=""), delimiter=delimiter, quotechar=quote), []) for t in b.column("text").to_pylist()]
        keep = pa.array([bool(c) for c in cells])
        made = pa.RecordBatch.from_arrays([b.column("path"), b.column("split"), b.column("place"), pa.array(cells, pa.list_(pa.string()))], names=["path", "split", "line", "cells"])
        yield made.filter(keep)


def records(spark: SparkSession, path: str, delimiter: str = ",", quote: str = '"') -> DataFrame:
    """(path, split, line, cells) of each record of CSV files, blank ones left out; (split, line) orders a file's. A mark that is never closed takes in the
    rest of its file."""
    limit(spark)
    rows = lines(spark, path)
    found = pieces(rows, parities(rows, quote), quote)
    whole = found.where("whole").select("path", "split", "place", "text")
    # a record over several splits begins with the last piece that nothing before leads into: after each piece that ends, a new one
    edges = found.where("NOT whole")
    order = Window.partitionBy("path").orderBy("split", "place")
    ended = F.coalesce(F.sum(F.col("ends").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = edges.withColumn("n", ended).groupBy("path", "n").agg(F.sort_array(F.collect_list(F.struct("split", "place", "text"))).alias("x"))
    joined = joined.select("path", F.col("x")[0]["split"].alias("split"), F.col("x")[0]["place"].alias("place"), F.array_join(F.transform("x", lambda p: p["text"]), "\n").alias("text"))

    return whole.unionByName(joined).mapInArrow(lambda batches: parsed(batches, delimiter, quote), ROW)
