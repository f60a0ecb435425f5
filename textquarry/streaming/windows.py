"""Event-time windows, rate limits and threshold alerts; the same functions serve batch and stream frames."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def over_limit(events: DataFrame, key: str, ts: str, limit: int, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Windows in which a key sent more than ``limit`` events."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    counted = rows.groupBy(F.window(ts, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") > limit).select(F.col("w.start").alias("window_start"), key, "n")


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    counted = rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def _count(count: int, start: int, at: int, span: int) -> tuple[int, int]:
    """A kind's counter after an event: it starts anew at the first event over ``span`` after its start."""
    return (1, at) if not count or at - start > span else (count + 1, start)


def threshold_alerts(events: DataFrame, kind: str, ts: str, threshold: int = 5, hours: float = 1.0) -> DataFrame:
    """An alert when a kind's count equals the threshold; the count starts anew at the first event over ``hours`` after its start. (count, start) of
    each kind is the only state: of a stream it is Spark's, over a table it goes along with the kind's sorted rows. Events without a time are
    left out."""
    span = int(hours * 3_600_000_000)
    rows = events.select(F.col(kind).alias("kind"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at")).where("at IS NOT NULL")
    schema = "kind string, at long, n int"

    def step(key, frames, state):
        count, start = state.get if state.exists else (0, 0)
        fired = []
        for at in sorted(x for f in frames for x in f["at"].tolist()):
            count, start = _count(count, start, at, span)
            if count == threshold:
                fired.append((key[0], at, count))
        state.update((count, start))
        yield pd.DataFrame(fired, columns=["kind", "at", "n"])

    if events.isStreaming:
        return rows.groupBy("kind").applyInPandasWithState(step, schema, "n int, start long", "append", "NoTimeout")

    def run(batches):
        now, count, start = None, 0, 0
        for b in batches:
            fired = []
            for k, at in zip(b.column("kind").to_pylist(), b.column("at").to_pylist(), strict=True):
                if k != now:
                    now, count, start = k, 0, 0
                count, start = _count(count, start, at, span)
                if count == threshold:
                    fired.append((k, at, count))
            columns = zip(*fired, strict=True) if fired else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32()), strict=True)], names=["kind", "at", "n"])

    return rows.withColumn("kind", F.col("kind").cast("string")).repartition("kind").sortWithinPartitions("kind", "at").mapInArrow(run, schema)
