"""Queues, the outbox and the event bus as Structured Streaming: state is in tables, offsets in checkpoints, retries are rows."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from textquarry.operators.lifecycle import apply_changes, back_off_ms, failed_for_good
from textquarry.sinks.buckets import BucketTable
from textquarry.sinks.tables import KeyedTable, synchronised, upsert_points, valid_vector
from textquarry.streaming.schedules import firings

#: Kinds of events that subscribers may ask for.
EVENT_TYPES = (
    "document:created", "document:status", "document:availability", "document:deleted", "document:retry", "bulk:completed", "driveFolder:deleted",
    "sync:start", "sync:complete", "sync:error", "sync:progress",
)


def run_available(df: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """All that is there now, batch by batch, exactly one batch at a time; a batch that fails runs again from the checkpoint."""
    return df.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def attempts(jobs: DataFrame, outcomes: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """(jobs that go on waiting, jobs that are over) after outcomes (id, ok, error) came in for some of the jobs (id, attempts, not_before).
    A failure waits exponentially longer, a permanent one or the last is final."""
    x = jobs.join(outcomes, "id", "left")
    n = F.col("attempts") + F.when(F.col("ok").isNotNull(), 1).otherwise(0)
    final = F.when(F.col("ok"), "completed").when(F.col("ok").isNotNull() & failed_for_good(F.col("error"), n), "failed")
    y = x.select("id", n.alias("attempts"), F.when(F.col("ok").isNotNull(), F.lit(now_ms) + back_off_ms(n)).otherwise(F.col("not_before")).alias("not_before"), "error", final.alias("state"))
    return y.where("state IS NULL").select("id", "attempts", "not_before"), y.where("state IS NOT NULL").select("id", "attempts", "state", "error")


def due(jobs: DataFrame, now_ms: int) -> DataFrame:
    return jobs.where(F.col("not_before") <= now_ms)


def retain(done: DataFrame, now_ms: int, most: int = 1000) -> DataFrame:
    """Jobs that are over and still kept: completed ones for an hour, the last ``most`` of them; failed ones for a day."""
    age = F.lit(now_ms) - F.col("finished_ms")
    kept = done.where((F.col("state") == "completed") & (age <= 3_600_000)).orderBy(F.desc("finished_ms"), "id").limit(most)
    return kept.unionByName(done.where((F.col("state") == "failed") & (age <= 86_400_000)))


def outbox_end(invalid: list[int], waiting_rows: int, size: int) -> tuple[int, int, int]:
    """(batches, end, given up): how far batches of ``size`` waiting chunks come. ``invalid``: places of the first invalid ones among the waiting, in order, at
    least ``size`` of them or all. Each batch takes the invalid ones that are left from before and as many of the next as it has room
    for; one without a valid chunk is the last, and all of it counts as done. Chunks up to ``end`` were taken, ``given up`` invalid ones."""
    batches = end = left = 0
    while left or end < waiting_rows:
        room = min(size - left, waiting_rows - end)
        bad = bisect_left(invalid, end + room) - bisect_left(invalid, end)
        batches += 1
        if bad == room:
            return batches, end + room, left + room
        nxt = bisect_left(invalid, end)
        clear = ((invalid[nxt] if nxt < len(invalid) else waiting_rows) - end) // room  # whole batches up to the next invalid one
        if clear > 1:
            batches += clear - 1
            end += clear * room
        else:
            left += bad
            end += room
    return batches, end, 0


def drain_outbox(chunks: KeyedTable | BucketTable, points: KeyedTable | BucketTable, size: int = 100, dense: int = 384, document_id=None) -> int:
    """Puts waiting chunks into the vector table until none waits or a batch of ``size`` had nothing valid, as if batch after batch; returns the number of
    batches. All of them are one pass: where it ends follows from the places of the first invalid chunks, ``size`` at most. One
    write of either table, in the buckets of those chunks only. Points are keyed by chunk and written first, so a pass that ran halfway does
    no harm when it runs again."""
    stored = chunks.read()
    if stored is None:
        return 0
    rows = stored.where(F.col("sync_status") == "PENDING")
    rows = rows if document_id is None else rows.where(F.col("document_id") == F.lit(document_id))
    ok = valid_vector(F.col("dense_vector"), F.col("sparse_indices"), F.col("sparse_values"), dense)
    bad = [r["id"] for r in rows.where(~ok).select("id").orderBy("id").limit(size).collect()]
    below = [F.count_if(F.col("id") < F.lit(i)).alias(str(j)) for j, i in enumerate(bad)]  # the place of each
    n, *places = rows.agg(F.count(F.lit(1)).alias("n"), *below).first()
    batches, end, given_up = outbox_end(list(places), n, size)
    if not batches:
        return 0
    taken = rows
    if end < n:
        # chunks behind the end: it lies less than a batch behind the last invalid one that counts
        lead = max((j for j, at in enumerate(places) if at < end), default=0)
        edge = rows.where(F.col("id") >= F.lit(bad[lead])).select("id").orderBy("id").limit(end - places[lead] + 1).collect()[-1]["id"]
        taken = rows.where(F.col("id") < F.lit(edge))
    valid = taken.where(ok)
    last = F.col("id") <= F.lit(bad[given_up - 1]) if given_up else F.lit(False)
    done = valid.select("id", chunks_by(chunks), F.lit(True).alias("_ok")).unionByName(taken.where(~ok & last).select("id", chunks_by(chunks), F.lit(False).alias("_ok")))
    if not valid.isEmpty():
        change(points, upsert_points(None, valid), lambda old: upsert_points(old, valid))
    change(chunks, done, lambda old: synchronised(old, done.select("id", "_ok")))
    return batches


def chunks_by(table: KeyedTable | BucketTable) -> Column:
    """The column that deals a chunk table over buckets; any, where there are none."""
    return F.col(getattr(table, "by", "document_id")) if getattr(table, "by", "") != "id" else F.col("document_id")


def change(table: KeyedTable | BucketTable, keys: DataFrame, make: Callable[[DataFrame | None], DataFrame]) -> None:
    """A change of the buckets of ``keys``, or of a whole table without buckets."""
    if isinstance(table, BucketTable):
        table.change(keys, make)
    else:
        table.write(make(table.read()))


def apply_feed(table: KeyedTable | BucketTable) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` over a change feed: the document table after each batch. In a table with buckets by ``drive_file_id`` only those of the
    batch's files are read and written."""

    def work(changes: DataFrame, _: int) -> None:
        if changes.isEmpty() or table.read() is None:
            return
        change(table, changes.select(F.col("file_id").alias("drive_file_id")), lambda stored: apply_changes(stored, changes)[0])

    return work


def publish(subscribers: dict[str, tuple[tuple[str, ...], Callable[[DataFrame], None]]]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each subscriber gets the events of its kinds; one that fails doesn't keep the others from theirs. Nothing is kept for
    those who come later."""

    def work(batch: DataFrame, _: int) -> None:
        failed = []
        for name, (kinds, take) in subscribers.items():
            try:
                take(batch.where(F.col("type").isin(*kinds)))
            except Exception as e:
                failed.append(f"{name}: {e}")
        if failed:
            raise RuntimeError("; ".join(failed))

    return work


def known_events(events: DataFrame) -> DataFrame:
    return events.where(F.col("type").isin(*EVENT_TYPES))


def event_column() -> Column:
    """An event (type, payload, timestamp) as a block of a text/event-stream: ``event`` and ``data``."""
    return F.concat(F.lit("event: "), F.col("type"), F.lit("\ndata: "), F.to_json(F.struct("type", "payload", "timestamp")), F.lit("\n\n"))


def event_lines(events: DataFrame) -> DataFrame:
    return events.select(event_column().alias("value"))


def stream_events(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer of event lines as text files."""
    return event_lines(events).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint)


def cron_due(schedules: DataFrame, now: str) -> DataFrame:
    """Schedules (id, cron, enabled) that fire in the minute of ``now``. An outside scheduler, or a stream with a rate source, asks once a minute."""
    rows = firings(schedules.where("enabled"), datetime.fromisoformat(now))
    return rows.where("due").drop("due", "next_at", "last_at")
