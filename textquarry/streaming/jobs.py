"""The job queue as keyed state with timers, and results joined to jobs as a stream.

Queue: each job's state holds its attempts and when the next is due. Events (enqueue, outcome) come in event time; a failure that isn't final sets a timer for
its back-off, a job that is over one for its retention, and both fire as the watermark passes them. ``step`` is the whole rule, of one event and one state;
the batch fold and the stream run the same. An event that comes after a timer's time but before the watermark has fired it finds the state as
if it had fired, so results don't depend on how events fall into batches.

Results: jobs and results are joined within an interval of event time; results that come again within the watermark's delay count once, and a job without
one by the end of its time is failed by the join's outer side. Watermarks bound both sides' state.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from textquarry.operators.lifecycle import ATTEMPTS, BACK_OFF_MS, NETWORK, PERMANENT

#: How long jobs that are over are kept, by how they ended.
KEPT_MS = {"completed": 3_600_000, "failed": 86_400_000}
OUT = "id string, event string, attempt int, at_ms long"
STATE = "state string, attempts int, at_ms long"
#: What Spark must hold state in: timers need it.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Job:
    """``state``: active (an attempt runs), delayed (the next is due at ``at_ms``), completed or failed (forgotten at ``at_ms``)."""

    state: str
    attempts: int
    at_ms: int


Said = list[tuple[str, int, int]]  # event, attempt, time


def fired(job: Job | None, now_ms: int) -> tuple[Job | None, Said]:
    """The state after the timer it waits for, if that is due by ``now_ms``."""
    if job is None or job.state == "active" or job.at_ms > now_ms:
        return job, []
    if job.state == "delayed":
        return replace(job, state="active"), [("run", job.attempts + 1, job.at_ms)]
    return None, [("forgotten", job.attempts, job.at_ms)]


def step(job: Job | None, kind: str, ok: bool | None, error: str | None, at_ms: int) -> tuple[Job | None, Said]:
    """The state after an event, and what it says. Jobs that wait, run or are still kept aren't enqueued anew; outcomes of jobs that don't run are left out."""
    job, said = fired(job, at_ms)
    if kind == "enqueue" and job is None:
        return Job("active", 0, at_ms), [*said, ("run", 1, at_ms)]
    if kind != "outcome" or job is None or job.state != "active":
        return job, said
    n, message = job.attempts + 1, error or ""
    final = any(x in message for x in PERMANENT) and not any(x in message for x in NETWORK)
    if not ok and not final and n < ATTEMPTS:
        return Job("delayed", n, at_ms + BACK_OFF_MS * 2 ** (n - 1)), said
    end = "completed" if ok else "failed"
    return Job(end, n, at_ms + KEPT_MS[end]), [*said, (end, n, at_ms)]


def _rows(key: str, said: Said) -> pd.DataFrame:
    return pd.DataFrame([(key, *s) for s in said], columns=["id", "event", "attempt", "at_ms"])


class JobQueue(StatefulProcessor):
    def init(self, handle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE)

    def _load(self) -> Job | None:
        return Job(*self.job.get()) if self.job.exists() else None

    def _store(self, before: Job | None, job: Job | None) -> None:
        """The state, and one timer: the one it waits for."""
        if before is not None and before.state != "active" and (job is None or job.state == "active" or job.at_ms != before.at_ms):
            self.handle.deleteTimer(before.at_ms)
        if job is None:
            self.job.clear()
            return
        self.job.update((job.state, job.attempts, job.at_ms))
        if job.state != "active" and job != before:
            self.handle.registerTimer(job.at_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows))
        # an outcome at the time of its enqueueing comes after it
        events = events.assign(_first=events["kind"] != "enqueue").sort_values(["at_ms", "_first"], kind="stable")
        before = job = self._load()
        said: Said = []
        for r in events.itertuples(index=False):
            job, more = step(job, r.kind, None if pd.isna(r.ok) else bool(r.ok), None if pd.isna(r.error) else r.error, int(r.at_ms))
            said += more
        self._store(before, job)
        yield _rows(key[0], said)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before = self._load()
        job, said = fired(before, expiredTimerInfo.getExpiryTimeInMs())
        if job != before:
            # the timer that has fired is gone by itself
            if job is None:
                self.job.clear()
            else:
                self.job.update((job.state, job.attempts, job.at_ms))
        yield _rows(key[0], said)

    def close(self) -> None:
        pass


def job_stream(events: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """(id, event, attempt, at_ms) of a stream of events (id, kind: enqueue or outcome, ok, error, ts): run, completed, failed, forgotten. Needs the state store
    PROVIDER in the session."""
    rows = events.withWatermark("ts", delay).select(F.col("id").cast("string").alias("id"), "kind", "ok", "error", F.unix_millis("ts").alias("at_ms"), "ts")
    return rows.groupBy("id").transformWithStateInPandas(JobQueue(), OUT, "Append", "EventTime")


def fold_jobs(events: DataFrame, until_ms: int | None = None) -> DataFrame:
    """The same of a table: each job's events in order, then its timers up to ``until_ms``. A job's events are one group: its attempts are few, and events that
    change nothing of a hot job are folded one by one."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(_first=rows["kind"] != "enqueue").sort_values(["at_ms", "_first"], kind="stable")
        job, said = None, []
        for r in rows.itertuples(index=False):
            job, more = step(job, r.kind, None if pd.isna(r.ok) else bool(r.ok), None if pd.isna(r.error) else r.error, int(r.at_ms))
            said += more
        while until_ms is not None:
            job, more = fired(job, until_ms)
            said += more
            if not more:
                break
        return _rows(key[0], said)

    rows = events.select(F.col("id").cast("string").alias("id"), "kind", "ok", "error", F.unix_millis("ts").alias("at_ms"))
    return rows.groupBy("id").applyInPandas(run, OUT)


#: What a job without a result by the end of its time has failed for.
LOST = "NO_RESULT"


def joined_results(jobs: DataFrame, results: DataFrame, within: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Each job (id, ts) with its result (document_id, ts, success, ...): the first that comes within ``within`` of its start; others of the same document within
    the delay are left out, and so are those of no job. A job without one has success false and the reason LOST. Streams or tables: over streams
    a row appears once it is certain."""
    r = results.withWatermark("ts", delay)
    if results.isStreaming:
        r = r.dropDuplicatesWithinWatermark(["document_id"])
    else:
        rest = [c for c in results.columns if c != "document_id"]
        r = r.groupBy("document_id").agg(F.min_by(F.struct(*rest), F.struct("ts", F.xxhash64(*rest))).alias("x")).select("document_id", "x.*")
    j = jobs.withWatermark("ts", delay).withColumnRenamed("ts", "started")
    r = r.withColumnRenamed("ts", "ended")
    near = (F.col("id") == F.col("document_id")) & (F.col("ended") >= F.col("started")) & (F.col("ended") <= F.col("started") + F.expr(f"INTERVAL {within}"))
    lost = F.col("document_id").isNull()
    out = j.join(r, near, "left_outer")
    return out.withColumns({"success": F.when(lost, F.lit(False)).otherwise(F.col("success")), "reason": F.when(lost, F.lit(LOST))}).drop("document_id")
