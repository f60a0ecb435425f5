"""The queue as state, results joined as streams, and schedules."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from textquarry.streaming import jobs, queues, schedules

EVENT = "id string, kind string, ok boolean, error string, ts timestamp"


@pytest.fixture
def state_store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, jobs.PROVIDER)
    yield
    spark.conf.set(name, before)


def stream(spark, tmp_path, name, schema, batches):
    """A file stream that takes one batch after another."""
    at = tmp_path / name
    at.mkdir()
    for i, rows in enumerate(batches):
        f = at / f"{i:04d}.json"
        f.write_text("\n".join(map(json.dumps, rows)))
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))  # the source takes them in this order
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"file://{at}")


def drained(df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"file://{tmp_path}/{name}-check").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def at(seconds):
    return (datetime(2024, 1, 1) + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%S.000Z")


BASE = int(datetime(2024, 1, 1).timestamp()) * 1000


def event(key, kind, seconds, ok=None, error=None):
    return {"id": key, "kind": kind, "ok": ok, "error": error, "ts": at(seconds)}


def test_a_failed_job_fires_again_and_vanishes(spark, tmp_path, state_store):
    tick = lambda s: [event("clock", "tick", s)]
    batches = [
        [event("a", "enqueue", 0), event("b", "enqueue", 0), event("c", "enqueue", 1)],
        [event("a", "outcome", 2, False, "fetch failed"), event("b", "outcome", 2, False, "CORRUPT_FILE"), event("c", "outcome", 3, True)],
        tick(8), tick(9),  # a is due again at 7
        [event("a", "outcome", 10, False, "ECONNREFUSED CORRUPT_FILE")],
        tick(25), tick(26),  # and at 20
        [event("a", "outcome", 30, False, "ETIMEDOUT")],
        [event("c", "enqueue", 40)],  # still kept
        tick(3700), tick(3701),  # c is forgotten after an hour
        [event("c", "enqueue", 3800)],
        tick(90_000), tick(90_001), tick(90_002),
    ]
    got = drained(jobs.job_stream(stream(spark, tmp_path, "in", EVENT, batches)), tmp_path, "queue")
    said = sorted((r.id, r.at_ms - BASE, r.event, r.attempt) for r in got)
    assert said == sorted([
        ("a", 0, "run", 1), ("a", 7000, "run", 2), ("a", 20000, "run", 3), ("a", 30000, "failed", 3), ("a", 86_430_000, "forgotten", 3),
        ("b", 0, "run", 1), ("b", 2000, "failed", 1), ("b", 86_402_000, "forgotten", 1),
        ("c", 1000, "run", 1), ("c", 3000, "completed", 1), ("c", 3_603_000, "forgotten", 1), ("c", 3_800_000, "run", 1),
    ])
    table = spark.createDataFrame([e for b in batches for e in b], "id string, kind string, ok boolean, error string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    fold = jobs.fold_jobs(table, BASE + 90_001_000)
    assert sorted((r.id, r.at_ms - BASE, r.event, r.attempt) for r in fold.collect()) == said


def test_batches_dont_matter(spark, tmp_path, state_store):
    """Events dealt into batches at random, in the order of time, give what the fold gives."""
    rng = random.Random(3)
    events = [event(f"j{rng.randrange(12)}", rng.choice(["enqueue", "outcome", "outcome"]), s, rng.random() < 0.3, rng.choice(["fetch failed", "CORRUPT_FILE", "x"])) for s in sorted(rng.sample(range(120), 80))]
    events.append(event("clock", "tick", 100_000))
    batches, i = [], 0
    while i < len(events):
        n = rng.randrange(1, 25)
        batches.append(events[i : i + n])
        i += n
    batches += [[event("clock", "tick", 100_001)], [event("clock", "tick", 100_002)]]
    got = drained(jobs.job_stream(stream(spark, tmp_path, "in", EVENT, batches)), tmp_path, "dealt")
    table = spark.createDataFrame([e for b in batches for e in b], "id string, kind string, ok boolean, error string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    want = jobs.fold_jobs(table, BASE + 100_001_000).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and {"run", "completed", "failed", "forgotten"} == {r.event for r in got}


RESULT = "document_id long, ts timestamp, success boolean, content string"


def test_results_join_their_jobs(spark, tmp_path):
    job = lambda i, s: {"id": i, "ts": at(s)}
    result = lambda i, s, ok=True, c="text": {"document_id": i, "ts": at(s), "success": ok, "content": c}
    started = [[job(1, 0), job(2, 0), job(3, 10), job(4, 20)], [job(5, 100)], [job(98, 9000)], [job(99, 20_000)], [job(97, 20_001)]]
    ended = [[result(1, 5), result(2, 7, False, None), result(77, 8)], [result(1, 9, True, "again"), result(5, 130)], [result(4, 8000)], [result(97, 20_000)], [result(99, 20_001)]]
    df = jobs.joined_results(stream(spark, tmp_path, "jobs", "id long, ts timestamp", started), stream(spark, tmp_path, "results", RESULT, ended))
    show = lambda rows: {(r.id, r.success, r.content, r.reason) for r in rows if r.id < 90}
    want = {(1, True, "text", None), (2, False, None, None), (3, False, None, jobs.LOST), (4, False, None, jobs.LOST), (5, True, "text", None)}
    got = drained(df, tmp_path, "joined")
    assert show(got) == want and len([r for r in got if r.id < 90]) == 5
    tables = [spark.createDataFrame([x for b in rows for x in b], schema.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp")) for rows, schema in ((started, "id long, ts timestamp"), (ended, RESULT))]
    assert show(jobs.joined_results(*tables).collect()) == want


CRONS = ["* * * * *", "*/15 * * * *", "30 9-17 * 2 1-5", "0 12 * * 7", "0 0 29 2 *", "5,10 0 1 jan,JUL *", "0 3 * * sun", "0 3 * * Fri-Mon", "59 23 31 * *", "7/20 */5 * * *", "0 0 1-7 * mon", "15 14 1 * *", "0 22 * feb-april 1-5", "0 9 13 * fri"]


@pytest.mark.parametrize("cron", CRONS)
def test_firings_equal_a_scan(cron):
    """Every minute around some times, some of them at ends of months and years."""
    for start in (datetime(2024, 2, 28, 23, 50), datetime(2023, 12, 31, 23, 58), datetime(2024, 7, 1)):
        minutes = [start + timedelta(minutes=i) for i in range(60 * 24 * 45)]
        hits = [t for t in minutes if schedules.matches(cron, t)]
        for t in (minutes[0], minutes[777], minutes[20_000], minutes[-2]):
            after, before = [h for h in hits if h > t], [h for h in hits if h <= t]
            got = schedules.next_firing(cron, t), schedules.last_firing(cron, t)
            assert (got[0] == after[0]) if after else got[0] is None or got[0] > minutes[-1]
            assert (got[1] == before[-1]) if before else got[1] is None or got[1] < minutes[0]


def test_schedules():
    sunday = datetime(2024, 2, 4, 12, 0)
    for cron, want in (("0 12 * * 7", True), ("0 12 * * 0", True), ("0 12 * feb sun", True), ("0 12 * February SUNDAY", True), ("0 12 * * 5-7", True), ("0 12 * * sat-mon", True), ("0 12 * * 1-6", False), ("* * * *", False), ("60 * * * *", False), ("0 12 0 * *", False), ("*/0 * * * *", False), ("a * * * *", False), ("0 12 * 3 *", False), ("5-1 * * * *", False), ("", False), ("0 12 * * 8", False)):
        assert schedules.matches(cron, sunday) == want, cron
    assert schedules.next_firing("0 0 30 2 *", sunday) is None and schedules.last_firing("0 0 30 2 *", sunday) is None
    assert schedules.next_firing("0 0 29 2 *", datetime(2096, 3, 1)) == datetime(2104, 2, 29)
    assert schedules.next_firing("* * * * *", datetime(9999, 12, 31, 23, 59)) is None


def test_tables_of_schedules(spark):
    now = datetime(2024, 2, 4, 12, 0)
    rows = spark.createDataFrame([(i, c, i % 5 != 4, now - timedelta(hours=i)) for i, c in enumerate(CRONS)] + [(50, None, True, now), (51, "bad", True, now), (52, "0 * * * *", True, None)], "id long, cron string, enabled boolean, last_run timestamp")
    got = {r.id: r for r in schedules.firings(rows, now).collect()}
    for i, c in enumerate(CRONS):
        assert (got[i].due, got[i].next_at, got[i].last_at) == (schedules.matches(c, now), schedules.next_firing(c, now), schedules.last_firing(c, now))
    assert not got[50].due and got[50].next_at is None and got[51].last_at is None
    assert {r.id for r in queues.cron_due(rows, "2024-02-04 12:00:00").collect()} == {i for i, c in enumerate(CRONS) if i % 5 != 4 and schedules.matches(c, now)} | {52}
    late = {r.id: r.missed_at for r in schedules.missed(rows, now).collect()}
    assert late == {i: schedules.last_firing(c, now) for i, c in enumerate(CRONS) if (schedules.last_firing(c, now) or datetime.min) > now - timedelta(hours=i)}
