"""The same functions over streams."""

import json

import pytest
from pyspark.sql import functions as F

from textquarry.plans import base
from textquarry.sinks.tables import KeyedTable
from textquarry.sources.listing import change_feed, relevant
from textquarry.streaming import queues, windows


def feed(tmp_path, name, rows):
    (tmp_path / "in").mkdir(exist_ok=True)
    (tmp_path / "in" / name).write_text("\n".join(map(json.dumps, rows)))


def drain(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_change_feed(spark, tmp_path):
    docs = spark.createDataFrame([(1, "f1", "COMPLETED", None, "a.txt", "m1", "text"), (2, "f2", "COMPLETED", None, "b.txt", "m2", "text")], "id long, drive_file_id string, status string, fail_reason string, filename string, md5_hash string, processed_content string")
    table = KeyedTable(spark, f"file://{tmp_path}/docs")
    table.write(docs)
    feed(tmp_path, "1.json", [{"file_id": "f1", "removed": True, "seq": 1}, {"file_id": "f2", "removed": False, "name": "c.md", "md5": "m3", "seq": 2}, {"file_id": "f3", "removed": False, "name": "x.zip", "seq": 3}])
    run = lambda: queues.run_available(relevant(change_feed(spark, f"file://{tmp_path}/in")), queues.apply_feed(table), f"file://{tmp_path}/check").awaitTermination()
    run()
    state = lambda: {r.id: (r.status, r.fail_reason, r.filename) for r in table.read().collect()}
    assert state() == {1: ("FAILED", "REMOVED_FROM_DRIVE", "a.txt"), 2: ("PENDING", None, "c.md")}
    run()  # the token stands: nothing is applied twice
    feed(tmp_path, "2.json", [{"file_id": "f1", "removed": False, "name": "a.txt", "md5": "m1", "seq": 4}])
    run()
    assert state()[1] == ("PENDING", None, "a.txt")


def test_outbox(spark, tmp_path):
    rows = [(i, i % 3, f"c{i}", "PENDING" if i % 4 else "SYNCED", [1.0, 2.0] if i % 5 else [1.0], [1], [0.5], 0.5, [], "document", i, [], 3) for i in range(25)]
    schema = "id long, document_id long, content string, sync_status string, dense_vector array<float>, sparse_indices array<int>, sparse_values array<float>, quality_score double, quality_flags array<string>, chunk_type string, chunk_index int, breadcrumbs array<string>, token_count int"
    chunks, points = KeyedTable(spark, f"file://{tmp_path}/c"), KeyedTable(spark, f"file://{tmp_path}/p")
    chunks.write(spark.createDataFrame(rows, schema))
    assert queues.drain_outbox(chunks, points, 10, 2) >= 2
    after = {r.id: r for r in chunks.read().collect()}
    assert {r.id for r in points.read().collect()} == {i for i in range(25) if i % 4 and i % 5}
    assert all(r.sync_status == "SYNCED" for r in after.values()) and all(not after[i].dense_vector for i in range(25) if i % 4 and i % 5)


def test_alerts(spark, tmp_path):
    at = lambda minutes: f"2024-01-01 {minutes // 60:02d}:{minutes % 60:02d}:00"
    events = [("a", at(m)) for m in (0, 1, 2, 3, 4, 5)] + [("a", at(m)) for m in (70, 71, 72, 73, 74)] + [("b", at(m)) for m in (0, 1, 2, 3)] + [("c", at(m)) for m in (0, 30, 61, 62, 63, 64)]
    rows = spark.createDataFrame(events, "kind string, at string").select("kind", F.col("at").cast("timestamp").alias("ts"))
    want = {("a", at(4)), ("a", at(74))}
    shown = lambda df: {(r.kind, r.t) for r in df.select("kind", F.date_format(F.timestamp_micros("at"), "yyyy-MM-dd HH:mm:ss").alias("t")).collect()}
    assert shown(windows.threshold_alerts(rows, "kind", "ts")) == want
    for part, chosen in (("1", events[:3] + events[11:]), ("2", events[3:11])):
        feed(tmp_path, f"{part}.json", [{"kind": k, "ts": t} for k, t in chosen])
    stream = spark.readStream.schema("kind string, ts timestamp").option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
    assert shown(drain(windows.threshold_alerts(stream, "kind", "ts"), tmp_path, "alerts")) == want


def test_rate_limit_and_sessions(spark, tmp_path, sf_dir="/root/testdata/sf0.001"):
    events = base.table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "user_id")
    events.repartition(2).write.parquet(f"file://{tmp_path}/e")
    stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/e")
    key = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    batch = windows.over_limit(events, "event_type", "ts", 1, "1 hour")
    got = drain(windows.over_limit(stream, "event_type", "ts", 1, "1 hour", late="60 days"), tmp_path, "limits", "complete")
    assert key(got, "window_start", "event_type", "n") == key(batch, "window_start", "event_type", "n") and batch.count() > 0
    batch = windows.sessions(events, "user_id", "ts")
    got = drain(windows.sessions(stream, "user_id", "ts", late="60 days"), tmp_path, "sessions", "complete")
    assert key(got, "user_id", "session_start", "n") == key(batch, "user_id", "session_start", "n")


def test_queue(spark):
    jobs = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (3, 2, 0), (4, 0, 9_000), (5, 0, 0)], "id long, attempts int, not_before long")
    assert {r.id for r in queues.due(jobs, 100).collect()} == {1, 2, 3, 5}
    outcomes = spark.createDataFrame([(1, True, None), (2, False, "ECONNRESET"), (3, False, "ECONNRESET"), (5, False, "CORRUPT_FILE")], "id long, ok boolean, error string")
    left, over = queues.attempts(jobs, outcomes, 1000)
    assert {(r.id, r.attempts, r.not_before) for r in left.collect()} == {(2, 2, 11_000), (4, 0, 9_000)}
    assert {(r.id, r.state) for r in over.collect()} == {(1, "completed"), (3, "failed"), (5, "failed")}
    hour = 3_600_000
    done = spark.createDataFrame([(1, "completed", 0), (2, "completed", hour), (3, "completed", 2 * hour), (4, "failed", 0), (5, "failed", -30 * hour)], "id long, state string, finished_ms long")
    assert {r.id for r in queues.retain(done, 2 * hour, 1).collect()} == {3, 4}


def test_events(spark, tmp_path):
    feed(tmp_path, "1.json", [{"type": "document:created", "payload": "1", "timestamp": "t"}, {"type": "sync:error", "payload": "2", "timestamp": "t"}, {"type": "odd", "payload": "3", "timestamp": "t"}])
    stream = spark.readStream.schema("type string, payload string, timestamp string").json(f"file://{tmp_path}/in")
    seen = {}

    def broken(_):
        raise ValueError("down")

    take = lambda name: lambda df: seen.setdefault(name, [r.payload for r in df.collect()])
    q = queues.run_available(queues.known_events(stream), queues.publish({"x": (("sync:error",), broken), "a": (("document:created",), take("a")), "b": (queues.EVENT_TYPES, take("b"))}), f"file://{tmp_path}/c1")
    with pytest.raises(Exception, match="x: down"):
        q.awaitTermination()
    assert seen == {"a": ["1"], "b": ["1", "2"]} or sorted(seen["b"]) == ["1", "2"]
    queues.stream_events(queues.known_events(stream), f"file://{tmp_path}/out", f"file://{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination()
    text = "".join(r.value + "\n" for r in spark.read.text(f"file://{tmp_path}/out").collect())
    assert 'event: document:created' in text and '"payload":"2"' in text and "odd" not in text
