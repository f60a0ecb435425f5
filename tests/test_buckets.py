"""Tables in buckets: what a change rewrites, what a failed one leaves, and the outbox and the feed over them."""

import json
import random

import pytest
from pyspark.sql import functions as F

from textquarry.sinks.buckets import BUCKET, BucketTable
from textquarry.sinks.tables import KeyedTable, merged, replaced, sync_batch, upsert_points, waiting
from textquarry.sources.listing import change_feed
from textquarry.streaming import queues

CHUNK = "id long, document_id long, content string, sync_status string, dense_vector array<float>, sparse_indices array<int>, sparse_values array<float>, quality_score double, quality_flags array<string>, chunk_type string, chunk_index int, breadcrumbs array<string>, token_count int"


def files(path):
    return {str(f.relative_to(path)) for f in path.rglob("part-*")}


def test_a_change_rewrites_its_buckets_only(spark, tmp_path):
    t = BucketTable(spark, f"file://{tmp_path}/t", "k", 16, keep=1)
    assert t.read() is None
    t.write(spark.range(500).selectExpr("id % 100 AS k", "id AS v"))
    before = files(tmp_path / "t")
    rows = spark.createDataFrame([(7, 1000), (7, 1001), (300, 1002), (None, 1003)], "k long, v long")
    want = sorted(map(tuple, replaced(t.read(), rows, "k").collect()), key=str)
    touched = t.replace(rows)
    assert 1 <= len(touched) <= 3 and sorted(map(tuple, t.read().collect()), key=str) == want
    after = files(tmp_path / "t")
    bucket = lambda f: int(f.split(f"{BUCKET}=")[1].split("/")[0])
    assert {bucket(f) for f in after - before} <= set(touched) and {bucket(f) for f in before - after} <= set(touched) and before & after
    assert t.read([touched[0]]).count() < t.read().count()
    more = spark.createDataFrame([(7, 5)], "k long, v long")
    t.merge(more)
    assert [r.v for r in t.read().where("k = 7").collect()] == [5] and t.read().count() == merged(t.read(), more, "k").count()


def test_failed_writers(spark, tmp_path, monkeypatch):
    t = BucketTable(spark, f"file://{tmp_path}/t", "k", 4)
    t.write(spark.range(20).selectExpr("id AS k", "id AS v"))
    one = spark.createDataFrame([(3, -1)], "k long, v long")
    whole = sorted(map(tuple, t.read().collect()))
    with monkeypatch.context() as m:  # between the files and the marker
        m.setattr(BucketTable, "_mark", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            t.merge(one)
    assert sorted(map(tuple, t.read().collect())) == whole and len(t.versions()) == 1
    with pytest.raises(Exception):  # amid the files
        t.merge(one.withColumn("v", F.raise_error(F.lit("no")).cast("long")))
    assert sorted(map(tuple, t.read().collect())) == whole
    old = t.read()
    t.merge(one)
    assert dict(map(tuple, t.read().collect()))[3] == -1
    assert sorted(map(tuple, old.collect())) == whole  # a reader keeps its version
    assert len([f for f in (tmp_path / "t").iterdir() if f.name.startswith("v-")]) == 2  # what the failed ones left is gone
    with pytest.raises(ValueError):
        t.change(one, lambda stored: spark.range(50).selectExpr("id AS k", "id AS v"))
    with pytest.raises(ValueError):
        t.merge(spark.createDataFrame([(3, 0.5)], "k long, v double"))
    t.merge(spark.createDataFrame([(3, 4, "new")], "k long, v long, w string"))
    assert {(r.k, r.w) for r in t.read().where("k in (2, 3)").collect()} == {(2, None), (3, "new")}
    t.change(spark.range(20).selectExpr("id AS k"), lambda stored: stored.where("k < 0"))
    assert t.read().count() == 0 and t.read().columns == ["k", "v", "w"]


def test_a_hot_key_is_split(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        t = BucketTable(spark, f"file://{tmp_path}/t", "k", 4)
        t.write(spark.range(40_000).select(F.lit(1).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert t.read().count() == 40_000 and len(files(tmp_path / "t")) > 1


def one_by_one(oks, size):
    """(batches, ids done) of batch after batch."""
    wait, done, n = list(range(len(oks))), [], 0
    while wait:
        batch, n = wait[:size], n + 1
        good = [i for i in batch if oks[i]]
        done += good or batch
        wait = [i for i in wait if i not in set(good or batch)]
        if not good:
            break
    return n, sorted(done)


def test_where_the_outbox_ends():
    rng = random.Random(0)
    for _ in range(2000):
        size, share = rng.randrange(1, 8), rng.random()
        oks = [rng.random() < share for _ in range(rng.randrange(40))]
        bad = [i for i, ok in enumerate(oks) if not ok]
        n, end, given = queues.outbox_end(bad[:size], len(oks), size)
        want = one_by_one(oks, size)
        assert (n, sorted({i for i in range(end) if oks[i]} | set(bad[:given]))) == want


@pytest.mark.parametrize("bad", [5, 2])
def test_outbox_over_buckets(spark, tmp_path, bad):
    rows = [(i, i % 9, f"c{i}", "PENDING" if i % 4 else "SYNCED", [1.0, 2.0] if i % bad else [1.0], [1], [0.5], 0.5, [], "document", i, [], 3) for i in range(60)]
    frame = spark.createDataFrame(rows, CHUNK)
    # batch after batch over frames
    c, p, n = frame, None, 0
    while not (batch := waiting(c, 4)).isEmpty():
        after, valid = sync_batch(c, batch, 2)
        some = [r.id for r in valid.collect()]
        p, n = upsert_points(p, frame.where(F.col("id").isin(some))), n + 1
        c = spark.createDataFrame(after.collect(), frame.schema)
        if not some:
            break
    for kind in (lambda name, by: KeyedTable(spark, f"file://{tmp_path}/{name}-k"), lambda name, by: BucketTable(spark, f"file://{tmp_path}/{name}-b", by, 8)):
        chunks, points = kind("c", "document_id"), kind("p", "id")
        chunks.write(frame)
        assert queues.drain_outbox(chunks, points, 4, 2) == n
        show = lambda df: sorted((r.id, r.sync_status, len(r.dense_vector)) for r in df.collect())
        assert show(chunks.read()) == show(c) and sorted(r.id for r in points.read().collect()) == sorted(r.id for r in p.collect())
    assert queues.drain_outbox(BucketTable(spark, f"file://{tmp_path}/none", "id"), points) == 0


def test_a_small_outbox_batch_touches_few_buckets(spark, tmp_path):
    rows = [(i, i, f"c{i}", "PENDING" if i == 77 else "SYNCED", [1.0, 2.0], [1], [0.5], 0.5, [], "document", i, [], 3) for i in range(400)]
    chunks, points = BucketTable(spark, f"file://{tmp_path}/c", "document_id", 32, keep=1), BucketTable(spark, f"file://{tmp_path}/p", "id", 32, keep=1)
    chunks.write(spark.createDataFrame(rows, CHUNK))
    points.write(upsert_points(None, chunks.read().where("id <> 77")))
    before = files(tmp_path / "c"), files(tmp_path / "p")
    assert queues.drain_outbox(chunks, points, 100, 2) == 1 and points.read().count() == 400
    for was, now in zip(before, (files(tmp_path / "c"), files(tmp_path / "p")), strict=True):
        assert len(now - was) == 1 and len(was - now) <= 1


def test_feed_over_buckets(spark, tmp_path):
    kind = "id long, drive_file_id string, status string, fail_reason string, filename string, md5_hash string, processed_content string"
    docs = spark.createDataFrame([(i, f"f{i}" if i % 3 else None, "COMPLETED", None, f"{i}.txt", f"m{i}", "text") for i in range(90)], kind)
    table = BucketTable(spark, f"file://{tmp_path}/d", "drive_file_id", 32, keep=1)
    table.write(docs)
    before = files(tmp_path / "d")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, [{"file_id": "f1", "removed": True, "seq": 1}, {"file_id": "f2", "removed": False, "name": "c.md", "md5": "m3", "seq": 2}])))
    queues.run_available(change_feed(spark, f"file://{tmp_path}/in"), queues.apply_feed(table), f"file://{tmp_path}/check").awaitTermination()
    got = {r.id: (r.status, r.filename) for r in table.read().collect()}
    assert got == {i: ("FAILED", "1.txt") if i == 1 else ("PENDING", "c.md") if i == 2 else ("COMPLETED", f"{i}.txt") for i in range(90)}
    assert len(files(tmp_path / "d") - before) <= 2
