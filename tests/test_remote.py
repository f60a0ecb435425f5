"""The remote store as a data source, and the chunkers as a table function."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from textquarry.operators import table_functions
from textquarry.operators.chunking import chunk_documents
from textquarry.operators.quality import Profile
from textquarry.sources import remote
from textquarry.sources.listing import CHANGE, FOLDER


class Stuck(remote.StoredListing):
    """Page tokens that don't move, and a feed that goes on a page at a time."""

    def children(self, folder, token, size):
        return self.held["children"].get(folder, [])[:3], "same"

    def changes(self, token, size):
        return super().changes(token, 2)


def entry(i, name, mime="text/plain", trashed=False):
    return {"id": i, "name": name, "mime_type": mime, "md5": f"m{i}", "size": 1, "trashed": trashed}


@pytest.fixture
def store(spark, tmp_path):
    spark.dataSource.register(remote.RemoteStore)
    held = {"children": {"root": [*[entry(f"r{i}", f"{i:03d}.txt") for i in range(250)], entry("A", "a", FOLDER), entry("B", "b", FOLDER), entry("T", "gone", FOLDER, True), entry("x", "x.zip", "application/zip"), entry("t", "t.txt", "text/plain", True)]}, "changes": []}
    held["children"] |= {"A": [entry("A1", "one", FOLDER), entry("fa", "fa.txt")], "A1": [entry("f1", "f1.txt"), entry("A", "loop", FOLDER)], "B": [entry(f"b{i}", f"{i}.txt") for i in range(120)], "T": [entry("hidden", "h.txt")]}
    path = tmp_path / "held.json"

    def write(**more):
        held.update(more)
        path.write_text(json.dumps(held))
        return held

    write()
    return path, write


def test_folders_are_walked(spark, store):
    path, write = store
    held = write()
    want = {e["id"] for f, es in held["children"].items() if f != "T" for e in es if e["mime_type"] == "text/plain" and not e["trashed"]}
    for parts in ("1", "3", "64"):
        df = spark.read.format("remote_store").options(client="textquarry.sources.remote:StoredListing", path=str(path), folder="root", partitions=parts).load()
        rows = df.collect()
        assert {r.id for r in rows} == want and len(rows) == len(want)
        assert {r.path for r in rows if r.id in ("f1", "fa", "b7", "r9")} == {"/a/one/f1.txt", "/a/fa.txt", "/b/7.txt", "/009.txt"}
    assert df.select("id").where("parent = 'B'").count() == 120
    order = [r[3] for r in remote.walk(remote.StoredListing({"path": str(path)}), remote.Folder("A", "", True))]
    assert order == ["fa.txt", "f1.txt"]


def test_a_token_that_stays_ends_the_walk(spark, store):
    rows = spark.read.format("remote_store").options(client="tests.test_remote:Stuck", path=str(store[0]), folder="root").load().collect()
    assert {r.id for r in rows} == {"r0", "r1", "r2"} | set()  # the first page, twice over, is one


def test_changes_go_on_from_the_checkpoint(spark, store, tmp_path):
    path, write = store
    change = lambda i: {"file_id": f"f{i}", "removed": i % 3 == 0, "name": f"{i}.txt", "mime_type": "text/plain", "md5": str(i), "seq": i}
    out = f"file://{tmp_path}/out"

    def run(client):
        source = spark.readStream.format("remote_store").options(client=client, path=str(path), feed="true", pages="3").load()
        assert source.schema.simpleString() == spark.createDataFrame([], CHANGE).schema.simpleString()
        q = source.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/check").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted(r.seq for r in spark.read.schema(CHANGE).parquet(out).collect())

    write(changes=[change(i) for i in range(13)])
    assert run("tests.test_remote:Stuck") == list(range(13))
    write(changes=[change(i) for i in range(250)])
    assert run("textquarry.sources.remote:StoredListing") == list(range(250))
    assert run("textquarry.sources.remote:StoredListing") == list(range(250))  # nothing twice
    reader = remote.ChangeReader({"client": "textquarry.sources.remote:StoredListing", "path": str(path)})
    rows, end = reader.read({"token": "13"})
    assert list(rows) == list(reader.readBetweenOffsets({"token": "13"}, end)) and end == {"token": "250"}
    assert list(reader.read(end)[0]) == [] and reader.read(end)[1] == end


def test_chunks_from_sql(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", F.when(F.col("doc_id") % 9 == 0, None).otherwise(F.concat(F.lit("# H\n"), F.replace("text", F.lit("\n"), F.lit("\n<!-- slide -->\n\n---\n\n# S\n")))).alias("text"), F.element_at(F.array(F.lit("presentation"), F.lit("tabular"), F.lit("document"), F.lit(None)), (F.col("doc_id") % 4 + 1).cast("int")).alias("category"))
    table_functions.register(spark)
    for call, p in (("chunks(d.text, d.category)", Profile()), ("chunks(d.text, d.category, chunk_size => 400, chunk_overlap => 50, auto_fix => false)", Profile(chunk_size=400, chunk_overlap=50, auto_fix=False))):
        got = spark.sql(f"SELECT d.doc_id, c.chunk_index, c.content, c.breadcrumbs, c.slide_numbers, c.title FROM {{rows}} d, LATERAL {call} c", rows=rows)
        want = chunk_documents(rows, p=p, kind="category").select(*got.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 300
    assert spark.sql("SELECT * FROM chunks('one. two', 'document')").first().content == "one. two"
    for bad in ("chunks(1)", "chunks('x', 'document', colour => 3)", "chunks(d.text, d.category, chunk_size => d.doc_id)"):
        with pytest.raises(PySparkException):
            spark.sql(f"SELECT c.* FROM {{rows}} d, LATERAL {bad} c", rows=rows).collect()
