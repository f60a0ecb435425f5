"""What a Python task holds at once is bounded by bytes, not by Spark's rows a batch."""

import pyarrow as pa

from textquarry.functions import batches
from textquarry.operators import search

CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_parts_hold_every_row_in_order():
    texts = ["x" * (i * 7919 % 5000) for i in range(3000)] + ["y" * (3 << 20), "", None]
    b = pa.RecordBatch.from_pydict({"t": pa.array(texts, pa.string())})
    made = list(batches.parts([b, b.slice(0, 0), b.slice(5, 3)]))
    assert [t for x in made for t in x.column("t").to_pylist()] == texts + texts[5:8]
    assert all(x.nbytes <= batches.PART or x.num_rows == 1 for x in made)


def test_sparse_vectors_hold_few_texts_at_once(spark):
    words = [[f"w{i * j % 997}" for j in range(300)] for i in range(5000)]
    made = list(search._weights(iter([pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array(words)], names=["k", "w"])])))
    assert [k for b in made for k in b.column("k").to_pylist()] == list(range(5000)) and max(b.num_rows for b in made) < 1000
    docs = spark.createDataFrame([(1, "a b a")], "doc_id long, text string")
    for make in (search.sparse_vectors, search.postings, lambda x: search.embed_sparse(x, "text")):
        spark.conf.set(CONF, "10000")
        assert make(docs).count() and int(spark.conf.get(CONF)) <= 2000
    weights = search.sparse_vectors(docs).first().weights
    assert sorted(weights) == ["a", "b"] and weights["a"] > weights["b"]
