"""The vector index against a scan of all vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.operators.search import dense_top_k
from textquarry.operators.vector_index import Book, VectorIndex, unit

D = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{D}/embeddings.parquet")


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    return VectorIndex(spark, f"file://{tmp_path_factory.mktemp('index')}").build(vectors)


def test_every_row_is_indexed(index, vectors):
    assert index.rows().select("vec_id").exceptAll(vectors.select("vec_id")).isEmpty() and index.rows().count() == vectors.count()
    assert tuple(index.info().first()) == (2000, 64, 44, "green")


def test_recall(index, vectors):
    queries = vectors.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding AS query")
    every = {(r.query_id, r.vec_id) for r in index.search_many(queries, 10, probes=44).collect()}
    some = {(r.query_id, r.vec_id) for r in index.search_many(queries, 10).collect()}
    v = unit(np.array([r.embedding for r in vectors.orderBy("vec_id").collect()], float))
    best = {(i, int(j)) for i in range(0, 2000, 20) for j in np.lexsort((np.arange(2000), -np.round(v @ v[i], 6)))[:10]}
    assert every == best
    assert len(some & every) / len(every) >= 0.9 and index.load()[0]["probes"] < 44


def test_clusters_need_few_probes(spark, tmp_path):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 32))
    v = centres[rng.integers(60, size=6000)] + 0.2 * rng.normal(size=(6000, 32))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>")
    index = VectorIndex(spark, f"file://{tmp_path}/c").build(df)
    assert index.load()[0]["probes"] <= 10 < index.load()[0]["lists"]
    queries = df.where("vec_id % 100 = 0").selectExpr("vec_id AS query_id", "embedding AS query")
    every, some = ({(r.query_id, r.vec_id) for r in index.search_many(queries, 10, p).collect()} for p in (1000, None))
    assert len(some & every) / len(every) >= 0.9


def test_exact_search_equals_a_scan(index, vectors):
    rng = np.random.default_rng(0)
    some = [list(map(float, r.embedding)) for r in vectors.where("vec_id in (3, 700)").collect()]
    for q, probes in zip([*some, [float(x) for x in rng.normal(size=64)], [0.0] * 64], (1, 8, 4, 2), strict=True):
        for k in (1, 10):
            got, want = index.search(q, k, probes, exact=True).collect(), dense_top_k(vectors, q, k).collect()
            if any(q):
                assert got == want
            else:
                assert [r.score for r in got] == [None] * k


def test_only_probed_lists_are_read(index):
    plan = index.search([1.0] * 64, 5, 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan


def test_odd_vectors(spark, tmp_path):
    rows = [(i, [float(i % 7), 1.0, -2.0]) for i in range(50)] + [(100, None), (101, [1.0]), (102, [0.0] * 3), (103, [float("nan"), 1.0, 1.0]), (104, [2.0, None, 1.0]), (105, [0.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    index = VectorIndex(spark, f"file://{tmp_path}/i")
    assert index.info().first().status == "absent"
    with pytest.raises(FileNotFoundError):
        index.search([1.0, 0.0, 0.0])
    index.build(df)
    assert index.info().first().points == 52
    assert index.search([1.0, 0.0, 0.0], 50, 1, exact=True).collect() == dense_top_k(df.where("vec_id < 100"), [1.0, 0.0, 0.0], 50).collect()
    with pytest.raises(ValueError):
        index.search([1.0])
    index.build(df.where("vec_id < 10"))  # a second build takes the first one's place
    assert index.rows().count() == 10
    empty = VectorIndex(spark, f"file://{tmp_path}/e").build(df.where("1 = 0"))
    assert empty.search([], 3, exact=True).count() == 0 and empty.info().first().points == 0


def test_a_hot_list_is_several_files(spark, tmp_path):
    df = spark.range(4000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 2 == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.sin("id"), F.cos("id"))).cast("array<float>").alias("embedding"))
    index = VectorIndex(spark, f"file://{tmp_path}/h").build(df)
    files = index.rows().groupBy("list").agg(F.count_distinct(F.input_file_name()).alias("n"), F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows")).first()
    assert files.rows >= 2000 and files.n > 1


def test_estimates_are_off_by_no_more_than_the_residual():
    rng = np.random.default_rng(2)
    x = unit(rng.normal(size=(800, 24)))
    book = Book.fit(x[:300], 9, 6)
    at, codes, left, far = book.encode(x)
    q = unit(rng.normal(size=(5, 24)))
    assert (np.abs(book.estimate(q, at, codes) - x @ q.T) <= left[:, None] + 1e-9).all()
    assert ((x @ q.T) <= (book.lists @ q.T)[at] + far[:, None] + 1e-9).all()
