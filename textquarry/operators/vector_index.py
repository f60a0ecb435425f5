"""An inverted-file index over vectors with product-quantised residuals, for cosine search.

Vectors are scaled to length one. Coarse centroids (about the root of the number of rows, fitted on a bounded sample) part them into lists; what is left
of each after its centroid is cut into parts and each part coded by the nearest of up to 256 centroids, and the norm of what the codes
still leave is kept. Every row is in a list: the sample bounds what the centroids are fitted on, not what they cover. Lists are folders
(Hive partitions), so a search reads only the lists it probes. Lists of many rows are several files, as the write deals by list and key hash.

A search ranks lists by the query's product with their centroids. In the probed ones each task scores rows by lookup
tables and drops those whose score, with the norm of the residual on top, can't reach the k-th best lower bound of the task; the others are scored
exactly, so within the probed lists nothing is lost. ``exact`` then also reads every list whose radius lets it hold a row as good as the k-th found: the
same rows as a scan of all vectors. Rows of another size than the index, null vectors and such with a null or non-finite component aren't indexed; those of
length 0 are a list of their own, -1, that is read only where fewer than k rows were found.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from textquarry.operators.search import check_query, dense_top_k

#: Bounds: rows that centroids are fitted on, lists, parts of a vector, queries of one batch (they are sent to the tasks).
SAMPLE, MOST_LISTS, PARTS, MOST_QUERIES = 20_000, 4096, 16, 10_000
CENTROIDS, ROUNDS = 256, 8
#: Rows of the sample that searches are tried with, and the share of their nearest rows that the default number of probes must find.
TRIALS, RECALL = 200, 0.95
NOTHING = -1


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; rows without length stay."""
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size > 0, size, 1)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)


def lloyd(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """At most ``k`` centroids; one that loses its rows starts anew at the row farthest from its own."""
    known = np.unique(x, axis=0)
    c = known[np.random.default_rng(0).permutation(len(known))[:k]]
    for _ in range(rounds):
        code = nearest(x, c)
        n = np.bincount(code, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, code, x)
        far = np.argsort(-((x - c[code]) ** 2).sum(axis=1), kind="stable")
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        empty = np.flatnonzero(n == 0)
        c[empty] = x[far[: len(empty)]]
    return c


@dataclass
class Book:
    """Coarse centroids, a code book a part, and the farthest row of each list from its centroid."""

    lists: np.ndarray
    parts: list[np.ndarray]
    radius: np.ndarray

    @property
    def size(self) -> int:
        return self.lists.shape[1]

    def cuts(self) -> list[slice]:
        edges = np.linspace(0, self.size, len(self.parts) + 1).astype(int)
        return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, parts: int = PARTS) -> "Book":
        x = unit(x)
        coarse = lloyd(x, lists) if len(x) else np.zeros((1, x.shape[1]))
        left = x - coarse[nearest(x, coarse)] if len(x) else x
        made = cls(coarse, [np.zeros((1, 1))] * max(1, min(parts, x.shape[1])), np.zeros(len(coarse)))
        made.parts = [lloyd(left[:, cut], CENTROIDS) if len(x) else np.zeros((1, cut.stop - cut.start)) for cut in made.cuts()]
        return made

    def probes_for(self, x: np.ndarray, recall: float, k: int = 10) -> int:
        """How many lists hold, in the order of a query, the share ``recall`` of the k best rows of the fitted sample ``x`` for TRIALS of its rows."""
        x = unit(x)
        if not len(x):
            return 1
        at, q = nearest(x, self.lists), x[np.linspace(0, len(x) - 1, min(TRIALS, len(x))).astype(int)]
        best = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :k]
        place = np.argsort(np.argsort(-(q @ self.lists.T), axis=1, kind="stable"), axis=1)
        ranks = np.sort(np.take_along_axis(place, at[best], axis=1).ravel())
        return int(ranks[math.ceil(recall * len(ranks)) - 1]) + 1

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, norm of what the codes leave, distance to the list's centroid) of vectors of length one."""
        at = nearest(x, self.lists)
        left = x - self.lists[at]
        far = np.sqrt((left * left).sum(axis=1))
        codes = np.empty((len(x), len(self.parts)), np.uint8)
        for j, (cut, c) in enumerate(zip(self.cuts(), self.parts, strict=True)):
            codes[:, j] = nearest(left[:, cut], c)
            left[:, cut] -= c[codes[:, j]]
        return at, codes, np.sqrt((left * left).sum(axis=1)), far

    def estimate(self, q: np.ndarray, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Lookup-table products of queries (rows of ``q``, length one) with coded vectors: (vectors x queries)."""
        out = (self.lists @ q.T)[at]
        for j, (cut, c) in enumerate(zip(self.cuts(), self.parts, strict=True)):
            out += (c @ q[:, cut].T)[codes[:, j]]
        return out


_SLACK = 1e-5  # over the rounding of scores to six digits, too


class VectorIndex:
    """An index in a folder: ``book`` (centroids), ``lists`` (rows by list), and ``_whole``, written last, which makes it count."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jpath = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._jpath(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._book = None

    def _version(self) -> str | None:
        mark = self._jpath(f"{self.path}/_whole")
        names = sorted(s.getPath().getName() for s in self.fs.listStatus(mark)) if self.fs.exists(mark) else []
        return names[-1] if names else None

    def at(self) -> str:
        name = self._version()
        if name is None:
            raise FileNotFoundError(f"{self.path} holds no whole index")
        return f"{self.path}/{name.split('.', 1)[1]}"

    def build(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", lists: int | None = None, parts: int = PARTS, size: int | None = None, recall: float = RECALL) -> "VectorIndex":
        """Indexes every row of ``vectors`` whose vector has ``size`` components (by default the commonest size), with all its columns. A build
        that fails leaves the index before in place; a whole one takes its place."""
        spark = self.spark
        fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
        sized = vectors.where(F.col(vector).isNotNull() & F.forall(vector, fine))
        if size is None:
            top = sized.groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), "size").first()
            size = top["size"] if top else 0
        rows = sized.where(F.size(vector) == size)
        place = F.xxhash64(key, vector)
        some = [r[0] for r in rows.orderBy(place).select(F.transform(vector, lambda c: c.cast("double"))).limit(SAMPLE).collect()]
        x = np.array(some, np.float64).reshape(len(some), size)
        x = x[(x != 0).any(axis=1)]
        n = rows.count()
        book = Book.fit(x, lists or max(1, min(MOST_LISTS, math.isqrt(n))), parts)
        name = f"v-{uuid.uuid4().hex}"
        names, schema = [*rows.columns], rows.schema

        def code(batches):
            for b in batches:
                flat = np.asarray(b.column(vector).flatten().cast(pa.float64()))
                v = flat.reshape(len(b), size)
                fine = (v != 0).any(axis=1)
                at, codes, left, far = book.encode(unit(v))
                added = [pa.array(np.where(fine, at, NOTHING).astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(np.where(fine, left, 0.0)), pa.array(np.where(fine, far, 0.0))]
                yield pa.RecordBatch.from_arrays([*b.columns, *added], names=[*names, "list", "codes", "left", "far"])

        kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", list int, codes binary, `left` double, far double"
        coded = rows.mapInArrow(code, kind)
        # by range of (list, hash): a list of many rows, copies too, is several files; small ones share a task
        parts_out = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        spread = coded.withColumn("_h", F.xxhash64(key, vector, F.monotonically_increasing_id()))
        spread.repartitionByRange(parts_out, "list", "_h").drop("_h").write.partitionBy("list").parquet(f"{self.path}/{name}/lists")
        stored = spark.read.schema(coded.schema).parquet(f"{self.path}/{name}/lists")
        far = {r["list"]: r["far"] for r in stored.groupBy("list").agg(F.max("far").alias("far")).collect()}  # a row a list
        book.radius = np.array([far.get(i, 0.0) for i in range(len(book.lists))])
        about = json.dumps({"schema": json.loads(coded.schema.json()), "size": size, "key": key, "vector": vector, "rows": n, "lists": len(book.lists), "probes": book.probes_for(x, recall), "parts": [list(c.shape) for c in book.parts]})
        blob = b"".join(np.ascontiguousarray(a, np.float64).tobytes() for a in (book.lists, book.radius, *book.parts))
        spark.createDataFrame([(about, bytearray(blob))], "about string, blob binary").coalesce(1).write.parquet(f"{self.path}/{name}/book")
        before = self._version()
        turn = int(before.split(".")[0]) + 1 if before else 0
        self.fs.create(self._jpath(f"{self.path}/_whole/{turn:012d}.{name}"), False).close()
        if before:
            self.fs.delete(self._jpath(f"{self.path}/_whole/{before}"), False)
            self.fs.delete(self._jpath(f"{self.path}/{before.split('.', 1)[1]}"), True)
        self._book = None
        return self

    def load(self) -> tuple[dict, Book]:
        if self._book is None or self._book[0] != self.at():
            row = self.spark.read.parquet(f"{self.at()}/book").first()
            about, blob, i, arrays = json.loads(row["about"]), np.frombuffer(bytes(row["blob"]), np.float64), 0, []
            for shape in [(about["lists"], about["size"]), (about["lists"],), *map(tuple, about["parts"])]:
                arrays.append(blob[i : i + math.prod(shape)].reshape(shape))
                i += math.prod(shape)
            self._book = (self.at(), about, Book(arrays[0], arrays[2:], arrays[1]))
        return self._book[1:]

    def info(self) -> DataFrame:
        """(points, size, lists, status): ``green`` for a whole index whose lists hold all rows that were to go in, else ``yellow``; ``absent``
        where there is none."""
        if self._version() is None:
            return self.spark.createDataFrame([(0, 0, 0, "absent")], "points long, size int, lists int, status string")
        about, _ = self.load()
        n = self.rows().count()
        status = "green" if n == about["rows"] else "yellow"
        return self.spark.createDataFrame([(n, about["size"], about["lists"], status)], "points long, size int, lists int, status string")

    def rows(self) -> DataFrame:
        kind = T.StructType.fromJson(self.load()[0]["schema"])  # an empty index has no file to tell it
        return self.spark.read.schema(kind).parquet(f"{self.at()}/lists")

    def _candidates(self, rows: DataFrame, query: np.ndarray, book: Book, key: str, vector: str, k: int) -> DataFrame:
        """Those of ``rows`` that may be among the k best: by estimates with what they may be off by, against the k-th best lower bound so far."""
        q = query[None, :]

        def run(batches):
            floor = np.full(k, -np.inf)
            for b in batches:
                at = np.asarray(b.column("list"), dtype=np.int64)
                codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(len(b), -1)
                off = np.asarray(b.column("left")) + _SLACK
                about = np.where(at < 0, 0.0, book.estimate(q, at, codes)[:, 0])
                lower = np.where(at < 0, -np.inf, about - off)
                floor = np.sort(np.concatenate([floor, lower]))[-k:]
                may = np.flatnonzero(about + off >= floor[0])
                yield b.select([key, vector]).take(pa.array(may))

        kinds = dict(rows.dtypes)
        return rows.select(key, vector, "list", "codes", "left").mapInArrow(run, f"`{key}` {kinds[key]}, `{vector}` {kinds[vector]}")

    def search(self, query: list[float], k: int = 5, probes: int | None = None, exact: bool = False) -> DataFrame:
        """(key, score) of the k best rows of the probed lists, best first; with ``exact``, of all rows. By default as many lists are
        probed as found the share ``recall`` in trials over the sample when the index was built."""
        check_query("q", k)
        about, book = self.load()
        key, vector = about["key"], about["vector"]
        if len(query) != about["size"]:
            raise ValueError(f"the index holds vectors of {about['size']}")
        q = np.array(query, np.float64)
        q = q / (float(np.sqrt(q @ q)) or 1.0)
        near = book.lists @ q
        order = np.argsort(-near, kind="stable")
        probes = about["probes"] if probes is None else max(1, probes)
        chosen = [int(i) for i in order[:probes]]
        read = lambda lists: self.rows().where(F.col("list").isin(lists))
        top = lambda lists: dense_top_k(self._candidates(read(lists), q, book, key, vector, k), query, k, key, vector)
        first = top(chosen)
        if not exact:
            return first
        found = first.collect()  # k rows
        known = [r["score"] for r in found if r["score"] is not None]
        floor = known[k - 1] if len(known) >= k else -math.inf
        more = [int(i) for i in order[probes:] if near[i] + book.radius[i] + _SLACK >= floor]
        if len(known) < k:
            more = [int(i) for i in order[probes:]] + [NOTHING]
        return top(chosen + more) if more else first

    def search_many(self, queries: DataFrame, k: int = 10, probes: int | None = None, query_key: str = "query_id", query_vector: str = "query") -> DataFrame:
        """(query key, key, score, rank) of many queries at once: each task takes the rows of a list by a matrix product with the queries that probe it.
        More than MOST_QUERIES are an error: they are sent to every task, so a larger set is searched in several calls."""
        about, book = self.load()
        key, vector = about["key"], about["vector"]
        rows = queries.where(F.size(query_vector) == about["size"]).select(query_key, F.transform(query_vector, lambda c: c.cast("double"))).limit(MOST_QUERIES + 1).collect()
        if len(rows) > MOST_QUERIES:
            raise ValueError(f"at most {MOST_QUERIES} queries at once")
        kinds, names = dict(self.rows().dtypes), [r[0] for r in rows]
        q = unit(np.array([r[1] for r in rows], np.float64).reshape(len(rows), about["size"]))
        probes = about["probes"] if probes is None else max(1, probes)
        asked = np.argsort(-(q @ book.lists.T), axis=1, kind="stable")[:, :probes]
        by_list = {int(i): np.flatnonzero((asked == i).any(axis=1)) for i in np.unique(asked)}
        shared = self.spark.sparkContext.broadcast((q, by_list, names))

        def run(batches):
            q, by_list, names = shared.value
            best = {}  # per query the k best of the task so far: (scores, keys)
            for b in batches:
                at = np.asarray(b.column("list"))
                v = np.asarray(b.column(vector).flatten().cast(pa.float64())).reshape(len(b), -1)
                keys = np.array(b.column(key).to_pylist(), dtype=object)
                for i in np.unique(at):
                    mine = np.flatnonzero(at == i)
                    score = np.round(unit(v[mine]) @ q[by_list[int(i)]].T, 6)
                    for j, who in enumerate(by_list[int(i)]):
                        s, n = best.get(who, (np.zeros(0), np.zeros(0, object)))
                        s, n = np.concatenate([s, score[:, j]]), np.concatenate([n, keys[mine]])
                        top = sorted(np.argpartition(-s, k)[: k + 1], key=lambda x: -s[x])[:k] if len(s) > 8 * k else np.arange(len(s))
                        if len(s) > 8 * k:  # ties at the edge stay, and are told apart by key at the end
                            top = np.flatnonzero(s >= s[top[-1]])
                        best[who] = (s[top], n[top])
            for who, (s, n) in best.items():
                order = sorted(range(len(s)), key=lambda x: (-s[x], n[x]))[:k]
                yield pa.RecordBatch.from_arrays([pa.array([names[who]] * len(order)), pa.array([n[x] for x in order]), pa.array(s[order])], names=[query_key, key, "score"])

        chosen = self.rows().where(F.col("list").isin(sorted(by_list))).select(key, vector, "list")
        found = chosen.mapInArrow(run, f"`{query_key}` {dict(queries.dtypes)[query_key]}, `{key}` {kinds[key]}, score double")
        order = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
