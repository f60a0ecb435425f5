"""Embeddings, dense, two-stage and fused search, and BM25 weights.

A search's words are few: a document's weights for them are counted in its own row, without a shuffle. For many searches, ``postings`` writes
them out by term once.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.functions.batches import limit, parts
from textquarry.functions.terms import AVERAGE, B, K, bm25_embedding

SIZE = 384
MODES = ("semantic", "hybrid", "rrf")


class SearchUnavailable(Exception):
    """No vectors to search."""


def check_query(text: str, k: int = 5, mode: str = "semantic") -> tuple[str, int, str]:
    """The query, trimmed, if it has 1 to 1000 characters, k is a whole number from 1 to 100, and the mode is known."""
    text = text.strip()
    if not 1 <= len(text) <= 1000:
        raise ValueError("query must have 1 to 1000 characters")
    if isinstance(k, bool) or not isinstance(k, int) or not 1 <= k <= 100:
        raise ValueError("k must be 1..100")
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    return text, k, mode


def query_error(text: Column, k: Column) -> Column:
    """The same rules over a column of queries."""
    n = F.length(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    return F.when(~F.coalesce(n.between(1, 1000), F.lit(False)), "INVALID_QUERY").when(~F.coalesce(k.between(1, 100), F.lit(False)), "INVALID_TOP_K")


def cosine(a: Column, b: list[float]) -> Column:
    """Cosine of a vector and the query; null where either has no length, which ranks last."""
    q = F.array(*[F.lit(float(x)) for x in b])
    dot = F.aggregate(F.zip_with(a, q, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.try_divide(dot, norm * F.lit(math.sqrt(sum(x * x for x in b))))


def dense_top_k(vectors: DataFrame, query: list[float], k: int = 5, key: str = "vec_id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """Exact cosine top k of the rows that meet ``where``; the query is a constant, so there is no join: a scan and a bounded heap per task. Vectors
    of another size are left out, those of length 0 come last with a null score."""
    check_query("q", k)
    rows = vectors if where is None else vectors.where(where)
    scored = rows.where(F.size(vector) == len(query)).select(key, F.round(cosine(F.col(vector), query), 6).alias("score"))
    return scored.orderBy(F.desc_nulls_last("score"), key).limit(k)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+"), lambda w: w != "")


def weight(tf: Column, n: Column) -> Column:
    """tf (k + 1) / (tf + k (1 - b + b n / average)); no inverse document frequency."""
    return tf * (K + 1) / (tf + K * (1 - B + B * n / AVERAGE))


def _weights(batches):
    for b in parts(batches):
        out = []
        for found in b.column("w").to_pylist():
            counts: dict[str, int] = {}
            for x in found:
                counts[x] = counts.get(x, 0) + 1
            out.append([(t, c * (K + 1) / (c + K * (1 - B + B * len(found) / AVERAGE))) for t, c in sorted(counts.items())])
        yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(out, pa.map_(pa.string(), pa.float64()))], names=["k", "weights"])


def sparse_vectors(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, weights: map from term to weight) of every text, row by row."""
    limit(docs.sparkSession)
    rows = docs.select(F.col(key).alias("k"), words(F.col(text)).alias("w"))
    return rows.mapInArrow(_weights, f"k {dict(docs.dtypes)[key]}, weights map<string,double>").withColumnRenamed("k", key)


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, weight) of every word of every text: a posting table, to be written by term. Counted row by row, so nothing is shuffled."""
    return sparse_vectors(docs, key, text).select(key, F.explode("weights").alias("term", "weight"))


def query_scores(docs: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sparse): the sum of a text's weights for the query's terms; texts with none of them are left out. One pass, no shuffle."""
    wanted = sorted({t for t in terms if t})
    w = words(F.col(text))
    found = F.filter("w", lambda x: F.array_contains(F.array(*[F.lit(t) for t in wanted]), x))
    counted = docs.select(key, w.alias("w")).select(key, F.struct(F.size("w").alias("n"), found.alias("f")).alias("x"))
    # by a generator, as a plain filter would be pushed below and read every text twice
    rows = counted.select(key, F.explode(F.filter(F.array("x"), lambda x: F.size(x["f"]) > 0)).alias("x")).select(key, "x.n", "x.f")
    count = lambda t: F.size(F.filter("f", lambda x: x == F.lit(t)))
    each = [count(t) for t in wanted]
    total = sum((F.when(tf > 0, weight(tf, F.col("n"))).otherwise(0.0) for tf in each), F.lit(0.0))
    return rows.select(key, total.alias("sparse"))


def posting_scores(table: DataFrame, terms: list[str], key: str = "doc_id") -> DataFrame:
    """The same from a posting table, for a table of query terms: a join on the term and a sum."""
    query = table.sparkSession.createDataFrame([(t, 1.0) for t in sorted(set(terms))], "term string, q double")
    return table.join(F.broadcast(query), "term").groupBy(key).agg(F.sum(F.col("weight") * F.col("q")).alias("sparse"))


def two_stage(sparse: DataFrame, vectors: DataFrame, query: list[float], k: int, key: str, vector: str = "embedding") -> DataFrame:
    """2k candidates by sparse score, ranked anew by dense score; a row without a query term can't appear."""
    first = sparse.orderBy(F.desc(F.round("sparse", 6)), key).limit(2 * k)
    return dense_top_k(vectors.join(F.broadcast(first), key), query, k, key, vector)  # at most 200 rows


def rrf(a: DataFrame, b: DataFrame, key: str, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (key, rank)."""
    x = a.select(key, F.col("rank").alias("ra")).join(b.select(key, F.col("rank").alias("rb")), key, "full_outer")
    part = lambda r: F.coalesce(1.0 / (constant + F.col(r)), F.lit(0.0))
    return x.select(key, F.round(part("ra") + part("rb"), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def mock_embedding(text: str, size: int = SIZE) -> list[float]:
    """A deterministic vector: sin of the 31-polynomial hash of the UTF-16 units plus the place, halved."""
    h = 0
    raw = text.encode("utf-16-le", "surrogatepass")
    for i in range(0, len(raw), 2):
        h = (h * 31 + raw[i] + 256 * raw[i + 1]) & 0xFFFFFFFF
    h = h - 2**32 if h >= 2**31 else h
    return [math.sin(h + i) * 0.5 for i in range(size)]


Embedder = Callable[[list[str]], list[list[float]]]


def mock_embedder(texts: list[str]) -> list[list[float]]:
    return [mock_embedding(t) for t in texts]


def embed(df: DataFrame, text: str = "content", name: str = "dense", make: Callable[[], Embedder] = lambda: mock_embedder) -> DataFrame:
    """``df`` with a dense vector of each text. ``make`` gives an embedder once a task (a model is loaded there); batches go to it whole. Null
    texts have a null vector."""
    names = [*df.columns, name]

    def run(batches):
        model = make()
        for b in batches:
            texts = b.column(text).to_pylist()
            made = iter(model([t for t in texts if t is not None]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if t is None else next(made) for t in texts], pa.list_(pa.float32()))], names=names)

    return df.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{name}` array<float>")


def embed_sparse(df: DataFrame, text: str = "content", indices: str = "sparse_indices", values: str = "sparse_values") -> DataFrame:
    """``df`` with each text's BM25 terms as parallel arrays of term ids (ascending) and weights; empty ones for null texts."""
    limit(df.sparkSession)
    names = [*df.columns, indices, values]

    def run(batches):
        for b in parts(batches):
            made = [sorted(bm25_embedding(t).items()) for t in b.column(text).to_pylist()]
            arrays = [pa.array([[x[i] for x in m] for m in made], pa.list_(t)) for i, t in ((0, pa.int64()), (1, pa.float32()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], names=names)

    return df.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{indices}` array<bigint>, `{values}` array<float>")


def stored_scores(chunks: DataFrame, text: str, key: str = "id", indices: str = "sparse_indices", values: str = "sparse_values") -> DataFrame:
    """(key, sparse): dot product of stored sparse vectors and the query's, which is encoded like a document; rows that share no term are left
    out."""
    query = bm25_embedding(text)
    if not query:
        return chunks.where("1 = 0").select(key, F.lit(0.0).alias("sparse"))
    ids = F.array(*[F.lit(i).cast("long") for i in query])
    weights = F.create_map(*[F.lit(x) for i, w in query.items() for x in (i, float(w))])
    each = F.zip_with(F.col(indices).cast("array<bigint>"), F.col(values), lambda i, v: F.when(F.array_contains(ids, i), v.cast("double") * F.element_at(weights, i)).otherwise(0.0))
    hit = F.arrays_overlap(F.col(indices).cast("array<bigint>"), ids)
    return chunks.where(hit).select(key, F.aggregate(each, F.lit(0.0), lambda s, x: s + x).alias("sparse"))


def embed_query(text: str, make: Callable[[], Embedder] = lambda: mock_embedder) -> tuple[list[float], list[str]]:
    """(dense, terms) of a query, by the documents' encoder."""
    text, *_ = check_query(text)
    found = [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split() if w]
    return make()([text])[0], found


def embed_queries(queries: DataFrame, text: str = "text", make: Callable[[], Embedder] = lambda: mock_embedder) -> DataFrame:
    """``queries`` with ``dense`` and ``terms`` of each, by the documents' encoder. The texts are trimmed; those that ``query_error`` refuses
    should be left out before."""
    trimmed = queries.withColumn(text, F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    plain = F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]", " "), " ")
    return embed(trimmed, text, "dense", make).withColumn("terms", F.filter(plain, lambda w: w != ""))


def table_info(points: DataFrame, vector: str = "dense") -> DataFrame:
    """(points, size, status) of a vector table."""
    return points.agg(F.count(F.lit(1)).alias("points"), F.max(F.size(vector)).alias("size")).withColumn("status", F.when(F.col("points") > 0, "green").otherwise("empty"))


def empty_points(spark: SparkSession) -> DataFrame:
    """A vector table without points."""
    payload = "struct<content:string,document_id:bigint,quality_score:double,quality_flags:array<string>,chunk_type:string,chunk_index:int,breadcrumbs:array<string>,token_count:int>"
    return spark.createDataFrame([], f"id bigint, dense array<float>, sparse_indices array<int>, sparse_values array<float>, payload {payload}")


def search(chunks: DataFrame | None, text: str, k: int = 5, mode: str = "semantic", document_id=None, make: Callable[[], Embedder] = lambda: mock_embedder, vector: str = "dense_vector", stored: bool = False) -> DataFrame:
    """Top k chunks of a query with what is shown of them: by dense score; ``hybrid``: the 2k best by words, ranked by dense score; ``rrf``: both
    ranks fused. ``document_id`` keeps one document's chunks, before anything is scored. ``stored``: words by
    the stored sparse vectors (stems without stop words) instead of the texts."""
    text, k, mode = check_query(text, k, mode)
    if chunks is None:
        raise SearchUnavailable("no vector table")
    dense, terms = embed_query(text, make)
    rows = chunks if document_id is None else chunks.where(F.col("document_id") == F.lit(document_id))
    if mode == "semantic":
        hits = dense_top_k(rows, dense, k, "id", vector)
    elif mode == "hybrid":
        sparse = stored_scores(rows, text) if stored else query_scores(rows, terms, "id", "content")
        hits = two_stage(sparse, rows, dense, k, "id", vector)
    else:
        ranked = lambda x: x.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(x.columns[1]), "id"))).select("id", "rank")
        best = query_scores(rows, terms, "id", "content").orderBy(F.desc("sparse"), "id").limit(2 * k)
        hits = rrf(ranked(dense_top_k(rows, dense, min(100, 2 * k), "id", vector)), ranked(best), "id", k)  # windows over 2k rows
    return projected(hits, chunks)


def projected(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits (id, score) with content, document and metadata, best first."""
    metadata = F.struct("quality_score", "quality_flags", "chunk_type", "chunk_index", "breadcrumbs", "token_count")
    shown = chunks.select("id", "content", "document_id", metadata.alias("metadata"))
    return shown.join(F.broadcast(hits), "id").select("id", "content", "document_id", "score", "metadata").orderBy(F.desc_nulls_last("score"), "id")
