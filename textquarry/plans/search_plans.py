"""Embeddings, search and vector tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry.operators import search as S
from textquarry.operators.vector_index import VectorIndex
from textquarry.plans import PlanSet
from textquarry.plans import base as B
from textquarry.plans.base import sql, table
from textquarry.sinks.scratch import scratch

plans = PlanSet()
QUERY = [((i * 37) % 11 - 5) / 5.0 for i in range(64)]
_Q = "[" + ",".join(map(str, QUERY)) + "]::DOUBLE[]"
TERMS = ["license", "the", "idiot"]


@plans.add("v6_v9_dense_top_k", f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 6) AS score FROM embeddings WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 10")
def v6_v9_dense_top_k(spark, d):
    return S.dense_top_k(table(spark, d, "embeddings"), QUERY, 10, where=F.col("label") == 3)


@plans.add("v6_dense_top_k", f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10")
def v6_dense_top_k(spark, d):
    rows = table(spark, d, "embeddings")
    zero = rows.selectExpr("-vec_id - 1 AS vec_id", "transform(embedding, x -> 0.0F) AS embedding", "label")
    short = rows.selectExpr("-vec_id - 1000000 AS vec_id", "slice(embedding, 1, 3) AS embedding", "label")
    return S.dense_top_k(rows.unionByName(zero).unionByName(short), QUERY, 10)


_NEAR = "SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0"


def _index(spark, d):
    return VectorIndex(spark, scratch(spark, "vector-index")).build(table(spark, d, "embeddings"))


@plans.add("v6_index_top_k", f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10")
def v6_index_top_k(spark, d):
    """Exact through the index: probed lists first, then those whose radius doesn't rule them out."""
    return _index(spark, d).search(QUERY, 10, exact=True)


@plans.add("v6_index_many", f"SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM ({_NEAR}) QUALIFY rank <= 10")
def v6_index_many(spark, d):
    """Many queries by matrix products a list, all lists probed."""
    vectors = table(spark, d, "embeddings")
    queries = vectors.where("vec_id % 100 = 0").selectExpr("vec_id AS query_id", "embedding AS query")
    index = _index(spark, d)
    return index.search_many(queries, 10, probes=index.load()[0]["lists"])


@plans.add("v6_index_recall")
def v6_index_recall(spark, d):
    """Share of the exact ten best of each query that the default probes find."""
    vectors = table(spark, d, "embeddings")
    queries = vectors.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding AS query")
    index = _index(spark, d)
    all_of, some = index.search_many(queries, 10, probes=index.load()[0]["lists"]), index.search_many(queries, 10)
    hit = some.select("query_id", "vec_id", F.lit(1).alias("hit"))
    return all_of.join(hit, ["query_id", "vec_id"], "left").groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))


@plans.add("v12_index_info", "SELECT count(*) AS points, 64 AS size, floor(sqrt(count(*)))::INTEGER AS lists, 'green' AS status FROM embeddings")
def v12_index_info(spark, d):
    return _index(spark, d).info()


_W = "w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2), n AS (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY 1), p AS (SELECT doc_id, term, tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 256)) AS weight FROM tf JOIN n USING (doc_id))"
_BM = f"{_W}, bm AS (SELECT doc_id, sum(weight) AS sparse FROM p WHERE term IN ('license', 'the', 'idiot') GROUP BY 1)"


@plans.add("v2_bm25_scores", f"WITH {_BM} SELECT doc_id, round(sparse, 6) AS sparse FROM bm")
def v2_bm25_scores(spark, d):
    return S.query_scores(table(spark, d, "documents"), TERMS).select("doc_id", F.round("sparse", 6).alias("sparse"))


@plans.add("v2_sparse_vectors", f"WITH {_W} SELECT doc_id, count(*) AS terms, round(sum(weight), 4) AS total, round(max(weight), 6) AS top FROM p GROUP BY 1")
def v2_sparse_vectors(spark, d):
    v = F.map_values("weights")
    rows = S.sparse_vectors(table(spark, d, "documents")).where(F.size("weights") > 0)
    return rows.select("doc_id", F.size("weights").cast("long").alias("terms"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 4).alias("total"), F.round(F.array_max(v), 6).alias("top"))


@plans.add("j12_posting_scores", f"WITH {_BM} SELECT doc_id, round(sparse, 6) AS sparse FROM bm")
def j12_posting_scores(spark, d):
    return S.posting_scores(S.postings(table(spark, d, "documents")), TERMS).select("doc_id", F.round("sparse", 6).alias("sparse"))


_DENSE = f"round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 6) AS score"


@plans.add("v7_two_stage", f"WITH {_BM}, f AS (SELECT doc_id AS vec_id FROM bm ORDER BY round(sparse, 6) DESC, doc_id LIMIT 20) SELECT vec_id, {_DENSE} FROM embeddings JOIN f USING (vec_id) ORDER BY score DESC, vec_id LIMIT 10")
def v7_two_stage(spark, d):
    sparse = S.query_scores(table(spark, d, "documents"), TERMS).withColumnRenamed("doc_id", "vec_id")
    return S.two_stage(sparse, table(spark, d, "embeddings"), QUERY, 10, "vec_id")


@plans.add("v8_rrf", f"WITH {_BM}, a AS (SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM (SELECT vec_id, {_DENSE} FROM embeddings) QUALIFY r <= 20), b AS (SELECT doc_id AS vec_id, row_number() OVER (ORDER BY round(sparse, 6) DESC, doc_id) AS r FROM bm QUALIFY r <= 20) SELECT coalesce(a.vec_id, b.vec_id) AS vec_id, round(coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0), 6) AS score FROM a FULL JOIN b ON a.vec_id = b.vec_id ORDER BY score DESC, vec_id LIMIT 10")
def v8_rrf(spark, d):
    dense = S.dense_top_k(table(spark, d, "embeddings"), QUERY, 20)
    sparse = S.query_scores(table(spark, d, "documents"), TERMS).select(F.col("doc_id").alias("vec_id"), F.round("sparse", 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(20)
    ranked = lambda x: x.withColumn("rank", F.row_number().over(S.Window.orderBy(F.desc("score"), "vec_id")))
    return S.rrf(ranked(dense), ranked(sparse), "vec_id", 10)


def _chunks(spark, d):
    """Chunks with a stored vector of 64, where the vector table has one for their document."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("document_id"), F.col("embedding").alias("dense_vector"))
    return B.chunks(spark, d).join(v, "document_id")


_HITS = ", round(quality_score, 6) AS quality_score, chunk_index, token_count"
_OUT = "id, document_id, md5(content) AS content, score" + _HITS


@plans.add("m8_v10_semantic_search", sql("c", f"SELECT {_OUT} FROM (SELECT c.*, {_DENSE} FROM c JOIN embeddings ON vec_id = document_id ORDER BY score DESC, id LIMIT 5)"), text=("token_count",))
def m8_v10_semantic_search(spark, d):
    return _shown(S.search(_chunks(spark, d), " the license ", make=lambda: lambda texts: [QUERY for _ in texts]))


@plans.add("m8_v9_hybrid_search_in_document", sql("c", f""", x AS (SELECT c.*, embedding FROM c JOIN embeddings ON vec_id = document_id WHERE document_id = 2), w AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM x),
    n AS (SELECT id, count(*) AS n, count(*) FILTER (term = 'the') AS a, count(*) FILTER (term = 'of') AS b FROM w GROUP BY 1), s AS (SELECT id, a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / 256)) + b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / 256)) AS sparse FROM n WHERE a + b > 0 ORDER BY round(sparse, 6) DESC, id LIMIT 8)
    SELECT {_OUT} FROM (SELECT x.*, {_DENSE} FROM x JOIN s USING (id) ORDER BY score DESC, id LIMIT 4)"""), text=("token_count",))
def m8_v9_hybrid_search_in_document(spark, d):
    return _shown(S.search(_chunks(spark, d), "The of!", 4, "hybrid", 2, make=lambda: lambda texts: [QUERY for _ in texts]))


def _shown(df):
    return df.select("id", "document_id", F.md5("content").alias("content"), "score", F.round("metadata.quality_score", 6).alias("quality_score"), "metadata.chunk_index", "metadata.token_count")


@plans.add("v11_query_checks", "SELECT doc_id, CASE WHEN length(regexp_replace(q, '^\\s+|\\s+$', '', 'g')) NOT BETWEEN 1 AND 1000 THEN 'INVALID_QUERY' WHEN doc_id % 120 NOT BETWEEN 1 AND 100 THEN 'INVALID_TOP_K' END AS error FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN concat(' ', chr(9)) ELSE concat(text, ' ') END AS q FROM documents)")
def v11_query_checks(spark, d):
    q = F.when(F.col("doc_id") % 5 == 0, " \t").otherwise(F.concat("text", F.lit(" ")))
    return table(spark, d, "documents").select("doc_id", S.query_error(q, F.col("doc_id") % 120).alias("error"))


@plans.add("v12_table_info", "SELECT count(*) AS points, 64 AS size, 'green' AS status FROM embeddings")
def v12_table_info(spark, d):
    return S.table_info(table(spark, d, "embeddings"), "embedding")


_HASH = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(text, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296)"


@plans.add("v1_v4_v5_embeddings", f"SELECT doc_id, 384 AS size, round((sin(h) * 0.5)::FLOAT::DOUBLE, 5) AS first, round((sin(h + 383) * 0.5)::FLOAT::DOUBLE, 5) AS last FROM (SELECT doc_id, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS h FROM (SELECT doc_id, {_HASH} AS h FROM documents))")
def v1_v4_v5_embeddings(spark, d):
    rows = S.embed(table(spark, d, "documents").select("doc_id", "text"), "text")
    return rows.select("doc_id", F.size("dense").alias("size"), F.round(F.get("dense", F.lit(0)).cast("double"), 5).alias("first"), F.round(F.get("dense", F.lit(383)).cast("double"), 5).alias("last"))


_TERMS = "array_to_string(list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]', ' ', 'g'), ' '), lambda x: x <> ''), ' ')"
_SIZED = "text IS NOT NULL AND length(trim(text)) BETWEEN 1 AND 1000"


@plans.add("v3_query_embedding", f"SELECT conv_id, turn, 384 AS size, round((sin(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) * 0.5)::FLOAT::DOUBLE, 5) AS first, {_TERMS} AS terms FROM (SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text, {_HASH.replace('(text', "(trim(text, ' ' || chr(9) || chr(10) || chr(13))")} AS h FROM conversations WHERE {_SIZED})")
def v3_query_embedding(spark, d):
    """Each turn of a conversation as a query: trimmed, checked, embedded, and cut into words."""
    rows = table(spark, d, "conversations").where(S.query_error(F.col("text"), F.lit(5)).isNull())
    return S.embed_queries(rows, "text").select("conv_id", "turn", F.size("dense").alias("size"), F.round(F.get("dense", F.lit(0)).cast("double"), 5).alias("first"), F.array_join("terms", " ").alias("terms"))
