"""Hard negatives by product quantisation with stored residual norms.

Vectors are cut into parts; each part is coded by the nearest of up to 256 centroids (fitted on a bounded sample), and what the codes leave
over is kept as the norm of the residual. For an anchor, a table of its products with all centroids gives each row's score by lookups, off by
at most the anchor's norm times the row's residual norm. So each row has a certain range of scores. A row is passed over only if its range
lies outside the window, or under the k-th best lower bound of rows that surely lie in the window; all others get their exact integer
product. Nothing is lost: the result is that of comparing all rows, whatever the centroids.

Rows and anchors are packed in blocks; each block of anchors meets each block of rows in a task of its own, which gives back at most k rows
an anchor and window, and a ranking of these (cut before the shuffle, too) gives the whole's. First come an anchor's positives, whose
scores then set the windows of its negatives.

Rows with a null label, a null vector, or a null or non-finite component take no part. Shorter vectors count as filled up with zeros. Each row
stands for itself: copies of an anchor are other rows, with their own positives, and equal rows give equal rows. Ties go to the smaller key, null keys last; a null key
is no anchor. Scores are 64-bit integers: components beyond about 2^28 (2^20 before scaling) at 64 dimensions leave them. Other
columns are left out. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.llm.common import discard, materialise, table

#: Parts of a vector, centroids of each, rows they are fitted on at most, rounds of the fit.
PARTS, CENTROIDS, SAMPLE, ROUNDS = 32, 256, 8192, 6
#: Rows and anchors of a block; an anchor block is copied to SALTS, over which row blocks are dealt.
BLOCK, ANCHORS, SALTS = 2048, 256, 64
POSITIVES, NEGATIVES = 5, 3
#: Per cent of the positive's score: the window of a negative's.
LOWEST, HIGHEST = 50, 95
NULL_KEY = np.iinfo(np.int64).max


def usable(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, label, v) of the rows that take part: v is floor(256 x) of each component."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    made = rows.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), x.alias("x"))
    return made.where(F.forall("x", fine)).select("id", "label", F.transform("x", lambda c: F.floor(c * 256)).alias("v"))


def fit(sample: np.ndarray, parts: int = PARTS, centroids: int = CENTROIDS, rounds: int = ROUNDS) -> list[tuple[slice, np.ndarray]]:
    """(columns, centroids) of each part, by Lloyd's rounds from evenly spaced rows."""
    out = []
    for cols in np.array_split(np.arange(sample.shape[1]), min(parts, max(1, sample.shape[1]))):
        cut = slice(int(cols[0]), int(cols[-1]) + 1) if len(cols) else slice(0, 0)
        x = sample[:, cut]
        known = np.unique(x, axis=0)
        c = known[np.linspace(0, len(known) - 1, min(centroids, len(known))).astype(int)]
        for _ in range(rounds):
            code = nearest(x, c)
            n = np.bincount(code, minlength=len(c))
            sums = np.stack([np.bincount(code, x[:, j], len(c)) for j in range(x.shape[1])], axis=1) if x.shape[1] else np.zeros((len(c), 0))
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        out.append((cut, c))
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1) - 2.0 * (x @ c.T)).argmin(axis=1)


def encode(x: np.ndarray, book: list[tuple[slice, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (a row a vector, a byte a part) and residual norms."""
    codes, left = np.empty((len(x), len(book)), np.uint8), np.zeros(len(x))
    for j, (cut, c) in enumerate(book):
        codes[:, j] = nearest(x[:, cut], c)
        left += ((x[:, cut] - c[codes[:, j]]) ** 2).sum(axis=1)
    return codes, np.sqrt(left)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors, pair by pair: (rows of a) x (rows of b). Doubles where all sums stay under 2^53."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if top < 2**53 else a @ b.T


def estimates(anchors: np.ndarray, codes: np.ndarray, left: np.ndarray, book: list[tuple[slice, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Lookup-table scores (anchors x rows), and how far they may be off at most."""
    a = anchors.astype(np.float64)
    score, size = np.zeros((len(codes), len(a))), np.zeros(len(codes))
    for j, (cut, c) in enumerate(book):
        score += (c @ a[:, cut].T)[codes[:, j]]
        size += (c**2).sum(axis=1)[codes[:, j]]
    norm = np.sqrt((a * a).sum(axis=1))
    # rounding of the sums themselves: far less than one part in 10^10 of the norms
    return score.T, norm[:, None] * (left + 1e-10 * (np.sqrt(size) + left) + 1e-9)[None, :]


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    return np.lexsort((ids, -scores))[:k]


def meet(anchors: dict[str, np.ndarray], rows: dict[str, np.ndarray], book, k: int, same: bool) -> Iterator[dict[str, np.ndarray]]:
    """For each anchor of a block (and window low..high of scores times 100) the k best rows of a block of rows of the anchor's label, or of the
    others: exact, after ruling out by estimates."""
    if not len(anchors["id"]) or not len(rows["id"]):
        return
    score, off = estimates(anchors["v"], rows["codes"], rows["left"], book)
    lower, upper = score - off, score + off
    alike = anchors["label"][:, None] == rows["label"][None, :]
    fit_in = alike & (anchors["row"][:, None] != rows["row"][None, :]) if same else ~alike
    for i in range(len(anchors["id"])):
        low, high = (float(anchors[x][i]) / 100 for x in ("low", "high"))
        slack = 1e-9 * (abs(low) + abs(high) + 1) if np.isfinite(low) else 0.0
        may = np.flatnonzero(fit_in[i] & (upper[i] >= low - slack) & (lower[i] <= high + slack))
        sure = lower[i][may][(upper[i][may] <= high - slack) & (lower[i][may] >= low + slack)]
        if len(sure) >= k:
            may = may[upper[i][may] >= np.partition(sure, len(sure) - k)[len(sure) - k]]
        if not len(may):
            continue
        exact = products(anchors["v"][i : i + 1], rows["v"][may])[0]
        if np.isfinite(low):
            inside = (100 * exact >= anchors["low_exact"][i]) & (100 * exact <= anchors["high_exact"][i])
            may, exact = may[inside], exact[inside]
        top = best(rows["id"][may], exact, k)
        yield {"anchor": np.full(len(top), anchors["row"][i]), "anchor_id": np.full(len(top), anchors["id"][i]), "positive_id": np.full(len(top), anchors["positive"][i]), "positive_at": np.full(len(top), anchors["at"][i]),
               "positive_score": np.full(len(top), anchors["positive_score"][i]), "id": rows["id"][may[top]], "score": exact[top]}


FOUND = "anchor long, anchor_id long, positive_id long, positive_at int, positive_score long, id long, score long"
_ANCHOR = ("row", "id", "label", "positive", "at", "positive_score")
_ROW = ("row", "id", "label")


def matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of one matrix, filled up with zeros."""
    sizes = np.diff(np.asarray(vectors.offsets))
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims)[None, :] < sizes[:, None]] = np.asarray(vectors.flatten())
    return out


def packed(df: DataFrame, size: int, dims: int, columns: tuple[str, ...], book=None) -> DataFrame:
    """(block, data): rows of ``df`` (columns and v) in blocks of at most ``size``, with codes and residual norms if there is a ``book``."""

    def run(batches):
        held, n = [], 0

        def block():
            whole = pa.Table.from_batches(held).slice(0, n)
            got = {c: np.asarray(whole[c].combine_chunks().cast(pa.int64()).fill_null(NULL_KEY)) for c in columns}
            got["v"] = matrix(whole["v"].combine_chunks(), dims)
            if book is not None:
                got["codes"], got["left"] = encode(got["v"].astype(np.float64), book)
            names = [*got]
            return pa.RecordBatch.from_arrays([pa.array([got[x].tobytes()], pa.binary()) for x in names], names=names)

        for b in batches:
            while len(b):
                part = b.slice(0, size - n)
                held.append(part)
                n, b = n + len(part), b.slice(len(part))
                if n == size:
                    yield block()
                    held, n = [], 0
        if n:
            yield block()

    names = [*columns, "v", *(["codes", "left"] if book is not None else [])]
    return df.select(*columns, "v").mapInArrow(run, ", ".join(f"`{x}` binary" for x in names))


def search(anchors: DataFrame, blocks: DataFrame, book, dims: int, k: int, same: bool) -> DataFrame:
    """The k best rows of each row of ``anchors`` (row, id, label, positive, at, positive_score, v) over all ``blocks``, with their ranks."""
    spark = anchors.sparkSession
    queries = materialise(packed(anchors, ANCHORS, dims, _ANCHOR).withColumn("own", F.monotonically_increasing_id()), "anchors")
    # a dense number for each anchor block, from counts by partition of the few that there are
    groups = max(1, queries.count())
    dense = queries.withColumn("g", F.row_number().over(Window.orderBy("own")) - 1).select("own", "g")
    queries = queries.join(dense, "own").drop("own")
    left = blocks.select(F.struct("*").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    left = left.withColumn("salt", F.pmod(F.xxhash64("r.row", "r.v"), F.lit(SALTS)))
    right = queries.select(F.struct(*_ANCHOR, "v").alias("q"), "g", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")).alias("salt"))
    pairs = left.join(right, ["g", "salt"]).select("q", "r")

    def ints(x, names):
        return {c: np.frombuffer(x[c], np.int64) for c in names} | {"v": np.frombuffer(x["v"], np.int64).reshape(-1, dims) if dims else np.zeros((len(x["row"]) // 8, 0), np.int64)}

    def run(batches):
        for b in batches:
            for j in range(len(b)):
                q, r = (ints(b.column(c)[j].as_py(), names) | {"raw": b.column(c)[j].as_py()} for c, names in (("q", _ANCHOR), ("r", _ROW)))
                r["left"] = np.frombuffer(r["raw"]["left"], np.float64)
                r["codes"] = np.frombuffer(r["raw"]["codes"], np.uint8).reshape(len(r["id"]), -1)
                if same:
                    q["low"], q["high"] = np.full(len(q["id"]), -np.inf), np.full(len(q["id"]), np.inf)
                else:
                    q["low_exact"], q["high_exact"] = LOWEST * q["positive_score"], HIGHEST * q["positive_score"]
                    q["low"], q["high"] = q["low_exact"], q["high_exact"]
                found = [*meet(q, r, book, k, same)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[c] for x in found])) for c in found[0]], names=[*found[0]]).cast(pa.schema([(f, pa.int32() if f == "positive_at" else pa.int64()) for f in found[0]]))

    found = pairs.mapInArrow(run, FOUND)
    order = Window.partitionBy("anchor", "positive_at").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column | None = None, label: Column | None = None, key: str = "vec_id", vector: str = "embedding", label_column: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). ``is_anchor`` and ``label`` are columns of (id, label)."""
    spark = rows.sparkSession
    is_anchor = F.col("id") % 50 == 0 if is_anchor is None else is_anchor
    made = usable(rows, key, vector, label_column)
    if label is not None:
        made = made.withColumn("label", label)
    made = materialise(made.withColumn("row", F.monotonically_increasing_id()), "vectors")
    dims = made.agg(F.max(F.size("v"))).first()[0] or 0
    spread = lambda c: F.xxhash64(c, "v")
    # the sample: the rows of least hash, so it doesn't depend on how the table is dealt out
    sample = np.zeros((0, dims))
    picked = made.orderBy(spread("id"), "id").select("v").limit(SAMPLE).collect()
    if picked:
        sample = np.array([[*r.v, *[0] * (dims - len(r.v))] for r in picked], np.float64).reshape(len(picked), dims)
    book = fit(sample) if picked else []
    blocks = materialise(packed(made, BLOCK, dims, _ROW, book), "blocks")
    blank = [F.lit(None).cast("long").alias("positive"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("positive_score")]
    anchors = made.where(is_anchor)
    positives = materialise(search(anchors.select("row", "id", "label", *blank, "v"), blocks, book, dims, POSITIVES, True).select("anchor", F.col("id").alias("positive"), F.col("rank").alias("at"), F.col("score").alias("positive_score")), "positives")
    asked = anchors.join(positives, F.col("row") == F.col("anchor")).where("positive_score >= 0")  # a window under a negative score is empty
    found = search(asked.select("row", "id", "label", "positive", "at", "positive_score", "v"), blocks, book, dims, NEGATIVES, False)
    whole = lambda c: F.when(F.col(c) != int(NULL_KEY), F.col(c))
    return found.select("anchor_id", whole("positive_id").alias("positive_id"), "rank", whole("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_product_quantised_negatives(spark, sf_dir: str) -> DataFrame:
    turned = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), label=turned)


SQL = f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INTEGER AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same WHERE {LOWEST} * p.score <= 100 * n.score AND 100 * n.score <= {HIGHEST} * p.score
QUALIFY rank <= {NEGATIVES}
"""
