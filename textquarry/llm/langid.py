"""Language identification by string kernels.

The kernel of two texts is the number of character n-grams (n from 1 to 4, blended) both have, presence only, divided by the root of
the product of their own numbers. A bounded sample of labelled texts trains it: some serve as Nystroem landmarks, one-versus-
rest kernel ridge regression is solved over the landmark map, and all texts are scored in batches by one matrix product. A long text
is read in segments of SEGMENT characters, so that presence never fills up, and stands in the kernel as the mean of all of them, in learning as
in prediction.

Null texts and texts without a letter are ``und`` with score 0. Null keys and repeated rows are kept. With no labelled rows every text is
``und``. Labels, sources and keys are no inputs of a prediction. Every language that has a labelled text can be predicted, however many there
are; the samples of each are smaller then. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.llm.common import held_out, table, trainable, with_columns

#: Width of the hashed presence vectors; n-grams that fall together count once.
WIDTH = 1 << 14
SPECTRUM = 4
#: Characters of a text that are compared at once.
SEGMENT = 8000
#: Bounds of what is learned from: texts a language and in all (but LEAST of each language), landmarks a language and in all.
TEXTS, ALL_TEXTS, LEAST, LANDMARKS, ALL_LANDMARKS = 250, 4000, 2, 40, 1000
OVER = 10
#: Languages whose counts are broadcast; beyond it they are joined by a shuffle.
BROADCAST = 100_000
RIDGE = 1e-3
BATCH = 64
_WORD = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether any character is a letter; numerals such as fractions, which count as word characters, are none."""
    return any(m[0].isalpha() for m in _WORD.finditer(text))


def presence(text: str, out: np.ndarray) -> None:
    """Marks the hashed n-grams of the whole lower-cased text in ``out`` (zeros of WIDTH)."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    gram = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, SPECTRUM + 1):
        if len(codes) < n:
            break
        gram = gram[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
        spread = gram * np.uint64(0xD6E8FEB86659FD93)
        out[(spread >> np.uint64(50)).astype(np.int64)] = 1.0


def kernel_rows(texts: list[str]) -> np.ndarray:
    """One row a text, so that the kernel is a plain matrix product: unit length, and of a long text the mean of its segments' rows."""
    x = np.zeros((len(texts), WIDTH), dtype=np.float32)
    for i, t in enumerate(texts):
        for at in range(0, len(t), SEGMENT):
            part = t[at : at + SEGMENT]
            row = np.zeros(WIDTH, dtype=np.float32)
            presence(part, row)
            x[i] += row * np.float32(len(part) / len(t) / max(1.0, math.sqrt(row.sum())))
    return x


class Model:
    def __init__(self, classes: list[str], landmarks: np.ndarray, weights: np.ndarray):
        self.classes, self.landmarks, self.weights = classes, landmarks, weights

    @classmethod
    def fit(cls, texts: list[str], langs: list[str]) -> "Model":
        return cls.fit_rows(kernel_rows(texts), langs)

    @classmethod
    def fit_rows(cls, x: np.ndarray, langs: list[str]) -> "Model":
        classes = sorted(set(langs))
        if not classes:
            return cls([], np.zeros((0, WIDTH), np.float32), np.zeros((0, 0), np.float32))
        y = np.array([classes.index(c) for c in langs])
        each = max(1, min(LANDMARKS, ALL_LANDMARKS // len(classes)))
        chosen = np.concatenate([np.flatnonzero(y == c)[:each] for c in range(len(classes))])[:ALL_LANDMARKS]
        marks = x[chosen]
        k = (x @ marks.T).astype(np.float64)
        values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
        keep = values > 1e-6 * values.max()
        root = vectors[:, keep] / np.sqrt(values[keep])  # landmark map: z = k @ root
        z = np.hstack([k @ root, np.ones((len(k), 1))])
        share = 1 / np.bincount(y, minlength=len(classes))[y]  # languages weigh alike
        target = np.where(y[:, None] == np.arange(len(classes)), 1.0, -1.0)
        zw = z * share[:, None]
        beta = np.linalg.solve(z.T @ zw + RIDGE * np.eye(z.shape[1]), zw.T @ target)
        # the map is folded into the weights: a text's scores are (x @ marks.T) @ weights + bias
        return cls(classes, marks, np.vstack([root @ beta[:-1], beta[-1:]]).astype(np.float32))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        todo = [i for i, t in enumerate(texts) if t and has_letter(t)] if self.classes else []
        if not todo:
            return lang, score
        values = lambda part: (kernel_rows([texts[i] for i in part]) @ self.landmarks.T) @ self.weights[:-1] + self.weights[-1]
        f = np.concatenate([values(todo[at : at + BATCH]) for at in range(0, len(todo), BATCH)]).astype(np.float64)
        sure = 1 / np.exp(3 * (f - f.max(axis=1, keepdims=True))).sum(axis=1)
        for i, b, s in zip(todo, f.argmax(axis=1).tolist(), sure.tolist(), strict=True):
            lang[i], score[i] = self.classes[b], s
        return lang, score


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """From a bounded number of texts of each language, those of least key hash: two passes over the keys and one over the texts. Their kernel rows come to the driver, at most ALL_TEXTS (or LEAST a language) of 32 kB."""
    rows = docs.where(trainable(key) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.xxhash64(key).alias("h"), F.col(lang).alias("label"), F.col(text).alias("t"))
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    languages = counts.count()
    if not languages:
        return Model.fit([], [])
    texts = max(LEAST, min(TEXTS, ALL_TEXTS // languages))
    # hashes are even, so the least of a language lie in its lowest part: about OVER times as many rows as are taken are ranked
    few = F.broadcast(counts) if languages <= BROADCAST else counts
    low = rows.select("h", "label").join(few, "label").where(F.col("h") / F.lit(2.0**64) + 0.5 <= F.lit(float(OVER * texts)) / F.col("n"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    picked = low.select("h", "label").withColumn("r", rank).where(F.col("r") <= texts).select("h", "label").distinct()

    def make():
        return lambda b: [[zlib.compress(r.astype("<f2").tobytes(), 1) for t in b.column("t").to_pylist() for r in kernel_rows([t])]]

    # the join is with at most that many short rows; a key with several texts gives one
    seen = with_columns(rows.join(F.broadcast(picked), ["h", "label"]).select("h", "label", "t"), "x binary", make, drop=("t",))
    got = sorted((r["h"], r["label"], bytes(r["x"])) for r in seen.groupBy("h", "label").agg(F.min("x").alias("x")).collect())
    x = np.stack([np.frombuffer(zlib.decompress(z), dtype="<f2").astype(np.float32) for _, _, z in got])
    return Model.fit_rows(x, [c for _, c, _ in got])


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH x landmarks numbers, bounded

    def make():
        m = shared.value
        return lambda b: list(m.predict(b.column("t").to_pylist()))

    return with_columns(docs.select(key, F.col(text).alias("t")), "lang_pred string, score double", make, drop=("t",))


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, learn(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
