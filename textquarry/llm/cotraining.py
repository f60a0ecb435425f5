"""Quality classification by co-training.

Two views of a document share no feature. Its text content: hashed 3-grams of its letters alone (case, digits, marks and line ends taken out),
and how varied its words are. Its page metadata: source, language, length, and how the page is set: lines, capitals, digits, marks and
symbols, of which the content view sees nothing. A logistic classifier of each view learns from labelled rows; over rounds each hands those
judgements of unlabelled rows that it is sure of (SURE or more) to the other as labels, of all rows, whatever their number: the tasks add up what these
labels say of the other's loss, its slope and curvature, and the other takes Newton's steps on it. Both are then calibrated on labelled rows that neither learned from, and
a document's log-odds are the sum of both views' less those of the labels' share, as of two witnesses that don't confer.

Null and empty texts have no content view: the metadata alone decide. Without labels of both kinds every document scores 0.5 and
is kept. Null keys and repeated rows are kept, as are other columns, whatever their names; of a labelled key with several rows one is
learned from. A missing source is a value of its own. An empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import fresh, held_out, table, trainable, with_columns

#: Hashed 3-grams and four numbers of words, each also as one of STEPS steps; hashed sources and languages beside the page's numbers.
GRAMS, STEPS, SOURCES, LANGS = 512, 8, 32, 8
CONTENT, META = GRAMS + 4 * (STEPS + 1), SOURCES + LANGS + 12
#: Bound: labelled rows of each class. Then how the co-training goes: rounds, how sure a judgement must be, what all pseudo-labels weigh beside the
#: labels, and of how few of a class nothing is learned.
LABELLED, ROUNDS, SURE, PSEUDO, FEWEST = 2500, 3, 0.97, 0.3, 5
THRESHOLD = 0.5

_LETTER = np.full(256, 32, dtype=np.uint8)  # a letter's lower case; all else is a blank
_LETTER[97:123] = _LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def content_view(data: bytes) -> np.ndarray:
    """Root of the share of each hashed 3-gram of the whole text's letters, words apart by one blank; then how many of its words differ,
    how often one stands next to itself, how many are short, and how long they are."""
    out = np.zeros(CONTENT, dtype=np.float32)
    x = _LETTER[np.frombuffer(data, dtype=np.uint8)]
    blank = x == 32
    x = x[~(blank & np.concatenate([[False], blank[:-1]]))] if len(x) else x
    if len(x) < 3:
        return out
    words = x.tobytes().split()
    n = max(1, len(words))
    differ = len(set(words)) / n / max(0.2, min(1.0, 60 / math.sqrt(n + 1)))
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    numbers = (min(1.0, differ / 2), again, sum(len(w) < 4 for w in words) / n, min(1.0, len(x) / n / 16))
    for i, v in enumerate(numbers):
        out[GRAMS + i] = v
        out[GRAMS + 4 + i * STEPS + min(STEPS - 1, int(v * STEPS))] = 1.0
    x = x.astype(np.uint32)
    h = (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    out[:GRAMS] = np.sqrt(np.bincount(h >> np.uint32(23), minlength=GRAMS) / (len(x) - 2))
    return out


_CLASS = np.zeros(256, dtype=np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 sentence mark, 7 symbol, 8 beyond ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[32], _CLASS[10] = 1, 2, 3, 4, 5
for _c in b".,;:!?":
    _CLASS[_c] = 6
for _c in b"#$%&*+/<=>@\\^_`{|}~[]":
    _CLASS[_c] = 7
_CLASS[128:] = 8


def metadata_view(data: bytes, lang: str | None, source: str | None) -> np.ndarray:
    out = np.zeros(META, dtype=np.float32)
    raw = np.frombuffer(data, dtype=np.uint8)
    n = max(1, len(raw))
    share = np.bincount(_CLASS[raw], minlength=9) / n
    letters = share[1] + share[2] + share[8]
    out[:8] = [share[0], share[2] / max(letters, 1e-6), share[3], share[4], share[5], share[6], share[7], letters]
    out[8] = math.log1p(len(raw)) / 10
    lines = int((raw == 10).sum()) + 1
    out[9], out[10], out[11] = math.log1p(n / lines) / 10, math.log1p(lines) / 10, 1.0
    for at, width, value in ((12, SOURCES, source), (12 + SOURCES, LANGS, lang)):
        out[at + zlib.crc32((value or "").encode("utf-8", "surrogatepass")) % width] = 1.0
    return out


def views(text: str | None, lang: str | None, source: str | None) -> tuple[np.ndarray, np.ndarray]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return content_view(data), metadata_view(data, lang, source)


def odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def calibrate(o: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[float, float]:
    """Platt scaling: slope and shift for log-odds, from rows the classifier didn't learn from that count ``share`` each."""
    unit = float(np.abs(o).mean()) or 1.0
    x = np.stack([o / unit, np.ones_like(o)], axis=1)
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    w, hold = np.array([1.0, 0.0]), 0.05

    def loss(w):
        z = x @ w
        return float(np.sum(share * (np.logaddexp(0, z) - t * z))) + 0.5 * hold * float(w @ w)

    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + hold * np.eye(2), x.T @ (share * (p - t)) + hold * w)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    a, b = w[0] / unit, w[1]
    return float(max(a, 1e-3)), float(b)


class View:
    """A logistic classifier of one view: columns are scaled by the labelled rows it began with."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.dev = x.mean(axis=0), x.std(axis=0) + 1e-3
        self.z, self.y = self.scaled(x), y
        self.share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
        self.hold, self.w = 1.0 / len(x), np.zeros(self.z.shape[1])
        self.fit()

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([(x - self.mean) / self.dev, np.ones((len(x), 1))])

    def raw(self) -> np.ndarray:
        """Weights and intercept for features as they are."""
        return np.append(self.w[:-1] / self.dev, self.w[-1] - float(np.dot(self.w[:-1] / self.dev, self.mean)))

    def fit(self, slope: np.ndarray | None = None, bend: np.ndarray | None = None) -> None:
        """Newton's steps on the labelled rows' class-balanced loss, and on that of pseudo-labelled rows as its ``slope`` and ``bend`` at the weights
        before say it (its expansion to second order)."""
        start, n = self.w, len(self.w)
        slope, bend = (np.zeros(n), np.zeros((n, n))) if slope is None else (slope, bend)

        def loss(w):
            o, d = self.z @ w, w - start
            return float(self.share @ (np.logaddexp(0, o) - self.y * o)) + 0.5 * self.hold * float(w @ w) + float(slope @ d) + 0.5 * float(d @ bend @ d)

        w = start
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(self.z @ w, -30, 30)))
            down = self.z.T @ (self.share * (p - self.y)) + self.hold * w + slope + bend @ (w - start)
            curve = (self.z * (self.share * p * (1 - p))[:, None]).T @ self.z + bend + self.hold * np.eye(n)
            step, size, now = np.linalg.solve(curve, down), 1.0, loss(w)
            while size > 1e-4 and loss(w - size * step) > now:
                size /= 2
            w = w - size * step
            if float(np.abs(step).max()) * size < 1e-6:
                break
        self.w = w


def sums(x: np.ndarray, view: View, label: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, slope, bend) of the logistic loss of rows under one label, at the view's weights."""
    z = view.scaled(x)
    p = 1 / (1 + np.exp(-np.clip(z @ view.w, -30, 30)))
    return len(x), z.T @ (p - label), (z * (p * (1 - p))[:, None]).T @ z


def judged(xc: np.ndarray, xm: np.ndarray, views: tuple[View, View]) -> dict[tuple[int, int], tuple[int, np.ndarray, np.ndarray]]:
    """By (view that learns, label): the sums of the rows that the other view is sure of."""
    out, xs = {}, (xc, xm)
    for giver in (0, 1):
        p = 1 / (1 + np.exp(-np.clip(odds(xs[giver], views[giver].raw()), -30, 30)))
        some = xc.any(axis=1)  # a text without content judges nothing and teaches the content view nothing
        for label, sure in ((1, p), (0, 1 - p)):
            out[1 - giver, label] = sums(xs[1 - giver][some & (sure >= SURE)], views[1 - giver], label)
    return out


Exchange = Callable[[tuple[View, View]], dict]


class CoTrained:
    def __init__(self, content=None, meta=None, scale=None, prior=0.0):
        self.content, self.meta, self.scale, self.prior = content, meta, scale, prior

    @classmethod
    def fit(cls, xc: np.ndarray, xm: np.ndarray, y: np.ndarray, exchange: Exchange, every: tuple[int, int] | None = None) -> "CoTrained":
        """``y``: 0 or 1. A fifth of the rows is left for calibration. ``exchange`` gives ``judged`` of all unlabelled rows. ``every``: how many
        labelled rows of either class there are, where fewer were taken."""
        if (y == 0).sum() < 5 or (y == 1).sum() < 5:
            return cls()
        every = every or (int((y == 0).sum()), int((y == 1).sum()))
        spare = np.arange(len(y)) % 5 == 4
        views = tuple(View(x[~spare].astype(np.float64), y[~spare].astype(np.float64)) for x in (xc, xm))
        for _ in range(ROUNDS):
            found = exchange(views)
            for i, view in enumerate(views):
                slope, bend = np.zeros(len(view.w)), np.zeros((len(view.w),) * 2)
                for label in (0, 1):
                    n, g, h = found[i, label]
                    if n >= FEWEST:
                        slope, bend = slope + 0.5 * PSEUDO / n * g, bend + 0.5 * PSEUDO / n * h
                view.fit(slope, bend)
        models = [v.raw() for v in views]
        # calibration restores the share of classes that balancing, and the bound on rows, took out
        z = y[spare].astype(float)
        share = np.where(z == 1, every[1] / max(1.0, z.sum()), every[0] / max(1.0, (1 - z).sum()))
        share *= len(z) / share.sum()
        scale = [calibrate(odds(x[spare], m), z, share) for x, m in zip((xc, xm), models, strict=True)]
        return cls(models[0], models[1], scale, math.log(every[1] / every[0]))

    def score(self, text, lang, source) -> tuple[float, float, float]:
        """Probability of good quality by content, by metadata, and by both."""
        if self.content is None:
            return 0.5, 0.5, 0.5
        c, m = views(text, lang, source)
        a, b = (s[0] * float(odds(x, w)) + s[1] for x, w, s in ((c, self.content, self.scale[0]), (m, self.meta, self.scale[1])))
        if not c.any():
            a = self.prior
        return tuple(1 / (1 + math.exp(-max(-30.0, min(30.0, v)))) for v in (a, b, a + b - self.prior))


def unpacked(c: list[bytes], m: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(c), "<f2").reshape(-1, CONTENT).astype(np.float32), np.frombuffer(b"".join(m), "<f4").reshape(-1, META)


def viewed(rows: DataFrame) -> DataFrame:
    """``rows`` (k, t, l, s, ...) with both views in place of t, l and s."""

    def make():
        def run(b):
            both = [views(*r) for r in zip(*(b.column(n).to_pylist() for n in ("t", "l", "s")), strict=True)]
            return [[c.astype("<f2").tobytes() for c, _ in both], [m.astype("<f4").tobytes() for _, m in both]]

        return run

    return with_columns(rows, "c binary, m binary", make, drop=("t", "l", "s"))


#: Rows whose sums one task adds up, and tasks whose sums another one adds up.
PER_TASK, FAN_IN = 20_000, 32


def exchanged(pool: DataFrame, models: tuple[View, View], tasks: int) -> dict:
    """``judged`` of all rows of ``pool`` (c, m). Each of at most ``tasks`` tasks sums its own rows, steps of FAN_IN add the tasks' sums up, and at most two of them
    reach the driver. Curvatures are symmetric, so half of each is sent."""
    bare = []
    for v in models:  # the labelled rows stay where they are
        x = View.__new__(View)
        x.mean, x.dev, x.w = v.mean, v.dev, v.w
        bare.append(x)
    shared = pool.sparkSession.sparkContext.broadcast(tuple(bare))
    names = ["at", "view", "label", "n", "g", "h"]

    def rows(total, at):
        for (view, label), (n, g, h) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([view]), pa.array([label]), pa.array([n]), pa.array([g.tobytes()], pa.binary()), pa.array([h[np.triu_indices(len(g))].tobytes()], pa.binary())], names=names)

    def part_of(r):
        g = np.frombuffer(r["g"])
        h = np.zeros((len(g), len(g)))
        h[np.triu_indices(len(g))] = np.frombuffer(r["h"])
        return r["n"], g, np.triu(h) + np.triu(h, 1).T

    def add(total, key, part):
        total[key] = part if key not in total else tuple(a + b for a, b in zip(total[key], part, strict=True))

    def each(batches):
        from pyspark import TaskContext

        total = {}
        for b in batches:
            for key, part in judged(*unpacked(b.column("c").to_pylist(), b.column("m").to_pylist()), shared.value).items():
                add(total, key, part)
        yield from rows(total, TaskContext.get().partitionId())

    def together(batches):
        total, at = {}, 0
        for b in batches:
            for r in b.to_pylist():
                at = r["at"]
                add(total, (r["view"], r["label"]), part_of(r))
        yield from rows(total, at)

    kind = "at long, view long, label long, n long, g binary, h binary"
    parts, n = pool.select("c", "m").coalesce(tasks).mapInArrow(each, kind), tasks
    while n > 2:
        n = -(-n // FAN_IN)
        parts = parts.repartition(n, F.pmod("at", F.lit(n))).mapInArrow(together, kind)
    total = {(i, y): (0, np.zeros(w + 1), np.zeros((w + 1, w + 1))) for i, w in enumerate((CONTENT, META)) for y in (0, 1)}
    for r in sorted(parts.collect(), key=lambda r: r["at"]):
        add(total, (r["view"], r["label"]), part_of(r))
    return total


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> CoTrained:
    """From at most LABELLED rows of each class, those of least key hash, one row a key, and from all other rows as unlabelled ones, each as often as it
    occurs: their views are made once, and each round is one pass over these."""
    known = labels.where(F.col("quality").isin(0, 1) & trainable(key)).groupBy(F.col(key).alias("k")).agg(F.max(F.col("quality").cast("int")).alias("y")).where("k IS NOT NULL")
    every = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(every) < 2:
        return CoTrained()
    near = lambda y: known.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(LABELLED)
    kind = known.schema
    picked = docs.sparkSession.createDataFrame(near(0).unionByName(near(1)).collect(), kind)  # 5,000 keys at most
    column = lambda n: F.col(n) if n in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), column(lang).alias("l"), column(source).alias("s"))
    seen = viewed(rows.join(F.broadcast(picked), "k").select(F.xxhash64("k").alias("h"), "y", "t", "l", "s"))
    # bounded: 5,000 rows of 2 kB, as a repeated key counts once
    got = sorted(seen.groupBy("h").agg(F.min(F.struct("y", "c", "m")).alias("x")).select("h", "x.*").collect(), key=lambda r: r["h"])
    y = np.array([r["y"] for r in got])
    if (y == 0).sum() < 5 or (y == 1).sum() < 5:
        return CoTrained()
    # on the executors' disks for the rounds; what a lost one held is worked out anew from the texts
    pool = viewed(rows.join(F.broadcast(picked), "k", "left_anti").select("t", "l", "s")).persist(StorageLevel.DISK_ONLY)
    tasks = max(1, -(-pool.count() // PER_TASK))
    model = CoTrained.fit(*unpacked([r["c"] for r in got], [r["m"] for r in got]), y, lambda models: exchanged(pool, models, tasks), (every[0], every[1]))
    pool.unpersist()
    return model


def score(docs: DataFrame, model: CoTrained, text: str = "text", lang: str = "lang", source: str = "source", names: tuple[str, str, str] = ("content_score", "meta_score", "quality_score")) -> DataFrame:
    """``docs`` with three scores at the end: by content, by metadata, by both."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CONTENT + META numbers

    def make():
        m = shared.value

        def run(b):
            columns = [b.column(n).to_pylist() if n in b.schema.names else [None] * len(b) for n in (text, lang, source)]
            rows = [m.score(*r) for r in zip(*columns, strict=True)]
            return list(zip(*rows, strict=True)) if rows else [[], [], []]

        return run

    return with_columns(docs, ", ".join(f"`{n}` double" for n in names), make)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents at or over the threshold, with their columns."""
    names = tuple(fresh(docs.columns, "content_score", "meta_score", "quality_score"))
    return score(docs, learn(docs, labels), names=names).where(F.col(names[2]) >= THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_cotraining_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "content_score", "meta_score", F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
