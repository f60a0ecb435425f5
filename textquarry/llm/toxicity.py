"""Toxicity by a weighted finite-state grammar over clauses.

A clause is read as symbols: insults (a fixed list, and words and word beginnings learned from labels), threats, targets, negations,
verbs of report, quotation marks, colons and other words. Four weighted transducers rewrite them: one lowers what a negation reaches, one
raises insults aimed at a target, one keeps a threat only in a clause that has a target, before or after it, and one lowers what is
reported, be it after the verb, across a colon, or in quotation marks that a verb of report follows. They are composed into one machine;
a clause's weight is that of its best accepted reading (the mildest, should there be several). Clauses end at ``. ! ? ;`` and line ends,
not at colons, nor before a closing quotation mark. A document is scored from its clauses: the heaviest, their sum and their share; the
scale is a logistic fit on labelled rows. Every hit of the whole text is looked up, and each clause with one is read once.

Null and empty texts get the score of a text without matched clauses. Null keys, repeated rows and other columns pass; of a labelled key
with several texts one is learned from. Without labelled rows of both kinds the fixed lists and a fixed scale are used. An empty table gives no
rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import discard, fresh, held_out, materialise, shingle_hashes, table, trainable, with_columns

#: The grammar's word lists (English, German, French, Spanish).
INSULTS = (
    "idiot idiots moron morons imbecile stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown filth vermin "
    "bastard bitch asshole retard retarded idiota imbécil estúpido estúpida basura idiote imbécile connard salaud ordure "
    "dummkopf trottel abschaum arschloch schwachkopf"
).split()
THREATS = "kill murder hurt destroy shoot stab beat burn hang töten umbringen vernichten tuer frapper détruire matar destruir golpear".split()
TARGETS = "you your yours he his him she her they them their du dein dich euch ihr tu toi ton vous ils elle tú ti usted ellos ella".split()
NEGATIONS = "not no never n't don't isn't aren't won't kein keine nicht nie niemals ne pas jamais nunca jamás ni".split()
REPORTS = "said says say told claimed claims quoted wrote reported according sagte sagt schrieb dit disait écrit dijo dice escribió".split()

#: Bound: labelled rows of each class to learn from.
ROWS = 6000
PREFIXES = (4, 5, 6)
LEAST = 3
#: The grammar's weights: of what is negated, reported, aimed; and how many words a negation reaches and a verb of report may stand off.
NEGATED, REPORTED, AIMED, REACH, OFF = 0.4, 0.5, 1.3, 3, 3

_END = re.compile(r'[.!?;]++(?!["”»])|\n')
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[:\"“”«»„]")
SYMBOLS = ("insult", "threat", "target", "negation", "report", "quote", "colon", "word")
WEIGHED = ("insult", "threat")

Arc = tuple[object, str, float]  # next state, output symbol, weight


class Transducer:
    """States with arcs: ``step(state, symbol)`` gives the arcs, several where the machine guesses, none where a reading dies."""

    def __init__(self, start, final: Callable[[object], bool], step: Callable[[object, str], list[Arc]]):
        self.start, self.final, self.step = start, final, step

    def then(self, other: "Transducer") -> "Transducer":
        """Composition: what this one writes the other reads, and weights multiply."""

        def step(state, symbol):
            return [((a, b), y, v * w) for a, x, v in self.step(state[0], symbol) for b, y, w in other.step(state[1], x)]

        return Transducer((self.start, other.start), lambda s: self.final(s[0]) and other.final(s[1]), step)

    def table(self) -> tuple[list[dict[str, list[tuple[int, float]]]], list[bool]]:
        """All reachable states by number: for each symbol (next state, weight; 0 where nothing that weighs is written), and whether final."""
        number, rows, final = {self.start: 0}, [], []
        queue = [self.start]
        for state in queue:
            row = {}
            for symbol in SYMBOLS:
                arcs = []
                for after, out, weight in self.step(state, symbol):
                    if after not in number:
                        number[after] = len(number)
                        queue.append(after)
                    arcs.append((number[after], weight if out in WEIGHED else 0.0))
                row[symbol] = arcs
            rows.append(row)
            final.append(self.final(state))
        return rows, final


def negation(weight: float = NEGATED, reach: int = REACH) -> Transducer:
    """State: how many words the last negation still reaches; quotation marks and colons end it."""

    def step(left, x):
        if x == "negation":
            return [(reach, "word", 1.0)]
        if x in ("quote", "colon"):
            return [(0, x, 1.0)]
        return [(max(0, left - 1), x, weight if left and x in WEIGHED else 1.0)]

    return Transducer(0, lambda s: True, step)


def aim(weight: float = AIMED) -> Transducer:
    """State: whether a target came before."""
    return Transducer(False, lambda s: True, lambda aimed, x: [(aimed or x == "target", x, weight if aimed and x == "insult" else 1.0)])


def threats() -> Transducer:
    """A threat without a target yet is read twice: as one whose target comes (``owed``, not final before it does) and as none (``never``, which dies
    at a target)."""

    def step(state, x):
        if x == "target":
            return [] if state == "never" else [("seen", x, 1.0)]
        if x != "threat":
            return [(state, x, 1.0)]
        if state == "none":
            return [("owed", x, 1.0), ("never", "word", 1.0)]
        return [(state, "word" if state == "never" else x, 1.0)]

    return Transducer("none", lambda s: s != "owed", step)


def report(weight: float = REPORTED, off: int = OFF) -> Transducer:
    """After a verb of report all is reported. A quotation is read twice: as one that such a verb follows within ``off`` words (``cited``), and as
    one that none follows (``own``); each reading dies where it turns out wrong."""

    def step(state, x):
        kind, n = state
        if kind == "told":
            return [(state, x, weight if x in WEIGHED else 1.0)]
        if x == "quote":
            if kind in ("in cited", "in own"):
                return [((kind.replace("in", "after"), 0), x, 1.0)]
            return [(("in cited", 0), x, 1.0)] + ([] if kind == "after cited" else [(("in own", 0), x, 1.0)])
        if kind in ("in cited", "in own"):
            return [(state, x, weight if kind == "in cited" and x in WEIGHED else 1.0)]
        if x == "report":
            return [] if kind == "after own" else [(("told", 0), x, 1.0)]
        if kind == "plain":
            return [(state, x, 1.0)]
        if n < off:
            return [((kind, n + 1), x, 1.0)]
        return [] if kind == "after cited" else [(("plain", 0), x, 1.0)]

    return Transducer(("plain", 0), lambda s: s[0] not in ("in cited", "after cited"), step)


def composed(negated: float = NEGATED, aimed: float = AIMED, reported: float = REPORTED):
    """The whole grammar as one table."""
    return negation(negated).then(aim(aimed)).then(threats()).then(report(reported)).table()


class Grammar:
    """``learned``: words, and word beginnings with a final ``*``, and their weights. ``marks``: the weights of negation, aim and report."""

    def __init__(self, learned: dict[str, float], scale: np.ndarray | None = None, marks: tuple[float, float, float] = (NEGATED, AIMED, REPORTED)):
        import ahocorasick

        self.learned, self.scale, self.marks = learned, scale, marks
        self.words = {w: 3.0 for w in INSULTS} | {w: v for w, v in learned.items() if not w.endswith("*")}
        self.begins = {w[:-1]: v for w, v in learned.items() if w.endswith("*")}
        self.fixed = {":": ("colon", 0.0)} | dict.fromkeys('"“”«»„', ("quote", 0.0)) | dict.fromkeys(THREATS, ("threat", 2.0))
        self.fixed |= dict.fromkeys(TARGETS, ("target", 0.0)) | dict.fromkeys(REPORTS, ("report", 0.0)) | dict.fromkeys(NEGATIONS, ("negation", 0.0))
        self.rows, self.final = composed(*marks)
        self.finder = ahocorasick.Automaton()
        for w in {*self.words, *self.begins, *THREATS}:
            self.finder.add_word(w, len(w))
        self.finder.make_automaton()

    def __reduce__(self):
        return Grammar, (self.learned, self.scale, self.marks)

    def read(self, token: str) -> tuple[str, float]:
        """Symbol and weight of a token."""
        if (known := self.fixed.get(token)) is not None:
            return known
        weight = self.words.get(token)
        if weight is None:
            weight = max((self.begins[token[:k]] for k in PREFIXES if token[:k] in self.begins), default=0.0)
        return ("insult", weight) if weight else ("word", 0.0)

    def clause(self, tokens: Iterable[str]) -> float:
        """Weight of a clause's best accepted reading."""
        active = {0: 0.0}
        for token in tokens:
            symbol, value = self.read(token)
            after: dict[int, float] = {}
            for state, total in active.items():
                for to, weight in self.rows[state][symbol]:
                    new = total + value * weight
                    if to not in after or new < after[to]:
                        after[to] = new
            active = after
        return min((v for s, v in active.items() if self.final[s]), default=0.0)

    def features(self, text: str | None) -> list[float]:
        """Of the whole text: 1, heaviest clause, log of the sum, matched clauses by the text's length."""
        text = (text or "").lower()
        heaviest = total = 0.0
        matched, left, done, ends, end = 0, 0, -1, None, None
        for last, size in self.finder.iter(text):
            start = last - size + 1
            if start < done or (start and text[start - 1].isalpha()):
                continue
            if ends is None:
                ends = _END.finditer(text)
                end = next(ends, None)
            # the clause around the hit; its other hits are passed over
            while end and end.start() <= start:
                left, end = end.end(), next(ends, None)
            done = end.start() if end else len(text)
            if (w := self.clause(_TOKEN.findall(text, left, done))) > 0:
                heaviest, total, matched = max(heaviest, w), total + w, matched + 1
        return [1.0, math.log1p(heaviest), math.log1p(total), 1000 * matched / (len(text) + 500)]

    def score(self, text: str | None) -> float:
        scale = self.scale if self.scale is not None else np.array([-3.0, 2.0, 2.0, 0.1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(scale, self.features(text)))))))


def logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float = 0.05, steps: int = 25) -> np.ndarray:
    """Newton steps of a ridge logistic fit of rows that count ``share`` each; weights of matched clauses stay non-negative."""
    b = np.zeros(x.shape[1])
    hold = np.diag([1e-3] + [ridge] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        b = b - np.linalg.solve((x * (share * (p * (1 - p) + 1e-6))[:, None]).T @ x + hold, x.T @ (share * (p - y)) + hold @ b)
    b[1:] = np.maximum(b[1:], 0)
    return b


def entries(text: str) -> set[str]:
    """Words of a text, and their beginnings with a final ``*``."""
    words = set(re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", text.lower()))
    return words | {w[:k] + "*" for w in words for k in PREFIXES if len(w) > k}


def lexicon(counts: DataFrame, toxic: str, clean: str, n: tuple[int, int]) -> dict[str, float]:
    """Weights of the entries whose counts are too surprising to be chance, all of them; they come from the sample's words, which ROWS bounds. ``counts``: entry, and documents of either label with it;
    ``n``: clean and toxic documents."""
    if not n[0] or not n[1]:
        return {}
    c, o, base = F.col(toxic), F.col(clean), n[1] / (n[0] + n[1])
    tried = counts.where(c > 0).count()
    # surprise of the counts if the entry didn't matter, over all that were tried
    surprise = c * F.log(c / ((c + o) * base)) + F.when(o > 0, o * F.log(o / ((c + o) * (1 - base)))).otherwise(0.0)
    weight = F.log((c + 0.1) / (n[1] + 1) * (n[0] + 1) / (o + 0.5))
    rows = counts.where((c >= LEAST) & (c / n[1] >= 10 * o / n[0])).where(surprise >= math.log(100 * (tried + 1))).select("entry", weight.alias("weight"))
    return {r["entry"]: r["weight"] for r in rows.collect()}


def sample_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> tuple[DataFrame, dict[int, int]]:
    """(h, y, half, t) of at most ROWS labelled rows of each class, those of least key hash, one text a key; and how many labelled rows each class has."""
    ids = labels.where(trainable(key) & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("k")).agg(F.max(F.col(label).cast("int")).alias("y")).where("k IS NOT NULL")
    every = {r["y"]: r["n"] for r in ids.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    least = lambda y: ids.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(ROWS)
    picked = F.broadcast(least(1).unionByName(least(0)))  # at most twice ROWS short rows
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull()).join(picked, "k")
    rows = rows.groupBy("k").agg(F.min_by("t", F.struct(F.xxhash64("t"), F.length("t"))).alias("t"), F.max("y").alias("y"))
    return rows.select(F.xxhash64("k").alias("h"), "y", F.pmod(F.xxhash64("k", F.lit(1)), F.lit(2)).cast("int").alias("half"), "t").repartition(24, "h"), every


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Grammar:
    """The lexicon from one half of the sample and the scale from the other half's clauses, then the lexicon from all. The tasks count and
    measure; only the lexicon and three numbers a row come to the driver."""
    spark = docs.sparkSession
    sample, every = sample_rows(docs, labels, key, text, label)
    if len(every) < 2:
        return Grammar({})
    sample = materialise(sample, "toxic-sample")

    def marks():
        # copies of one text, exact or near, count once: most share the least hash of one of four parts of their shingles
        def run(b):
            shingles = [shingle_hashes(t) for t in b.column("t").to_pylist()]
            return [[[int(part.min() >> np.uint64(3)) * 4 + k for k in range(4) if len(part := s[s % np.uint64(4) == k])] for s in shingles]]

        return run

    marked = with_columns(sample, "marks array<long>", marks, drop=("t",))
    owners = marked.select("h", F.explode("marks").alias("m")).groupBy("m").agg(F.min("h").alias("h")).select("h").distinct()
    new = sample.join(F.broadcast(owners), "h")  # at most twice ROWS keys

    def count(batches):
        found: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
        seen = Counter()

        def rows():
            names, cells = list(found), list(found.values())
            out = [pa.array(names + [""], pa.string()), *(pa.array([c[i] for c in cells] + [seen[i]], pa.int64()) for i in range(4))]
            found.clear()
            seen.clear()
            return pa.RecordBatch.from_arrays(out, names=["entry", "o1", "c1", "o", "c"])

        for b in batches:
            for t, y, half in zip(b.column("t").to_pylist(), b.column("y").to_pylist(), b.column("half").to_pylist(), strict=True):
                at = (y, y + 2) if half == 0 else (y + 2,)  # counts of one half, counts of all
                seen.update(at)
                for w in entries(t):
                    cell = found[w]
                    for i in at:
                        cell[i] += 1
                if len(found) > 200_000:
                    yield rows()
        yield rows()

    counts = new.select("t", "y", "half").mapInArrow(count, "entry string, o1 long, c1 long, o long, c long")
    counts = materialise(counts.groupBy("entry").agg(*[F.sum(n).alias(n) for n in ("o1", "c1", "o", "c")]), "toxic-counts")
    total = counts.where("entry = ''").first()
    if total is None:  # no text of a labelled key
        return Grammar({})
    words = counts.where("entry <> ''")
    half = Grammar(lexicon(words, "c1", "o1", (total["o1"], total["c1"])))
    whole = lexicon(words, "c", "o", (total["o"], total["c"]))

    def measure():
        return lambda b: list(zip(*[half.features(t) for t in b.column("t").to_pylist()], strict=True)) if len(b) else [[]] * 4

    other = with_columns(sample.where("half = 1").select("y", "t"), "f0 double, f1 double, f2 double, f3 double", measure, drop=("t",))
    got = np.array([tuple(r) for r in other.collect()], dtype=float).reshape(-1, 5)  # at most twice ROWS
    discard(spark, sample, counts)
    y = got[:, 0]
    if len(set(y)) < 2:
        return Grammar(whole)
    # the classes count as among all labelled rows, however many of each were taken
    share = np.where(y == 1, every[1] / max(1, (y == 1).sum()), every[0] / max(1, (y == 0).sum()))
    return Grammar(whole, logistic(got[:, 1:], y, share * len(y) / share.sum()))


def score(docs: DataFrame, grammar: Grammar, text: str = "text", name: str = "tox_score") -> DataFrame:
    """``docs`` with a score at the end, under ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)  # bounded by the sample of labelled rows

    def make():
        g = shared.value
        return lambda b: [[g.score(t) for t in b.column(text).to_pylist()]]

    return with_columns(docs, f"`{name}` double", make)


THRESHOLD = 0.7


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents under the threshold, with their columns."""
    (name,) = fresh(docs.columns, "tox_score")
    return score(docs, learn(docs, labels), name=name).where(F.col(name) < THRESHOLD).drop(name)


def op10_toxicity_grammar(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs.select("doc_id", "text"), learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= THRESHOLD).cast("int").alias("predicted"))
