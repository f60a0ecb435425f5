"""Near-duplicate classes by DartMinHash.

A text is the weighted set of its five-word shingles (weight: how often each occurs). Each element's weight axis is cut into
dyadic regions; hashed darts fall into a region as a Poisson process along the rank axis, at a rate of the region's width,
each with a place on the weight axis and a coordinate. A dart counts if its place lies under the element's weight; each
coordinate keeps its earliest dart. Two texts agree in a coordinate with the probability of their weighted Jaccard index.
Signatures are joined by bands, and every link is verified exactly.

Classes are built over different texts: exact copies are folded first. In each band each text is compared with the hub of its
bucket, the most central text there (that of the most bucket mates over all bands). A hub whose bucket mates still lie in
more than one class gets a second step, which finds every further link by an exact prefix filter rather than by pairs: all
bucket mates of a hub order their shingles alike, those outside the hub first. Two texts of similarity 0.8 or more share a
shingle within the first ninth of the shorter one and, depending on the sizes, the first ninth to fifth of the longer one,
with enough shingles from there on, outside and inside the hub, on both sides; and the parities of their shingles on 256 hash
bits differ in no more bits than their sets may differ in shingles. A text too far from the hub to be linked to it has more
than a ninth of its shingles outside the hub, so it meets only those texts that share its own changes (or are shorter by as
much as it is farther), not the whole group. Joins on a hub are dealt over salts, more for larger buckets.

A text without words is alike only to equal texts; null is read as empty. Null keys sort first. Repeated rows fall into one class.
Different texts, told apart by digest, are the nodes of every step; ids are joined on at the end, so rows of a null or repeated id
with different texts stand each for themselves. A class is named by its least (id, digest). An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import dealt_join, discard, fresh, hot_keys, materialise, mix64, shingle_hashes, some, table, whole_text, with_columns

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 4
K = BANDS * ROWS
SALTS = 16
PER_SALT = 256  # texts of a bucket that one salt of its hub takes
SIGN_AT_ONCE = 20_000  # shingles that are signed in one sweep
PARITY = ("p0", "p1", "p2", "p3")
BIN = 1.1  # ratio of the size bins of the prefix filter
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_UNIT = 1.0 / (1 << 53)


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * _UNIT


def weighted_shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingle_hashes(text, SHINGLE), return_counts=True)


def dart_minhash(elements: np.ndarray, weights: np.ndarray, k: int = K) -> np.ndarray:
    """Identity of the earliest dart of each of ``k`` coordinates (uint64); ``elements`` must not be empty."""
    return dart_minhashes([(elements, weights)], k)[0]


def dart_minhashes(sets: list[tuple[np.ndarray, np.ndarray]], k: int = K) -> np.ndarray:
    """One row of ``dart_minhash`` for each weighted set, none empty. A row doesn't depend on the sets beside it."""
    out = np.empty((len(sets), k), np.uint64)
    todo = np.arange(len(sets))
    # so far along the rank axis about k(ln k + 2) darts lie under the weights
    reaches = np.array([k * (np.log(k) + 2) / float(w.sum()) for _, w in sets])
    while len(todo):
        sizes = [len(sets[i][0]) for i in todo]
        elements, weights = (np.concatenate([sets[i][j] for i in todo]) for j in (0, 1))
        owner = np.repeat(np.arange(len(todo)), sizes)
        limit = reaches[todo][owner]
        rank, ident, coord = [], [], []
        low, high = 0.0, 1.0
        while low < weights.max():
            over = weights > low  # region [low, high) of each element that reaches into it
            alive, bound, whose, reach = elements[over], weights[over], owner[over], limit[over]
            at = np.zeros(len(alive))
            state = mix64(alive + np.uint64(int(high) * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))
            while len(alive):
                state = mix64(state + _GOLD)
                at = at - np.log(_uniform(state)) / (high - low)  # the next dart of the region
                alive = near = np.flatnonzero(at <= reach)
                state, at, bound, whose, reach = state[near], at[near], bound[near], whose[near], reach[near]
                place = low + (high - low) * _uniform(mix64(state ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
                hit = np.flatnonzero(place < bound)
                rank.append(at[hit])
                ident.append(state[hit])
                coord.append(whose[hit] * k + (mix64(state[hit] ^ np.uint64(0x5DEECE66D1CE4E5B)) % np.uint64(k)).astype(np.int64))
            low, high = high, high * 2
        rank, ident, coord = map(np.concatenate, (rank, ident, coord))
        order = np.lexsort((ident, rank, coord))
        first = order[np.flatnonzero(np.diff(coord[order], prepend=-1))]
        found = np.bincount(coord[first] // k, minlength=len(todo))
        whole = found == k
        out[todo[whole]] = ident[first][np.repeat(whole, found)].reshape(-1, k)
        todo = todo[~whole]  # some coordinate is empty yet
        reaches[todo] *= 2
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """BANDS keys of each signature, along the last axis."""
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD
    rows = signature.reshape(*signature.shape[:-1], BANDS, ROWS)
    for r in range(ROWS):
        out = mix64(out + rows[..., r])
    return out.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard index of two weighted sets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum())
    return both / (float(a[1].sum() + b[1].sum()) - both) if both else 0.0


def text_digest(text: str) -> Column:
    """First half of the SHA-256 of a text: what tells texts apart."""
    return F.substring(F.unhex(F.sha2(whole_text(text), 256)), 1, 16)


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, digest, bands of each document; bands is empty for a text without words."""

    def make():
        kept: dict[bytes, np.ndarray] = {}

        def run(b):
            if len(kept) > 2000:
                kept.clear()
            sets: dict[bytes, tuple] = {}
            ready = 0

            def sign():
                kept.update(zip(sets, band_keys(dart_minhashes(list(sets.values()))), strict=True) if sets else ())
                sets.clear()

            digests = b.column("digest").to_pylist()
            for digest, t in zip(digests, b.column("t").to_pylist(), strict=True):
                if digest not in kept and digest not in sets:
                    sets[digest] = weighted_shingles(t)
                    if not len(sets[digest][0]):
                        kept[digest] = np.zeros(0, np.int64)
                        del sets[digest]
                        continue
                    ready += len(sets[digest][0])
                    if ready > SIGN_AT_ONCE:
                        sign()
                        ready = 0
            sign()
            return [[kept[d] for d in digests]]

        return run

    rows = docs.select(F.col(key).cast("long").alias("id"), text_digest(text).alias("digest"), whole_text(text).alias("t"))
    return with_columns(rows, "bands array<long>", make, drop=("t",))


def with_texts(edges: DataFrame, texts: DataFrame) -> DataFrame:
    """``edges`` (a, b, n, ...) with both texts, ta and tb. A ``b`` of many edges is dealt over a salt for each PER_SALT of ``n``."""
    salts = F.ceil(F.col("n") / PER_SALT).cast("int")
    hubs = edges.groupBy("b").agg(F.max(salts).alias("salts"))
    hubs = hubs.join(texts.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")
    hubs = hubs.select("b", "tb", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    x = edges.withColumn("salt", F.pmod(F.xxhash64("a"), salts).cast("int"))
    x = x.join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a")
    return x.join(hubs, ["b", "salt"]).drop("salt")


def verify(edges: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``edges`` (a, b, n) whose texts reach the threshold. ``texts``: id, t, one row an id."""

    def run(batches):
        held = (None, None)
        for x in batches:
            good = []
            for tb, ib, ta in zip(x["tb"], x["b"], x["ta"], strict=True):
                if held[0] != ib:  # a hub's edges mostly stand together
                    held = (ib, weighted_shingles(tb))
                good.append(similarity(weighted_shingles(ta), held[1]) >= THRESHOLD)
            yield x.loc[good, ["a", "b"]]

    return with_texts(edges, texts).select("a", "b", "ta", "tb").mapInPandas(run, "a long, b long")


def expanded(text: str) -> np.ndarray:
    """The weighted set as a plain one: the k-th occurrence of a shingle is an element of its own."""
    elements, weights = weighted_shingles(text)
    nth = np.arange(weights.sum()) - np.repeat(np.cumsum(weights) - weights, weights)
    return mix64(np.repeat(elements, weights) + nth.astype(np.uint64) * _GOLD)


def prefix_keys(tokens: np.ndarray, hub: np.ndarray, salt: int) -> dict[str, np.ndarray]:
    """Join keys of one text in the group of ``hub``: key; longer: whether the text stands as the longer of a pair; new and old: how
    many of its tokens from this one on lie outside and inside the hub.

    Tokens outside the hub come first, then by value: one order for the whole group. Keys hold the size bin of the shorter text.
    A pair of sizes m <= n has a common part of at least c(n + m), c = t/(1+t), so its first common token leaves as many in both.
    """
    n, c = len(tokens), THRESHOLD / (1 + THRESHOLD)
    inside = np.isin(tokens, hub, assume_unique=True)
    tokens = tokens[np.lexsort((tokens, inside))]
    at = np.arange(n)
    new = np.maximum(n - inside.sum() - at, 0)
    old = n - at - new
    bins = range(size_bin(THRESHOLD * n), size_bin(n) + 1)
    reach = [(size_bin(n), 2 * n, False)] + [(k, n + max(BIN**k, THRESHOLD * n), True) for k in bins]
    out = {"key": [], "longer": [], "new": [], "old": []}
    for k, both, longer in reach:
        head = tokens[: max(0, int(np.floor(n - c * both + 1e-6)) + 1)]
        out["key"].append(mix64(head + np.uint64((salt * 31 + k) * int(_GOLD) & 0xFFFFFFFFFFFFFFFF)).view(np.int64))
        out["longer"].append(np.full(len(head), longer))
        out["new"].append(new[: len(head)])
        out["old"].append(old[: len(head)])
    return {k: np.concatenate(v) for k, v in out.items()}


def parity(tokens: np.ndarray) -> np.ndarray:
    """Whether an odd number of tokens falls on each of 256 bits, as four longs. Texts differ in at least as many tokens as bits."""
    return np.packbits((np.bincount((tokens >> np.uint64(56)).astype(np.int64), minlength=256) & 1).astype(np.uint8)).view(np.int64)


def size_bin(n: float) -> int:
    return int(np.floor(np.log(max(n, 1.0)) / np.log(BIN) - 1e-9))


def group_keys(mates: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, longer, new, old, size, id, class, odd, parity) for ``mates`` (a, b: the hub, n, class, odd)."""

    def run(batches):
        held, frames, ready = (None, None), [], 0
        for x in batches:
            for r in x.itertuples(index=False):
                if held[0] != r.b:
                    held = (r.b, expanded(r.tb))
                tokens = expanded(r.ta)
                keys = prefix_keys(tokens, held[1], r.b)
                key = keys["key"]
                frames.append(keys | {k: np.full(len(key), v) for k, v in (("size", len(tokens)), ("id", r.a), ("class", r.cls), ("odd", r.odd), *zip(PARITY, parity(tokens), strict=True))})
                ready += len(key)
                if ready > 50_000:
                    yield pd.DataFrame({k: np.concatenate([f[k] for f in frames]) for k in frames[0]})
                    frames, ready = [], 0
        if frames:
            yield pd.DataFrame({k: np.concatenate([f[k] for f in frames]) for k in frames[0]})

    x = with_texts(mates, texts).select("a", "b", "ta", "tb", F.col("class").alias("cls"), "odd")
    return x.mapInPandas(run, "key long, longer boolean, new int, old int, size int, id long, class long, odd boolean, " + ", ".join(f"{p} long" for p in PARITY))


def prefix_pairs(keys: DataFrame) -> DataFrame:
    """Pairs (a, b) of different classes, one of them at least odd, that the prefix filter can't rule out."""
    cols = ("new", "old", "size", "id", "class", *PARITY)
    short = keys.where("not longer").select("key", "odd", *[F.col(c).alias("s_" + c) for c in cols])
    long = keys.where("longer").select("key", "odd", *[F.col(c).alias("l_" + c) for c in cols])
    c = THRESHOLD / (1 + THRESHOLD)
    differ = " + ".join(f"bit_count(s_{p} ^ l_{p})" for p in PARITY)
    may = F.expr(
        "s_class <> l_class and s_size <= l_size and "
        f"least(s_new, l_new) + least(s_old, l_old) + 1e-6 >= (s_size + l_size) * {c!r}D and "
        f"{differ} <= (s_size + l_size) * {1 - 2 * c!r}D + 1e-6"
    )
    found = None
    for s, x in ((short.where("odd"), long), (short.where("not odd"), long.where("odd"))):
        x = s.drop("odd").join(x.drop("odd").withColumnRenamed("key", "l_key"), (F.col("key") == F.col("l_key")) & may)
        x = x.select(F.greatest("s_id", "l_id").alias("a"), F.least("s_id", "l_id").alias("b"))
        found = x if found is None else found.unionByName(x)
    return found.distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(id, class): one id of each id's component, the same for all of it, for ids that have an edge.

    Each round contracts every node into that of its neighbours and itself whose hash is least. Hashes know nothing of the ids' order, so
    a chain, too, loses a good part of its nodes a round, and a star all but its centre in two: rounds grow with the logarithm of a component.
    Maps and edges are written to the shared folder, so no round depends on a lost executor; joins on nodes of many edges are dealt.
    """
    spark = edges.sparkSession
    maps, edges, n = [], materialise(edges.select("a", "b"), label), 0
    while n := edges.count():
        both = edges.union(edges.select("b", "a"))
        place = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        least = both.groupBy("a").agg(F.min(place("b")).alias("m"), F.count(F.lit(1)).alias("n"))
        step = materialise(least.select("a", F.least("m", place("a"))["id"].alias("to"), "n"), label)
        hot = some(hot_keys(step, "a", "n", 2 * n))
        x = dealt_join(edges, step.select("a", F.col("to").alias("x")), "a", hot, F.col("b")).select("b", "x")
        hot = None if hot is None else hot.withColumnRenamed("a", "b")
        x = dealt_join(x, step.select(F.col("a").alias("b"), F.col("to").alias("y")), "b", hot, F.col("x"))
        after = materialise(x.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), label)
        discard(spark, edges)
        maps.append(step.select("a", "to"))
        edges = after
    if not maps:
        return spark.createDataFrame([], "id long, class long")
    out = maps[0].select(F.col("a").alias("id"), F.col("to").alias("class"))
    for step in maps[1:]:
        # a node that later rounds contract further has an edge there: only those move on
        out = out.join(step.select(F.col("a").alias("class"), "to"), "class", "left").select("id", F.coalesce("to", "class").alias("class"))
    out = materialise(out, label)
    discard(spark, edges, *maps)
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, digest, class, class_digest, kept) of every document: class and class_digest are the least (id, digest) of its
    near-duplicate class, kept says whether the document has them."""
    sig = materialise(signatures(docs, key, text), "signatures")
    # exact copies first: one node a text, numbered once in what is written; rep is its least id, null first
    nodes = sig.groupBy("digest").agg(F.min(F.struct("id"))["id"].alias("rep"), F.max("bands").alias("bands"), F.count(F.lit(1)).alias("copies"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    spark, hot = docs.sparkSession, some(hot_keys(nodes, "digest", "copies", sig.count()))
    bands = nodes.select(F.col("node").alias("id"), F.explode("bands").alias("band"))
    deal = lambda x: x.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = bands.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    sizes = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded = materialise(salted.join(deal(sizes), ["band", "salt"]), "crowded")  # id, band, salt, n
    central = crowded.groupBy("id").agg(F.sum("n").alias("score"))
    scored = crowded.join(central, "id")
    hubs = scored.groupBy("band").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("hub"))
    shared = crowded.join(deal(hubs), ["band", "salt"])
    mates = materialise(shared.groupBy(F.col("id").alias("a"), F.col("hub").alias("b")).agg(F.max("n").alias("n")), "mates")
    stars = mates.where("a <> b")
    # the texts of those that share a bucket, each from one row
    ids = mates.select(F.col("a").alias("node")).distinct()
    ids = nodes.join(ids, "node").select("node", "rep", "digest")
    rows = docs.select(F.col(key).cast("long").alias("own"), text_digest(text).alias("digest"), whole_text(text).alias("t"))
    texts = dealt_join(rows, ids, "digest", hot, F.struct("own", F.spark_partition_id())).where(F.col("own").eqNullSafe(F.col("rep")))
    texts = texts.groupBy("node").agg(F.first("t").alias("t"))  # repeated rows have the same text
    texts = materialise(texts.select(F.col("node").alias("id"), "t"), "texts")  # once: the join that picks them is the only one over all texts
    links = materialise(verify(stars, texts), "links")
    first = components(links)
    # hubs whose mates (itself aside, it has met them all) lie in more than one class: all links across, by the prefix filter
    named = stars.join(first, stars["a"] == first["id"], "left").select("a", "b", "n", F.coalesce("class", "a").alias("class"))
    counts = named.groupBy("b", "class").agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("n"))
    mixed = counts.groupBy("b").agg(F.count(F.lit(1)).alias("classes"), F.max(F.struct("m", "class"))["class"].alias("top"), F.max(F.ceil(F.col("n") / PER_SALT)).alias("salts"))
    mixed = mixed.where("classes > 1").select("b", "top", F.explode(F.sequence(F.lit(0), F.col("salts").cast("int") - 1)).alias("salt"))
    odd = named.withColumn("salt", F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / PER_SALT).cast("int")).cast("int")).join(mixed, ["b", "salt"])
    odd = odd.select("a", "b", "n", "class", (F.col("class") != F.col("top")).alias("odd"))
    keys = materialise(group_keys(odd, texts), "keys")
    pairs = prefix_pairs(keys).join(stars, ["a", "b"], "left_anti").withColumn("n", F.lit(1))
    more = verify(pairs, texts)
    classes = components(links.unionByName(more))
    discard(spark, crowded, mates, texts, links, first, keys)
    # back to ids: the least (id, digest) of each class of several texts, dealt over salts to them
    found = classes.join(nodes.select("node", "rep", "digest"), F.col("id") == F.col("node")).select("node", "class", "rep", "digest")
    least = found.groupBy("class").agg(F.min(F.struct("rep", "digest")).alias("least"))
    found = found.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(deal(least), ["class", "salt"]).select("node", "least")
    named = nodes.select("node", "rep", "digest").join(found, "node", "left")
    named = named.select("digest", F.coalesce("least", F.struct("rep", "digest")).alias("least"))
    out = dealt_join(sig.select("id", "digest"), named, "digest", hot, F.struct("id", F.spark_partition_id()))
    kept = F.col("id").eqNullSafe(F.col("least.rep")) & (F.col("digest") == F.col("least.digest"))
    return out.select("id", "digest", F.col("least.rep").alias("class"), F.col("least.digest").alias("class_digest"), kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each class: that of least (doc_id, digest); of repeated rows with both, one."""
    classes = materialise(near_duplicates(docs).select("id", "digest", "kept"), "kept")
    gone = classes.where("not kept").select("id", "digest").distinct()
    # rows that stand for a class several times over: only they are shuffled by what repeats
    several = materialise(classes.where("kept").groupBy("id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "digest"), "several")
    mine, own = fresh(docs.columns, "digest", "own")
    rows = docs.withColumns({mine: text_digest("text"), own: F.col("doc_id").cast("long")})
    same = lambda x: rows[own].eqNullSafe(x["id"]) & (rows[mine] == x["digest"])
    once = rows.join(gone.unionByName(several), same(gone), "left_anti")
    again = rows.join(several, same(several), "left_semi").dropDuplicates([own, mine])
    return once.unionByName(again).drop(mine, own)


def op8_dart_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """``class_id`` alone names a class where doc_ids are unique and not null, with ``class_digest`` always."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.col("class").alias("class_id"), "kept", F.lower(F.hex("class_digest")).alias("class_digest"))
