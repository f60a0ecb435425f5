"""Document fingerprints by SpotSigs, with DataFrame functions only.

A spot signature is a common word (the anchor) with the two content words that follow it, common words passed over. The
text's start counts as an anchor too, so that any text with words has a signature; a text without words has one of its
own characters. Where common words are missing, in a stretch of more than RUN content words without an anchor or in a text of
fewer than FEW anchors, every word of the stretch is an anchor itself, so texts of other languages, lists, logs and tables
are covered to their end. The fingerprint is the sorted set of 32-bit signature hashes in hex. Sets are partitioned by length and compared by a
pruned Jaccard index where pairs over a threshold are searched: those that their partitions or lengths rule out aren't intersected. op1 searches none:
its pairs are given, so each gets its exact index, whatever the lengths.

Null texts are read as empty, and two empty texts are alike (1.0). Equal texts have equal fingerprints. Repeated rows are kept.
Null keys sort after all others. Other columns are left out. An empty table gives no rows.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.llm.common import dealt_join, hot_keys, materialise, table, whole_text
from textquarry.llm.native import let

#: Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be been but by can for from had has have he her his i if in is it its not of on or she that the their "
    "they this to was we were which will with you "
    "aber als am auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im ist mit nach nicht "
    "noch sich sie sind so um und von vor war wie wird zu zum zur "
    "au aux avec ce ces cette dans de du elle en est et il ils la le les leur mais ne nous on ou par pas pour que qui sa se ses "
    "son sur un une vous "
    "al como con del desde el ella esta este los las lo más no o para pero por sin su sus una uno y ya"
).split()
CHAIN = 2
#: A longer stretch of content words without an anchor is chained word by word, and so is a text of fewer anchors.
RUN, FEW = 6, 3


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """Sorted distinct 32-bit hashes of a text's spots (array<int>)."""
    common = sorted(set(ANCHORS))
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def chains(w: Column) -> Column:
        marks = F.transform(w, lambda x, i: F.when(x.isin(common), i))
        content = F.filter(w, lambda x: ~x.isin(common))
        spots = F.filter(marks, lambda i: i.isNotNull())

        def joined(s: Column) -> Column:
            at = lambda i: F.get(s["content"], i)
            # the k-th anchor stands at word i, so i - k content words come before it
            found = F.transform(s["spots"], lambda i, k: F.hash(F.get(s["words"], i), *[at(i - k + j) for j in range(chain)]))
            # stretches between anchors, that before the first one too: word i opens one, k anchors stand before it
            opens = F.concat(F.array(F.lit(0)), F.transform(s["spots"], lambda i: i + 1))
            ends = lambda k: F.coalesce(F.get(s["spots"], k), F.size(s["words"]))
            bare = lambda i, k: (ends(k) > i) & ((ends(k) - i > RUN) | (F.size(s["spots"]) < FEW))
            own = lambda i, k: F.transform(F.sequence(i - k, ends(k) - k - 1), lambda c: F.hash(*[at(c + j) for j in range(chain + 1)]))
            runs = F.flatten(F.transform(opens, lambda i, k: F.when(bare(i, k), own(i, k)).otherwise(F.array().cast("array<int>"))))
            start = F.hash(F.lit("^"), *[at(F.lit(j)) for j in range(chain)], F.when(F.size(s["content"]) == 0, F.concat_ws(" ", s["words"])))
            return F.sort_array(F.array_distinct(F.concat(found, runs, F.array(start))))

        return let(F.struct(w.alias("words"), content.alias("content"), spots.alias("spots")), joined)

    return let(words, lambda w: F.when(F.size(w) > 0, chains(w)).otherwise(F.when(F.length(text) > 0, F.array(F.hash(text))).otherwise(F.array().cast("array<int>"))))


def length_partition(n: Column, threshold: float) -> Column:
    """Partition of a set's length: base^p to base^(p+1), base = 1/threshold. Sets that reach the threshold lie in the same or in
    neighbouring partitions."""
    return F.floor(F.log(F.greatest(n, F.lit(1))) / F.lit(-math.log(threshold)) + F.lit(1e-9)).cast("int")


def jaccard(a: Column, b: Column) -> Column:
    """Exact Jaccard index of two sets, 1.0 of two empty ones."""
    exact = let(F.size(F.array_intersect(a, b)), lambda both: both / (F.size(a) + F.size(b) - both))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(exact)


def likeness(a: Column, b: Column, least: float) -> Column:
    """``jaccard`` for a search of pairs of at least ``least``: those whose length partitions, or then lengths, rule that out are pruned. They get
    0.0 and their sets aren't intersected."""
    na, nb = F.size(a), F.size(b)
    apart = F.abs(length_partition(na, least) - length_partition(nb, least)) > 1
    short = F.least(na, nb) < F.greatest(na, nb) * F.lit(least)
    return F.when((na + nb > 0) & ((F.least(na, nb) == 0) | apart | short), 0.0).otherwise(jaccard(a, b))


def printed(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda s: F.lpad(F.hex(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def matches(docs: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs of different fingerprints at or over the threshold: (a, b, likeness, a_print, b_print), each fingerprint by the least key that
    has it (null first) and by its MD5. Documents of equal fingerprints are folded, whatever their keys; texts without words aren't compared.

    Sets meet only in the same or the next partition of lengths, on a signature among the first of each set in a global order
    by rarity (prefix filter): if two sets share less than that, they can't reach the threshold. Lengths rule out the rest.
    """
    sets = docs.select(F.col(key).alias("k"), signatures(whole_text(text)).alias("s")).where(F.size("s") > 0)
    sets = sets.groupBy("s").agg(F.min(F.struct("k"))["k"].alias("k")).withColumns({"id": F.md5(printed(F.col("s"))), "n": F.size("s")})
    sets = materialise(sets, "spot-sets")
    spots = sets.select("id", "n", F.explode("s").alias("sig"))
    rarity = materialise(spots.groupBy("sig").agg(F.count(F.lit(1)).alias("df")), "spot-rarity")
    hot = hot_keys(rarity, "sig", "df", sets.count())
    ordered = dealt_join(spots, rarity, "sig", hot, F.col("id")).groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("o"))
    lead = F.transform(F.slice("o", F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold) + 1).cast("int")), lambda x: x["sig"])
    lead = ordered.select("id", "n", length_partition(F.col("n"), threshold).alias("p"), F.explode(lead).alias("sig"))
    left = lead.select(F.col("id").alias("ia"), F.col("n").alias("na"), "sig", F.explode(F.array("p", F.col("p") + 1)).alias("p"))
    right = lead.select(F.col("id").alias("ib"), F.col("n").alias("nb"), "sig", "p")
    near = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("ia") < F.col("ib")))
    pairs = left.join(right, ["sig", "p"]).where(near & (F.col("na") >= F.col("nb") * threshold)).select("ia", "ib").distinct()
    x, y = (sets.select(F.col("id").alias("i" + c), F.col("k").alias(c), F.col("s").alias("s" + c)) for c in "ab")
    scored = pairs.join(x, "ia").join(y, "ib").select("a", "b", likeness(F.col("sa"), F.col("sb"), threshold).alias("likeness"), F.col("ia").alias("a_print"), F.col("ib").alias("b_print"))
    return scored.where(F.col("likeness") >= threshold)


#: Documents a range of neighbours holds on average, and the most ranges there are (their edges are broadcast: under 4 MB).
BUCKET_ROWS, MOST_BUCKETS = 400, 100_000


def place_in(bounds: list[int], v: Column, upto: bool) -> Column:
    """How many of the sorted ``bounds`` are less than ``v`` (``upto``: or equal to it), by binary search."""
    values = F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")  # one constant, however many there are

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        at = F.get(values, mid)
        more = (s["lo"] < s["hi"]) & ((at <= v) if upto else (at < v))
        return F.struct(F.when(more, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(more | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    turns = F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1))
    return F.aggregate(turns, F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), step)["lo"]


def dealt(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(k, t, h, b, lent): each text with the hash that orders equal keys and its range b; and the last row of each range once more, lent to
    the range above it, that of the highest to the lowest.

    Ranges part the rows by quantiles of the keys, so none depends on how keys are spread; a key with more rows than a range takes
    (it is several quantiles at once), or null, is parted further by the hash. Only the ranges' edges are gathered, at most MOST_BUCKETS short rows.
    """
    rows = docs.select(F.col(key).cast("long").alias("k"), whole_text("text").alias("t"))
    n, known = rows.agg(F.count(F.lit(1)), F.count("k")).first()
    ranges = max(1, min(MOST_BUCKETS, known // BUCKET_ROWS))
    blank = max(1, min(MOST_BUCKETS, (n - known) // BUCKET_ROWS))
    bounds = []
    if ranges > 1:
        bounds = list(rows.agg(F.percentile_approx("k", F.from_json(F.lit(json.dumps([i / ranges for i in range(1, ranges)])), "array<double>"), max(10_000, 8 * ranges))).first()[0])
    rows = rows.withColumn("h", F.xxhash64("t"))
    share = lambda parts: F.least(F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * parts), parts - 1)
    if bounds:
        found = F.struct(place_in(bounds, F.col("k"), False).alias("lo"), place_in(bounds, F.col("k"), True).alias("hi"))
        ranged = let(found, lambda x: x["lo"] + F.when(x["hi"] - x["lo"] > 1, share(x["hi"] - x["lo"])).otherwise(0))
    else:
        ranged = F.lit(0)
    rows = rows.withColumn("b", F.when(F.col("k").isNull(), share(F.lit(blank)) - blank).otherwise(ranged).cast("long"))
    tops = rows.groupBy("b").agg(F.max(F.struct("k", "h")).alias("top"))
    # one row a range: a window over all of them is small
    every = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = F.broadcast(tops.select(F.col("b").alias("eb"), "top", F.coalesce(F.lead("b").over(Window.orderBy("b")), F.first("b").over(every)).alias("to")))
    met = rows.join(edges, (F.col("b") == F.col("eb")) & F.col("k").eqNullSafe(F.col("top.k")) & (F.col("h") == F.col("top.h")), "left")
    own = F.struct(F.col("b"), F.lit(0).alias("lent"))
    places = F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("to").alias("b"), F.lit(1).alias("lent"))))
    return met.select("k", "t", "h", F.explode(places).alias("x")).select("k", "t", "h", "x.b", "x.lent")


def neighbours(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(k, t, s, next_t, next_s): each text and its signatures with those of the next document by descending key (after the last: the first;
    equal keys by descending hash of their texts, null keys last)."""
    rows = dealt(docs, key).repartition("b").withColumn("s", signatures(F.col("t")))
    order = Window.partitionBy("b").orderBy(F.desc("lent"), F.col("k").asc_nulls_first(), "h")
    out = rows.withColumn("after", F.lag(F.struct("t", "s")).over(order)).where("lent = 0")
    return out.select("k", "t", "s", F.coalesce(F.col("after.t"), F.col("t")).alias("next_t"), F.coalesce(F.col("after.s"), F.col("s")).alias("next_s"))


def op1_spotsigs_fingerprints(spark, sf_dir: str) -> DataFrame:
    rows = neighbours(table(spark, sf_dir, "documents"))
    n, cut = F.length("t"), F.floor(F.length("t") / 3).cast("int")
    edited = F.concat(F.substring(F.col("t"), F.lit(1), n - cut), F.substring(F.col("next_t"), F.lit(1), cut))
    rows = rows.withColumn("e", edited)
    pair = F.struct(F.col("e").alias("e"), signatures(F.col("e")).alias("s"))
    rows = rows.select(
        F.col("k").alias("doc_id"),
        n.cast("long").alias("n_chars"),
        "s",
        "next_s",
        let(pair, lambda x: F.struct(F.sha2(x["e"], 256).alias("sha"), printed(x["s"]).alias("print"), jaccard(F.col("s"), x["s"]).alias("near"))).alias("x"),
    )
    return rows.select(
        "doc_id", "n_chars", F.col("x.sha").alias("edited_sha256"), printed(F.col("s")).alias("fingerprint"), F.col("x.print").alias("edited_fingerprint"),
        F.col("x.near").alias("near_edited"), jaccard(F.col("s"), F.col("next_s")).alias("near_next"),
    )
