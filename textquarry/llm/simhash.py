"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits: each is the majority of that bit over the hashes of all word shingles, repeats included. Bit positions carry
vectors of r + 1 bits; for each of the 2^(r+1) - 1 vectors v but zero a table is keyed by the fingerprint under the mask of those positions
whose vector has an odd product with v. At most r differing positions span less than the whole space, so some v is orthogonal to all of
them: every pair within the radius r collides in some table, not just a share of them.

Equal fingerprints are folded first. A bucket of at most CROWD fingerprints is compared within one task, which writes a spanning forest
of its links. In a larger one each fingerprint is compared with one hub; where that leaves several components, links are found
without pairs: all members mark the points within r // 2 bits of them (inside the bits that the mask leaves free), those outside the
largest component also the points within r - r // 2. All that mark a point are connected if one of them is among the nearer ones: two of the
nearer lie within r of each other, and each farther one within r of each nearer one. Any link across components has such a point. A point has a bounded number of
marks however large the bucket, and no step grows with the square of it.

Null texts are read as empty; a text without words has fingerprint zero, linked like any other. Rows of equal texts fall into one
component, whatever their keys. A component is named by its least key; null only if all its keys are. Other columns are left out. An empty
table gives no rows.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import dealt_join, discard, hot_keys, materialise, some, table, whole_text, with_columns
from textquarry.llm.neardup import components

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: Fingerprints of a bucket that one task compares.
CROWD = 512
_LOWER = {c: c + 32 for c in range(65, 91)}
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text: str, k: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    words = [w.encode("utf-8", "surrogatepass") for w in _WORD.findall(text.translate(_LOWER))]
    if not words:
        return 0
    n = max(1, len(words) - k + 1)
    ones, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for i in range(0, n, 1 << 15):  # long texts in parts
        some_of = words[i : min(i + (1 << 15), n) + k - 1]
        shingles = map(b" ".join, zip(*[some_of[j:] for j in range(k)], strict=False)) if len(words) >= k else [b" ".join(words)]
        h = np.fromiter((digest(s, seed) for s in shingles), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp) of each document; fp is the fingerprint's bits as a long."""

    def make():
        return lambda b: [np.array([fingerprint(t) for t in b.column("t").to_pylist()], np.uint64).view(np.int64)]

    return with_columns(docs.select(F.col(key).cast("long").alias("id"), whole_text(text).alias("t")), "fp long", make, drop=("t",))


def masks(radius: int = RADIUS) -> list[int]:
    """The bits that each table's key keeps. Positions take the vectors but zero in turn, so every mask keeps about half."""
    vectors = 2 ** (radius + 1) - 1
    return [sum(1 << i for i in range(BITS) if (v & (i % vectors + 1)).bit_count() & 1) for v in range(1, vectors + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def free_points(radius: int, mask: int) -> list[int]:
    """All sets of at most ``radius`` of the bits that ``mask`` leaves free."""
    free = [1 << i for i in range(BITS) if not mask >> i & 1]
    return [_signed(sum(c)) for r in range(radius + 1) for c in combinations(free, r)]


def forest(found: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): each of the distinct fingerprints of a bucket, and the first one that it is connected to there, where that is another."""
    bits = found.view(np.uint64)  # of a negative number the count would be that of its absolute value
    close = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= radius
    label = np.arange(len(found))
    while True:
        least = np.where(close, label[None, :], len(found)).min(axis=1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    moved = label != np.arange(len(found))
    return found[moved], found[label[moved]]


def differing(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(nodes: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """(a, b) of distinct fingerprints (column fp): edges whose components are those of all pairs within the radius."""
    spark, keep = nodes.sparkSession, masks(radius)
    at = F.array(*[F.struct(F.lit(v).cast("byte").alias("v"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for v, m in enumerate(keep)])
    placed = nodes.select("fp", F.explode(at).alias("bucket"))
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("hub")).where("n > 1")
    sizes = materialise(sizes, "buckets")
    hot = some(hot_keys(sizes, "bucket", "n", nodes.count()))
    shared = materialise(dealt_join(placed, sizes, "bucket", hot, F.col("fp")), "shared")

    def compare(batches):
        for b in batches:
            pairs = [forest(np.asarray(x, np.int64), radius) for x in b.column("found").to_pylist()]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(side)) for side in zip(*pairs, strict=True)], names=["a", "b"])

    small = shared.where(F.col("n") <= crowd).groupBy("bucket").agg(F.sort_array(F.collect_list("fp")).alias("found"))
    small = small.select("found").mapInArrow(compare, "a long, b long")
    crowded = shared.where(F.col("n") > crowd)
    stars = crowded.where((F.col("fp") != F.col("hub")) & (differing("fp", "hub") <= radius)).select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    plain = materialise(small.unionByName(stars).distinct(), "links")
    if crowded.isEmpty():
        discard(spark, sizes, shared)
        return plain
    first = components(plain)
    named = materialise(crowded.join(first.withColumnRenamed("id", "fp"), "fp", "left").select("bucket", "fp", F.coalesce("class", "fp").alias("class")), "named")
    counts = named.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("m"))
    # one class a bucket needs no more; of several, the largest one's members mark the nearer points only
    mixed = counts.groupBy("bucket").agg(F.count(F.lit(1)).alias("classes"), F.max(F.struct("m", "class"))["class"].alias("top"), F.sum("m").alias("n"))
    mixed = mixed.where("classes > 1").select("bucket", "top", "n")
    hot = some(hot_keys(mixed, "bucket", "n", nodes.count()))
    odd = dealt_join(named, mixed, "bucket", hot, F.col("fp")).select("bucket", "fp", (F.col("class") != F.col("top")).alias("odd"))
    near, far = radius // 2, radius - radius // 2

    def mark(batches):
        points = {}
        for b in batches:
            for v, fp, is_odd in zip(b.column("v").to_pylist(), b.column("fp").to_pylist(), b.column("odd").to_pylist(), strict=True):
                if v not in points:
                    points[v] = [np.array(free_points(r, keep[v]), np.int64) for r in (near, far)]
                z = points[v][1 if is_odd else 0] ^ np.int64(fp)
                close = np.arange(len(z)) < len(points[v][0])
                yield pa.RecordBatch.from_arrays([pa.array(z), pa.array(np.full(len(z), fp)), pa.array(close)], names=["z", "fp", "close"])

    marks = odd.select(F.col("bucket.v").alias("v"), "fp", "odd").mapInArrow(mark, "z long, fp long, close boolean")
    met = marks.groupBy("z").agg(F.min(F.when(F.col("close"), F.col("fp"))).alias("b"), F.collect_set("fp").alias("found"))
    met = met.where(F.col("b").isNotNull() & (F.size("found") > 1)).select("b", F.explode("found").alias("a")).where("a <> b")
    out = materialise(plain.unionByName(met.select("a", "b")).distinct(), "links")
    discard(spark, sizes, shared, plain, first, named)
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fp, component) of every document: component is the least id that links of at most ``radius`` differing bits reach."""
    if not 0 < radius < 8:
        raise ValueError("the radius is 1 to 7")
    spark = docs.sparkSession
    rows = materialise(fingerprints(docs, key, text), "fingerprints")
    nodes = materialise(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")), "nodes")
    edges = links(nodes.select("fp"), radius)
    classes = components(edges)
    joined = materialise(classes.join(nodes.select(F.col("fp").alias("id"), "least"), "id").select("id", "class", "least"), "joined")
    names = joined.groupBy("class").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("n"))
    hot = some(hot_keys(names, "class", "n", joined.count()))
    named = dealt_join(joined.select("id", "class"), names.select("class", "component"), "class", hot, F.col("id")).select(F.col("id").alias("fp"), "component")
    named = nodes.join(named, "fp", "left").select("fp", F.coalesce("component", "least").alias("component"))
    hot = some(hot_keys(nodes, "fp", "copies", rows.count()))
    discard(spark, edges)
    return dealt_join(rows, named, "fp", hot, F.struct("id", F.spark_partition_id())).select("id", "fp", "component")


def op12_covering_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
