"""Token-id shards with a minimal perfect hash index.

File format of a shard (little-endian), ids of its documents in ascending key order, null keys first:

    magic 8 bytes | ids (raw payload) | arrays, each at a multiple of 8 | footer JSON | footer length u64 | magic 8 bytes

Footer: width (bytes an id: 2 where the vocabulary has at most 65,536 ids, else 4), docs, nulls, and for each array its dtype, count and
offset. Arrays: ``keys`` (order kept), ``first`` (id offset of each slot's document), ``count`` (its ids), ``print`` (32-bit fingerprint of its key), ``bits`` (64-bit words of the perfect hash's levels), ``rank`` (set bits before each
word), ``levels`` (bits of each level).

A key is looked up in constant time, and with a few short reads of the file, whatever its size: level by level one word of ``bits`` is
read, the rank of the first set bit is the slot, the stored fingerprint turns strangers away, and one read gives the ids. ``TokenIndex``
finds the shard first, by the least key of each. A shard is written as its ids come; only its keys and counts are held.

A null key sorts first. A key that occurs more than once is stored as often, as (key, occurrence), equal keys in the order of a hash of
their texts; a key of very many rows is dealt over several shards. A null text has no ids but the end id. An empty table gives no shard. Other columns of
the input are left out.
"""

from __future__ import annotations

import bisect
import json
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import crc, mix64, open_fs, scratch, table, whole_text
from textquarry.llm.tokens import encoder

MAGIC = b"TQSHARD2"
GAMMA = 1.7
#: Text a shard takes, in bytes, or more where that made over MOST_SHARDS; so their number grows with the data, and the manifest is bounded.
SHARD_BYTES, MOST_SHARDS = 32 << 20, 100_000
#: Documents read back at a time.
READ_DOCS = 4096
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_NULL = np.uint64(0x6E756C6C6B657921)  # what stands for a null key's hash; no key's place depends on it


def key_hashes(keys: np.ndarray, nulls: int = 0) -> np.ndarray:
    """64-bit hash of each (key, occurrence); the first ``nulls`` keys are null, the others ascend."""
    keys = np.asarray(keys, dtype=np.int64)
    at = np.arange(len(keys))
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    new[1:nulls] = False
    new[nulls : nulls + 1] = True
    return hash_of(keys, at - np.maximum.accumulate(np.where(new, at, 0)), at < nulls)


def hash_of(keys, occurrence=0, null=False) -> np.ndarray:
    with np.errstate(over="ignore"):
        first = np.where(null, _NULL, mix64(np.asarray(keys, dtype=np.int64).view(np.uint64)))
        return mix64(first + np.asarray(occurrence, dtype=np.uint64) * _GOLD)


def place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(hashes ^ np.uint64((level + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)


def build_hash(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, rank, levels, slot of each hash) of a minimal perfect hash of differing hashes: a key takes its bit at the first level
    where no other key claims it."""
    parts, sizes, left, who = [], [], np.asarray(hashes, dtype=np.uint64), np.arange(len(hashes))
    bit, start = np.zeros(len(hashes), dtype=np.int64), 0
    while len(left):
        size = max(64, -(-int(len(left) * GAMMA) // 64) * 64)
        at = place(left, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        mine = alone[at]
        bit[who[mine]] = start + at[mine]
        parts.append(np.packbits(alone, bitorder="little").view("<u8"))
        sizes.append(size)
        start += size
        left, who = left[~mine], who[~mine]
    words = np.concatenate(parts) if parts else np.zeros(0, "<u8")
    rank = np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words)
    below = words[bit >> 6] & ((np.uint64(1) << (bit & 63).astype(np.uint64)) - np.uint64(1))
    return words, rank.astype("<i8"), np.array(sizes, dtype="<i8"), rank[bit >> 6] + np.bitwise_count(below)


class ShardWriter:
    """Writes one shard to an output stream, ids first."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self._put(MAGIC)

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def ids(self, raw: bytes) -> None:
        self._put(raw)

    def close(self, keys: np.ndarray, counts: np.ndarray, nulls: int) -> None:
        hashes = key_hashes(keys, nulls)
        words, rank, levels, slots = build_hash(hashes)
        first, count, prints = (np.zeros(len(keys), dtype=t) for t in ("<i8", "<i8", "<u4"))
        first[slots] = np.cumsum(counts) - counts
        count[slots] = counts
        prints[slots] = (hashes >> np.uint64(32)).astype("<u4")
        arrays = {"keys": keys.astype("<i8"), "first": first, "count": count, "print": prints, "bits": words, "rank": rank, "levels": levels}
        where = {}
        for name, a in arrays.items():
            self._put(bytes(-self.at % 8))
            where[name] = [a.dtype.str, len(a), self.at]
            self._put(a.tobytes())
        foot = json.dumps({"width": self.width, "docs": len(keys), "nulls": nulls, "arrays": where}).encode()
        self._put(foot + len(foot).to_bytes(8, "little") + MAGIC)


class Shard:
    """Reads a shard from a file that can seek; nothing but the footer and the levels' sizes is held."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        tail = file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a token shard")
        n = int.from_bytes(tail[:8], "little")
        foot = json.loads(file.read_at(n, size - 16 - n))
        self.width, self.docs, self.nulls, self.where = foot["width"], foot["docs"], foot["nulls"], foot["arrays"]
        self.levels = self.read("levels", 0, self.where["levels"][1]).tolist()

    def read(self, name: str, at: int, n: int) -> np.ndarray:
        kind, _, offset = self.where[name]
        size = np.dtype(kind).itemsize
        return np.frombuffer(self.file.read_at(n * size, offset + at * size), dtype=kind)

    def ids(self, first: int, count: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at(count * self.width, len(MAGIC) + first * self.width), dtype=f"<u{self.width}")

    def slot(self, h: np.uint64) -> int:
        """The slot of a key's hash; -1 for a key the shard doesn't hold."""
        start = 0
        for level, size in enumerate(self.levels):
            at = start + int(place(np.array([h]), level, size)[0])
            word = int(self.read("bits", at >> 6, 1)[0])
            if word >> (at & 63) & 1:
                found = int(self.read("rank", at >> 6, 1)[0]) + (word & ((1 << (at & 63)) - 1)).bit_count()
                return found if int(self.read("print", found, 1)[0]) == int(h) >> 32 else -1
            start += size
        return -1

    def get(self, key: int | None, occurrence: int = 0) -> np.ndarray | None:
        """The ids of a document, by a fixed number of reads; None for a key the shard doesn't hold."""
        found = self.slot(hash_of([key or 0], [occurrence], [key is None])[0])
        return None if found < 0 else self.ids(int(self.read("first", found, 1)[0]), int(self.read("count", found, 1)[0]))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each of many hashes, by the same levels; -1 for keys the shard doesn't hold. Reads the index, not the ids."""
        words, rank, prints = (self.read(n, 0, self.where[n][1]) for n in ("bits", "rank", "print"))
        out, start, todo = np.full(len(hashes), -1, dtype=np.int64), 0, np.arange(len(hashes))
        for level, size in enumerate(self.levels):
            if not len(todo):
                break
            at = start + place(hashes[todo], level, size)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[todo[hit]] = rank[at[hit] >> 6] + np.bitwise_count(below)
            todo, start = todo[~hit], start + size
        known = np.flatnonzero(out >= 0)
        strangers = prints[out[known]] != (hashes[known] >> np.uint64(32)).astype("<u4")
        out[known[strangers]] = -1
        return out

    def documents(self):
        """(keys, are they null, first, count) of READ_DOCS documents at a time in order; each is looked up by its key."""
        keys, first, count = (self.read(n, 0, self.docs) for n in ("keys", "first", "count"))
        slots = self.find(key_hashes(keys, self.nulls))
        if (slots < 0).any():
            raise ValueError("a key of the shard isn't in its index")
        for at in range(0, self.docs, READ_DOCS):
            here = slice(at, at + READ_DOCS)
            yield keys[here], np.arange(self.docs)[here] < self.nulls, first[slots[here]], count[slots[here]]


class TokenIndex:
    """Keyed access over all shards of a manifest: the shard by the least key of each, the document by the shard's hash."""

    def __init__(self, where: str, manifest: list):
        self.fs, self.top = open_fs(where)
        self.rows = sorted((r for r in manifest), key=lambda r: r["shard"])
        self.low = [(r["low"] is not None, r["low"] or 0) for r in self.rows]
        self.high = [(r["high"] is not None, r["high"] or 0) for r in self.rows]
        self.open: dict[int, Shard] = {}

    def get(self, key: int | None, occurrence: int = 0) -> np.ndarray | None:
        """The ids of a key's document (its ``occurrence``-th, where a key has several); None for a key that isn't there."""
        at = (key is not None, key or 0)
        i = max(0, bisect.bisect_left(self.low, at) - 1)
        while i < len(self.rows) and self.low[i] <= at:
            if self.high[i] >= at:
                if i not in self.open:
                    self.open[i] = Shard(self.fs.open_input_file(f"{self.top}/{self.rows[i]['file']}"))
                if (ids := self.open[i].get(key, occurrence)) is not None:
                    return ids
                occurrence -= self.rows[i]["n_high"] if self.high[i] == at else 0  # the key goes on in the next shard
            i += 1
        return None


MANIFEST = "shard int, file string, n_docs long, n_ids long, low long, high long, n_high long"


def write_shards(docs: DataFrame, where: str, path: str, end_id: int, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes one shard per range of keys under ``where``; returns MANIFEST rows: least and greatest key, and how many documents have the
    greatest. A task that runs again writes a file of its own and only the one it reports is read, so lost executors do no harm."""

    def run(batches):
        enc, writer, out = None, None, None
        keys, counts, nulls = [], [], 0
        for b in batches:
            if writer is None:
                width = 2 if vocabulary(path) <= 1 << 16 else 4
                enc = encoder(path, spaced=False, width=width)
                end = np.array([end_id], dtype=enc.dtype).tobytes()
                fs, base = open_fs(where)
                fs.create_dir(base, recursive=True)
                name = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tqs"
                out = fs.open_output_stream(f"{base}/{name}")
                writer = ShardWriter(out, width)
            nulls += b.column("k").null_count
            keys.append(b.column("k").fill_null(0).to_numpy())
            found = enc.encode(b.column("t").to_pylist())
            counts += [len(ids) // width + 1 for ids in found]
            for ids in found:
                writer.ids(ids + end)
        if writer is None:
            return
        enc.release()
        keys, counts = np.concatenate(keys), np.array(counts, dtype=np.int64)
        writer.close(keys, counts, nulls)
        out.close()
        low, high = (None if i < nulls else int(keys[i]) for i in (0, len(keys) - 1))
        last = nulls if high is None else int((keys[nulls:] == high).sum())
        row = (TaskContext.get().partitionId(), name, len(keys), int(counts.sum()), low, high, last)
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.string(), *[pa.int64()] * 5), strict=True)], names=[x.split()[0] for x in MANIFEST.split(", ")])

    rows = docs.select(F.col(key).cast("long").alias("k"), whole_text(text).alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t"))
    order = (F.col("k").asc_nulls_first(), F.col("h").asc())
    return rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("k", "t").mapInArrow(run, MANIFEST)


@cache
def vocabulary(path: str) -> int:
    """The number of ids of a tokenizer's file."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab().values()) + 1


def read_documents(spark, where: str, manifest: list) -> DataFrame:
    """Per document, from the files: key, start, n_tokens, ids_crc32. ``manifest``: rows of write_shards(), one per shard."""
    base, rows = 0, []
    for r in sorted(manifest, key=lambda r: r["shard"]):
        rows.append((r["shard"], r["file"], base))
        base += r["n_ids"]
    kinds = (pa.int64(),) * 4

    def run(batches):
        fs, top = open_fs(where)
        for b in batches:
            for name, start in zip(b.column("file").to_pylist(), b.column("base").to_pylist(), strict=True):
                with fs.open_input_file(f"{top}/{name}") as f:
                    shard = Shard(f)
                    for keys, null, first, count in shard.documents():
                        ids = shard.ids(int(first[0]), int(count.sum())).astype("<u4", copy=False)
                        ends = np.cumsum(count).tolist()
                        sums = [crc(ids[i:j].tobytes()) for i, j in zip([0, *ends[:-1]], ends, strict=True)]
                        columns = (pa.array(keys, mask=null), first + start, count, sums)
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["k", "start", "n_tokens", "ids_crc32"])

    schema = "k long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], schema)
    plan = spark.createDataFrame(rows, "shard int, file string, base long").repartition(len(rows), "shard")
    return plan.mapInArrow(run, schema)


def shard_count(docs: DataFrame, text: str = "text") -> int:
    """One shard for each SHARD_BYTES of text, MOST_SHARDS at most."""
    size = docs.agg(F.sum(F.octet_length(F.col(text))).alias("n")).first()["n"] or 0
    return max(1, min(MOST_SHARDS, -(-size // SHARD_BYTES)))


def token_index(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes, writes the shards, then reads them back by their index."""
    spark = docs.sparkSession
    where = scratch(spark, "token-shards")
    # the manifest is one short row per shard
    manifest = write_shards(docs, where, path, end_id, shard_count(docs, text), key, text).collect()
    return read_documents(spark, where, manifest).withColumnRenamed("k", key)


def op6_token_index(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return token_index(table(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"), end_id=1)
