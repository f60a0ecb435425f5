"""Best-fit packing planned over the length histogram.

Texts become pieces of at most ``capacity`` tokens; only longer ones are cut, and then the first piece takes the remainder.
A piece of ``capacity`` tokens is a sequence by itself. The histogram of the other lengths (fewer than ``capacity`` numbers) goes to the
driver, where best-fit-decreasing places counts, not pieces. The plan says for each length which ranks take which place of which
sequences; a piece learns its rank within its length from salted counts and takes its slot by joining on it. A length has a
salt for each PER_SALT of its pieces, so none gathers in one task.

A null or empty text is one piece: the end id. Null and repeated keys are packed like any others, each row by itself. Input columns
named sequence_id or offset are replaced in ``pack``; others pass. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.llm.common import crc, fresh, materialise, table, whole_text, with_columns
from textquarry.llm.tokens import encoder

CAPACITY = 2048
#: Pieces of a length that one salt takes, or more where that made over MOST_SALTS in all.
PER_SALT, MOST_SALTS = 500, 100_000


def cut(ids: bytes, capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of the pieces of ids in 32 bits: the first takes the remainder."""
    n, out, at = len(ids) // 4, [], 0
    size = (n - 1) % capacity + 1
    while at < n:
        out.append((len(out), at, size, crc(ids[4 * at : 4 * (at + size)])))
        at, size = at + size, capacity
    return out


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length, ids_crc32 of each piece."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        enc = encoder(path, spaced=True)
        try:
            for b in batches:
                cuts = [cut(ids + end, capacity) for ids in enc.encode(b.column("t").to_pylist())]
                keys = b.column(key).take(pa.array(np.repeat(np.arange(len(cuts)), list(map(len, cuts)))))
                parts = zip(*[p for c in cuts for p in c], strict=True) if cuts else [()] * 4
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(x, t) for x, t in zip(parts, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))], names=[key, "piece", "start", "length", "ids_crc32"])
        finally:
            enc.release()

    return docs.select(key, whole_text(text).alias("t")).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, piece int, start long, length long, ids_crc32 long")


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, how many, first sequence, offset). Sequences are filled alike in groups: a group is a number of
    sequences with the same lengths in the same order. Longest first, each length goes to the groups with the least room
    that takes it, and only then to new sequences."""
    groups: dict[int, list[tuple[int, list[tuple[int, int, int]]]]] = defaultdict(list)  # room -> (how many, parts)
    closed: list[tuple[int, list]] = []
    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        left, rank = histogram[length], 0
        room = length
        while left:
            while room <= capacity and not groups[room]:
                room += 1
            if room > capacity:
                each = capacity // length
                full, rest = divmod(left, each)
                if full:
                    part = [(length, rank + j * full, j * length) for j in range(each)]
                    groups[capacity - each * length].append((full, part))
                if rest:
                    groups[capacity - rest * length].append((1, [(length, rank + full * each + j, j * length) for j in range(rest)]))
                break
            count, parts = groups[room].pop()
            used = min(count, left)
            if used < count:
                groups[room].append((count - used, [(n, r + used, o) for n, r, o in parts]))
            groups[room - length].append((used, [*parts, (length, rank, capacity - room)]))
            left, rank = left - used, rank + used
    for room in groups:
        closed += groups[room]
    rows, first = [], 0
    for count, parts in closed:
        rows += [(n, r, count, first, o) for n, r, o in parts]
        first += count
    return rows


def pack(items: DataFrame, capacity: int = CAPACITY, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``items`` with sequence_id and offset. ``items`` must give the same rows each time it is read (a written table)."""
    items = items.drop("sequence_id", "offset")
    salts, salt, rank = fresh(items.columns, "salts", "salt", "rank")
    # fewer than ``capacity`` rows, here and in the join
    sizes = [tuple(r) for r in items.where(F.col(length) < capacity).groupBy(length).agg(F.count(F.lit(1)).alias("n")).collect()]
    each = max(PER_SALT, sum(n for _, n in sizes) // MOST_SALTS)
    sizes = F.broadcast(items.sparkSession.createDataFrame([(k, -(-n // each)) for k, n in sizes], f"`{length}` long, `{salts}` int"))
    part = items.where(F.col(length) < capacity).join(sizes, length).withColumn(salt, F.pmod(F.xxhash64(*order), F.col(salts)).cast("int")).drop(salts)
    # at most MOST_SALTS rows, and one a length
    cells = sorted(tuple(r) for r in part.groupBy(length, salt).agg(F.count(F.lit(1)).alias("n")).collect())
    histogram: dict[int, int] = defaultdict(int)
    base = {}
    for n, s, c in cells:
        base[n, s] = histogram[n]
        histogram[n] += c
    by_length, planned = defaultdict(list), 0
    for n, first_rank, count, first, offset in best_fit(histogram, capacity):
        by_length[n].append((first_rank, first, offset))
        planned = max(planned, first + count)
    plan_ = {n: tuple(np.array(x, dtype=np.int64) for x in zip(*sorted(rows), strict=True)) for n, rows in by_length.items()}
    slots = items.sparkSession.sparkContext.broadcast((plan_, base))  # bounded by the capacity: at most that many lengths, and groups in proportion
    # rank within (length, salt); the base of the salt makes it the rank within the length
    ranked = part.withColumn(rank, (F.row_number().over(Window.partitionBy(length, salt).orderBy(*order)) - 1).cast("long"))

    def place():
        plan, bases = slots.value

        def run(b):
            lengths, salted, ranks = (b.column(n).to_numpy().astype(np.int64) for n in (length, salt, rank))
            seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            cell = lengths << 32 | salted
            for c in np.unique(cell):
                at = np.flatnonzero(cell == c)
                n, s = int(c) >> 32, int(c) & 0xFFFFFFFF
                start, first, offset = plan[n]
                ranked_ = ranks[at] + bases[n, s]
                k = np.searchsorted(start, ranked_, side="right") - 1
                seq[at], off[at] = first[k] + ranked_ - start[k], offset[k]
            return [seq, off]

        return run

    placed = with_columns(ranked, "sequence_id long, offset long", place, drop=(salt, rank))
    # a full piece needs no plan: any number of its own, after the planned ones
    full = items.where(F.col(length) >= capacity).withColumns({"sequence_id": F.monotonically_increasing_id() + planned, "offset": F.lit(0).cast("long")})
    return placed.select(full.columns).unionByName(full)


def pack_documents(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Encodes, cuts and packs. The pieces' table (without ids) is written once, as it is read three times."""
    return pack(materialise(pieces(docs, path, end_id, capacity), "pieces"), capacity)


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return pack_documents(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), end_id=0)
