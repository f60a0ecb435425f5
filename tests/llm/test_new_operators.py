"""Fill-in-middle ropes, covering SimHash and quantised hard negatives against brute force, and on odd rows."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.llm import fim, hard_negatives, simhash

from .conftest import BIG, LONG, ROWS

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)


# op11


def by_hand(key, text, seed=1):
    units, h = UNIT.findall(text), hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h, n = [int(h[i : i + 8], 16) for i in range(0, 32, 8)], len(UNIT.findall(text))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return (n, "plain", None, None, text)
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def heights(tree):
    if isinstance(tree, fim.Node):
        assert abs(tree.left.height - tree.right.height) <= 1 and tree.units == tree.left.units + tree.right.units and tree.chars == tree.left.chars + tree.right.chars
        heights(tree.left)
        heights(tree.right)
    else:
        assert tree.units == len(UNIT.findall(tree.text))


def test_rope_splits_and_joins(monkeypatch):
    monkeypatch.setattr(fim, "LEAF", 3)
    rng = random.Random(0)
    for _ in range(300):
        text = "".join(rng.choice(["a", "Bc", " ", "é", "数", "🙂", "\n", "<P", "[", "`", "{", "@"]) for _ in range(rng.randrange(120)))
        units = UNIT.findall(text)
        tree = fim.rope(text)
        heights(tree)
        assert fim.text_of(tree) == text and tree.units == len(units)
        k = rng.randrange(len(units) + 1)
        for a, b in (fim.split(tree, k), fim.split(tree, len("".join(units[:k])), "chars")):
            heights(a)
            heights(b)
            assert (fim.text_of(a), fim.text_of(b)) == ("".join(units[:k]), "".join(units[k:]))
            # put back the other way round: each still ends where a unit ends only if no letters meet
            heights(fim.join(fim.join(a, fim.sentinel("<S>")), b))


def test_rope_stays_low():
    tree = fim.rope("word 1\n" * 200_000)
    limit = 2 + 1.45 * math.log2(tree.units / fim.LEAF)
    rng = random.Random(1)
    for _ in range(200):
        a, b = fim.split(tree, rng.randrange(tree.units))
        tree = fim.join(b, a)
        assert tree.height <= limit and tree.chars == 1_400_000


def test_fill_in_middle_query(spark, sf, whole):
    got = {r.doc_id: r for r in fim.op11_rope_fill_in_middle(spark, sf).collect()}
    assert got.keys() == whole.keys()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for k, t in whole.items():
        *head, out = by_hand(k, t)
        assert tuple(got[k])[1:] == (*head, sha(out), sha(t))
    assert {r.form for r in got.values()} == {"plain", "psm", "spm"}


def test_fill_in_middle_odd_rows(spark, docs, none):
    rows = fim.fill_in_middle(docs)
    got = sorted(((r.doc_id, r.text, tuple(r.fim)) for r in rows.collect()), key=repr)
    assert got == sorted(((k, t, by_hand(k, t or "")) for k, t in ROWS), key=repr)
    assert rows.columns == [*docs.columns, "fim"]
    assert {r.restored for r in fim.restore(rows.select("fim.*")).collect()} == {t or "" for _, t in ROWS}
    assert fim.fill_in_middle(docs.withColumnRenamed("source", "FIM")).columns[-1] == "fim_"
    assert fim.fill_in_middle(none).count() == 0
    odd = ["a<P>b", "<", "<<<S", "S>", "x" * 100_000, "P>" * 50, "ſK", "\0a\0", "\n\n"]
    frame = spark.createDataFrame([(i, t) for i in range(40) for t in odd], "doc_id long, text string")
    made = fim.restore(fim.fill_in_middle(frame, rate=100, spm=50).select("doc_id", "text", "fim.*")).collect()
    assert all(r.restored == r.text and (r.form == "plain") == ("<P>" in r.text) for r in made)
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs, rate=101)


# op12


def hamming_classes(fps, radius=3):
    f = np.array(fps, np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= radius
    label = np.arange(len(f))
    while not ((new := np.where(near, label[None, :], len(f)).min(axis=1)) == label).all():
        label = new
    return label


def test_fingerprint_by_hand():
    import xxhash

    for text in ("", " \t\n", "One", "One two", "ÀB c D\x0be  F G h", "a b c " * 50, LONG):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        words = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert simhash.fingerprint(text) == want


def test_same_hash_as_the_engine(spark):
    import xxhash

    for s in ("a b c", "é 数 🙂", "x" * 100):
        assert spark.range(1).select(F.xxhash64(F.lit(s))).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest(s.encode(), 42)


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_masks_cover_every_pair(radius):
    rng, masks = random.Random(radius), simhash.masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1 and all(24 <= m.bit_count() <= 48 for m in masks)
    for _ in range(3000):
        differ = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(not differ & m for m in masks)


@pytest.mark.parametrize("crowd", [1, 4, 512])
def test_links_of_small_and_crowded_buckets(spark, crowd):
    """Chains, stars and dense balls, whose hub isn't near all: with a low ``crowd`` every bucket goes by marked points."""
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(100)}
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(40):
            fps.add(x)
            x ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 4])))
        fps |= {x ^ sum(1 << b for b in rng.sample(range(12), rng.randrange(6))) for _ in range(40)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    want, at = hamming_classes(fps), {x: i for i, x in enumerate(fps)}
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for r in simhash.links(nodes, crowd=crowd).collect():
        a, b = at[r.a & (2**64 - 1)], at[r.b & (2**64 - 1)]
        assert want[a] == want[b]
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert [root(i) for i in range(len(fps))] == list(want)


def test_simhash_query(spark, sf, whole):
    ids = sorted(whole)
    fps = [simhash.fingerprint(whole[i]) for i in ids]
    want = {i: (format(x, "016x"), ids[c]) for i, x, c in zip(ids, fps, hamming_classes(fps), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op12_covering_simhash(spark, sf).collect()} == want


def test_simhash_odd_rows(spark, docs, none):
    got = simhash.near_duplicates(docs).collect()
    fps = [simhash.fingerprint(t or "") for _, t in ROWS]
    label = hamming_classes(fps)
    least = {}
    for (k, _), c in zip(ROWS, label, strict=True):
        if k is not None:
            least[c] = min(k, least.get(c, BIG))
    want = [(k, x - (1 << 64) if x >> 63 else x, least.get(c)) for (k, _), x, c in zip(ROWS, fps, label, strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert simhash.near_duplicates(none).count() == 0
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same words again and again").otherwise(F.concat(F.lit("t "), F.sha2(F.col("id").cast("string"), 256))).alias("text"))
    got = simhash.near_duplicates(hot).groupBy("component").count().where("count = 1000").collect()
    assert [r.component for r in got] == [0]


# op13


def negatives_by_hand(rows):
    """rows: (id, label, vector); integer windows over all pairs."""
    out = []
    made = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v], j) for j, (i, label, v) in enumerate(rows) if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    place = lambda i: (i is None, i or 0)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for i, label, v, j in made:
        if i is None or i % 50:
            continue
        scored = sorted(((-dot(v, w), place(k), k, m == label) for k, m, w, o in made if o != j), key=lambda x: x[:2])
        for s, _, k, same in [x for x in scored if x[3]][:5]:
            inside = [(-t, q) for t, _, q, alike in scored if not alike and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(i, k, r, q, -s, t) for r, (t, q) in enumerate(inside, 1)]
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>, id string, v int, row int")


def test_hard_negatives_on_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(i), int(rng.integers(4)), [float(x) for x in rng.normal(size=10)]) for i in range(400)]
    rows += [(1000, None, [1.0] * 10), (1050, 1, None), (1100, 1, [1.0, None]), (1150, 1, [float("nan")] * 10), (1200, 2, [float("inf")] * 10), (1250, 1, []), (1300, 1, [0.0] * 10), (1350, 2, [0.5, 0.25])]
    rows += [rows[50], rows[50], rows[7], (None, 1, rows[100][2]), (None, None, None), (50, 3, rows[100][2])]
    rows += [(2000 + i, i % 3, [0.5 if j < i % 4 else 0.0 for j in range(10)]) for i in range(60)]  # many ties
    rows += [(3000, 9, [1.0] * 10)]  # no other row of its label
    want = negatives_by_hand(rows)
    odd = frame(spark, [(*r, "x", None, 3) for r in rows])
    assert len(want) > 100
    for block, anchors in ((2048, 256), (37, 5)):
        monkeypatch.setattr(hard_negatives, "BLOCK", block)
        monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
        got = hard_negatives.hard_negatives(odd.repartition(3))
        assert sorted(map(tuple, got.collect()), key=repr) == want
    assert hard_negatives.hard_negatives(odd.where("1 = 0")).count() == 0


def test_estimates_bound_exact_products():
    rng = np.random.default_rng(0)
    x = np.floor(rng.normal(size=(500, 30)) * 256).astype(np.int64)
    x[:20] *= 1000
    book = hard_negatives.fit(x[100:].astype(float), parts=7, centroids=16)
    codes, left = hard_negatives.encode(x.astype(float), book)
    score, off = hard_negatives.estimates(x[:50], codes, left, book)
    exact = hard_negatives.products(x[:50], x)
    assert (exact == x[:50] @ x.T).all() and (np.abs(exact - score) <= off).all()
    inside = off[30:, 100:] < np.linalg.norm(x[30:50], axis=1)[:, None] * np.linalg.norm(x[100:], axis=1)[None, :]
    assert inside.mean() > 0.99  # the residual bound says more than the norms alone
    big = np.full((1, 4), 1 << 27, np.int64)
    assert hard_negatives.products(big, big)[0, 0] == 4 << 54


def test_estimates_rule_rows_out():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(10, 64))
    v = centres[rng.integers(10, size=3000)] + rng.normal(size=(3000, 64)) * 0.3
    v = np.floor(256 * v / np.linalg.norm(v, axis=1)[:, None]).astype(np.int64)
    book = hard_negatives.fit(v.astype(float))
    codes, left = hard_negatives.encode(v.astype(float), book)
    score, off = hard_negatives.estimates(v[:20], codes, left, book)
    sure = np.sort(score - off, axis=1)[:, -5]
    assert ((score + off) >= sure[:, None]).mean() < 0.2


@pytest.mark.parametrize(("query", "sql"), [(fim.op11_rope_fill_in_middle, fim.SQL), (hard_negatives.op13_product_quantised_negatives, hard_negatives.SQL)])
def test_agrees_with_sql(spark, sf, query, sql):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = c.execute(sql)
    names = [x[0] for x in want.description]
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r[x] for x in names)) for r in query(spark, sf).collect())
