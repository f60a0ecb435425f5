"""Text transforms: fixed inputs and results, and the column forms against the plain ones."""

import pytest
from pyspark.sql import functions as F

from textquarry.functions import numbers as N
from textquarry.functions import repair as P
from textquarry.functions import text as T


def test_strip_links_takes_long_texts(spark):
    words = "some words,\n and [1] more " * 20000
    rows = [(1, f"[{words}](u) {words}", f"{words} {words}"), (2, "see [a [b] c](u) [open [d](v", "see a [b] c [open d](v".replace("d](v", "[d](v")), (3, None, None)]
    got = spark.createDataFrame(rows, "k int, t string, w string").select("k", T.strip_links(F.col("t")).alias("t")).collect()
    assert [r.t for r in got] == [w for _, _, w in rows]


@pytest.mark.parametrize(("text", "want"), [
    ("a\x00b\x0bc\x7f", "abc"), ("﻿﻿x", "x"), ("a\r\nb\rc", "a\nb\nc"), ("a \t\nb ", "a\nb"), ("é", "é"), ("cafÃ©", "café"), ("donâ€™t", "don't"), (None, ""), ("naïve Ã", "naïve Ã"),
    ("â€œHello Worldâ€\x9d", '"Hello World"'), ("“a” ‘b’", "\"a\" 'b'"), ("ﬁne ﬂow", "fine flow"), ("ＡＢ１　x", "AB1 x"), ("a &amp; b", "a &amp; b"), ("wait\x85", "wait…"), ("caf\u0065\u0301", "café"),
    ("\ufeffHello\x00\x01World\r\n  trailing  \r\n", "HelloWorld\n  trailing\n"), ("Line1\n\tIndented\nLine3", "Line1\n\tIndented\nLine3"),
])
def test_sanitise(text, want):
    assert P.sanitise(text) == want


@pytest.mark.parametrize(("text", "want"), [
    ("* a\n+ b\n  * c", "- a\n- b\n  - c\n"), ("*\titem", "-\titem\n"), ("a\n\n\n\nb", "a\n\nb\n"), ("", ""), (None, ""),
    ("# A\n\n# B\ntext", "# B\ntext\n"), ("## A\n### B\nx", "## A\n### B\nx\n"), ("## A\n# B\nx", "## A\n# B\nx\n"), ("# A\n# B\n# C\nx", "# C\nx\n"),
    ("```\n* keep\n\n\n\n```\n* b", "```\n* keep\n\n\n\n```\n- b\n"), ("x\n```py\n* code", "x\n```py\n* code\n```\n"), ("x\n  ```\n* code\n", "x\n  ```\n* code\n```\n"),
    ("a\r\nb", "a\nb\n"), ("**bold** *it*", "**bold** *it*\n"),
])
def test_normalise(text, want):
    assert P.normalise(text) == want


@pytest.mark.parametrize(("text", "want"), [
    ("the cat\nsat", "the cat sat"), ("the cat\n  sat on", "the cat sat on"), ("the cat\nSat", "the cat\nSat"), ("see [1]\nnext", "see [1]\nnext"), ("a\n- b", "a\n- b"),
    ("mid sentence\n\nlower goes on", "mid sentence lower goes on"), ("It ends.\n\nlower", "It ends.\n\nlower"), ("a\nb\nc", "a b c"), ("# Head\n\nlower", "# Head lower"),
    ("x\n\n\ny", "x\n\n\ny"), ("```\na\nb\n```\nc", "```\na\nb\n``` c"), ("a\n1. b", "a\n1. b"), ("a\n> b", "a\n> b"), ("", ""), (None, ""), ("a \nb", "a b"), ("\nb", "\nb"),
])
def test_merge_soft_breaks(text, want):
    assert P.merge_soft_breaks(text) == want


@pytest.mark.parametrize(("text", "want"), [
    ("a\n\n12\n\nb", "a\n\nb"), ("a\n\nPage 5\n\nb", "a\n\nb"), ("a\n\npage 1000\n\nb", "a\n\npage 1000\n\nb"), ("a\n\n— 12 —\n\nb", "a\n\nb"), ("a\n\n0\n\nb", "a\n\n0\n\nb"), ("12\nmore", "12\nmore"), ("a\n \nb", "a\n\nb"),
    ("a\n\nPAGE 5", "a\n\nPAGE 5"),
])
def test_page_numbers(spark, text, want):
    assert P.drop_page_numbers(text) == want
    assert spark.range(1).select(T.drop_page_numbers(F.lit(text))).first()[0] == want


@pytest.mark.parametrize("text", ["a\n\n```js\n\n```\n\nb", "a\n```\n| 12 |\n```\nb", "a\n```\n1234\n```\nb", "```\nx\n```", "a"])
def test_columns_equal_functions(spark, text):
    row = spark.range(1).select(T.drop_junk_fences(F.lit(text)), T.close_fence(F.lit(text + "\n ```")), T.drop_empty_sections(F.lit("# A\n# B\n" + text)), T.slide_markers(F.lit("# A\n" + text + "\n# B")), T.dash_bullets(F.lit("* " + text))).first()
    assert tuple(row) == (P.drop_junk_fences(text), P.close_fence(text + "\n ```"), P.drop_empty_sections("# A\n# B\n" + text), P.slide_markers("# A\n" + text + "\n# B"), P.BULLET.sub(r"\1-\2", "* " + text))


def test_slide_markers():
    assert P.slide_markers("a\n---\nb") == f"a\n\n{P.SLIDE}\n\nb" and P.slide_markers(f"a{P.SLIDE}b\n---\nc") == f"a{P.SLIDE}b\n---\nc"
    assert P.slide_markers("# A\nx\n# B\n## C\n# D") == f"# A\nx\n\n{P.SLIDE}\n\n# B\n## C\n\n{P.SLIDE}\n\n# D" and P.slide_markers("no head") == "no head"


def test_post_process():
    text = "* a word\ngoes on\n\n12\n\n```\n\n```\n\nEnd."
    assert P.post_process(text) == "- a word\ngoes on\n\n12\n\n```\n\n```\n\nEnd.\n"
    assert P.post_process(text, "fast") == "- a word goes on\n\nEnd.\n" and P.post_process(text, "quality") == "- a word\ngoes on\n\nEnd.\n"


def test_rounding(spark):
    values = [0.285, 2.675, 1.005, 0.125, 0.375, -0.125, 0.5, 2.5, 66.66666666666667, 0.845, 0.846, 1e9 + 0.005, 0.0, 0.115]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", N.round_python(F.col("x")).alias("p"), N.round_python(F.col("x"), 0).alias("p0"), N.to_fixed(F.col("x")).alias("f"), N.round_js(F.col("x")).alias("j")).collect()
    for r in rows:
        assert r.p == round(r.x, 2) and r.p0 == round(r.x, 0)
    fixed = {r.x: r.f for r in rows}
    assert (fixed[0.125], fixed[0.375], fixed[2.675], fixed[-0.125], fixed[1.005]) == (0.13, 0.38, 2.67, -0.13, 1.0)
    assert {r.x: r.j for r in rows}[2.5] == 3 and {r.x: r.j for r in rows}[-0.125] == 0


def test_names_and_settings(spark):
    assert N.next_version("X", set()) == "X v2" and N.next_version("X v9", {"X v10"}) == "X v11"
    assert [N.least_one(v) for v in (None, "", "3", "0", "-2", "4 jobs", "x", 7)] == [1, 1, 3, 1, 1, 4, 1, 7]
    got = spark.createDataFrame([("X",), ("X v9",), ("v3",)], "n string").select(N.next_version_column(F.col("n"))).collect()
    assert [r[0] for r in got] == ["X v2", "X v10", "v3 v2"]


def test_rounding_near_ties(spark):
    import math
    import random
    from decimal import ROUND_HALF_UP, Decimal

    rng = random.Random(3)
    ties = [(rng.randint(0, 10**6) + 0.5) / 100 for _ in range(2000)]
    values = [v for m in ties for v in (m, math.nextafter(m, 0), math.nextafter(m, math.inf))]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", N.round_python(F.col("x")).alias("p"), N.to_fixed(F.col("x")).alias("f")).collect()
    assert [r.p for r in rows] == [round(v, 2) for v in values]
    assert [r.f for r in rows] == [float(Decimal(v).quantize(Decimal("0.01"), ROUND_HALF_UP)) for v in values]


def test_marks_of_held_blocks():
    for t in ("a \x007\x00 b\n", "\x000\x00\n```\nq\n```\n\x00\x001\x01\x00\x00", "\x00\x01\x000\x01\x00```x\ny\n```\x00", "\x00" * 9 + "```\n1\n```"):
        assert P.merge_soft_breaks(t) == t
        assert P.normalise(t).strip() == t.strip() or "```" in t
    assert P.normalise("\x0012\x00").strip() == "\x0012\x00"


def test_page_numbers_on_several_lines(spark):
    t = "a\n\nPage\n12\n\nPage 3\n\n- 4 -\n\n12\n13\n\n0\n\n1000\n\nb"
    want = "a\n\nPage\n12\n\n12\n13\n\n0\n\n1000\n\nb"
    assert P.drop_page_numbers(t) == want
    assert spark.createDataFrame([(t,)], "t string").select(T.drop_page_numbers(F.col("t"))).first()[0] == want
