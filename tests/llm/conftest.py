"""Rows that every operator meets: nulls in any column, empty and very long texts, repeated rows and keys, keys beyond 2^53, clashing names."""

import pytest

LONG = "the quick brown fox jumps over lazy dogs and runs, far  away.\n" * 800
NEAR = " ".join(f"word{i}" for i in range(200))
BIG = 9007199254740993
ROWS = [
    (0, None), (1, ""), (2, "the cat sat on the mat with a hat"), (2, "the cat sat on the mat with a hat"), (3, LONG), (4, NEAR), (5, NEAR + " tail"),
    (6, "Licensed under CC BY-NC 4.0. All rights reserved. GNU General Public License, version 3 or later"), (7, "!!! ??? %%%"), (8, "don't  STOP\tÉté naïve 数学 🙂 it's"), (None, "null key"),
    (BIG, "a key that no double holds"), (BIG, "the same key with another text"), (None, "null key"), (None, "½ ² 3"),
]
#: Columns whose names operators use themselves, whatever they hold.
CLASH = "quality_score double, tox_score string, sequence_id long, `offset` long, salt int, digest string, id int, t string, k long, h long, own long"


@pytest.fixture(scope="session")
def rows():
    return ROWS


@pytest.fixture(scope="session")
def docs(spark):
    extra = (0.5, "x", BIG, None, 1, "d", 7, "t", None, BIG, 3)
    made = [(i, t, None if j % 3 else "en", None if j % 4 else "s", None, *extra) for j, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(made, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("1 = 0")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def whole(spark, sf):
    """doc_id -> text of a small table."""
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
