"""CSV files read by splits against one reader of the whole file."""

import csv
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textquarry.sources import large_csv


@pytest.fixture
def tiny_splits(spark):
    conf = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def whole(path):
    with open(path, newline="", encoding="utf-8") as f:
        return [r for r in csv.reader(f) if r]


def read(spark, path):
    return [r.cells for r in large_csv.records(spark, f"file://{path}").orderBy("path", "split", "line").collect()]


@pytest.mark.parametrize("seed", range(4))
def test_splits_equal_the_whole_file(spark, tmp_path, tiny_splits, seed):
    rng = random.Random(seed)
    cell = lambda: "".join(rng.choice(["a", "é", ",", '"', "\n", "\r\n", " ", "数", '""', "word "]) for _ in range(rng.choice([0, 1, 5, 40, 400] if seed else [1, 5])))
    rows = [[str(i), cell(), cell()][: rng.randrange(1, 4)] for i in range(80)]
    path = tmp_path / "x.csv"
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator=rng.choice(["\n", "\r\n"])).writerows(rows)
    assert large_csv.lines(spark, f"file://{path}").select("split").distinct().count() > 5
    assert read(spark, path) == whole(path)


def test_odd_files(spark, tmp_path, tiny_splits):
    for i, text in enumerate(["", "a", "a,b\n\n\nc,d\n", '"' + "x\n" * 300 + '"\n1,2\n', "no end\n" * 30 + 'a,"open ' + "z\n" * 100, '"",""\n'* 60, "\r\n\r\n1,2\r\n"]):
        path = tmp_path / f"{i}.csv"
        path.write_bytes(text.encode())
        want = [[c.removesuffix("\n") for c in r] if "open" in text else r for r in whole(path)]
        assert read(spark, path) == want, text[:20]
    # several files at once stay apart
    got = large_csv.records(spark, f"file://{tmp_path}").groupBy("path").agg(F.count(F.lit(1)).alias("n")).collect()
    assert sorted(r.n for r in got) == sorted(n for i in range(7) if (n := len(whole(tmp_path / f"{i}.csv"))))


def test_a_task_holds_few_records_at_once(spark, tmp_path):
    rows = [[str(i), "word " * 600] for i in range(9000)]
    batch = pa.RecordBatch.from_pydict({"path": ["p"] * 9000, "split": [0] * 9000, "place": list(range(9000)), "text": [",".join(r) for r in rows]})
    made = list(large_csv.parsed(iter([batch])))
    assert [c for b in made for c in b.column("cells").to_pylist()] == rows and max(b.nbytes for b in made) < 4 << 20
    path = tmp_path / "x.csv"
    path.write_text("1,2\n")
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(conf, "10000")
    assert read(spark, path) == [["1", "2"]] and int(spark.conf.get(conf)) <= 2000


def test_cells_of_any_length(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('1,"' + "a\n" * 100_000 + '"\n2,b\n')
    assert read(spark, path) == [["1", "a\n" * 100_000], ["2", "b"]]
