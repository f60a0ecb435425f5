"""The pipeline against a version of each stage over Python lists."""

from collections import Counter

import public_tokenizers as P

import corpus_pipeline
from textquarry.llm import cotraining, neardup, packing, toxicity
from textquarry.llm.common import table

from .conftest import BIG, ROWS
from .test_operators import classes_by_hand, check_packing, tok


def test_pipeline_equals_its_stages_by_hand(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (table(spark, sf, t) for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in docs.collect()}
    good = cotraining.learn(docs, labels)
    left = [k for k in sorted(rows) if good.score(rows[k].text, rows[k].lang, rows[k].source)[2] >= cotraining.THRESHOLD]
    assert len(left) < len(rows)
    grammar = toxicity.learn(docs.where(docs.doc_id.isin(left)), labels)
    calm = [k for k in left if grammar.score(rows[k].text) < toxicity.THRESHOLD]
    assert len(calm) < len(left)
    once = [k for i, (k, c) in enumerate(zip(calm, classes_by_hand([rows[k].text or "" for k in calm]), strict=True)) if c == i]
    assert len(once) < len(calm)
    t = tok("byte_bpe_50k.json")
    want = [(k, [*t.encode(rows[k].text or "", add_special_tokens=False).ids, 0]) for k in once]
    got = corpus_pipeline.run(spark, sf).collect()
    used, least = check_packing(got, want, packing.CAPACITY)
    assert used <= least * 1.01 + 1


def test_stages_on_odd_rows(spark, docs, none, tmp_path):
    spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_dedup", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        if name in ("quality", "toxicity"):  # one kind of label: nothing is rejected
            assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
        if name == "near_dedup":
            kept = Counter((r.doc_id, r.text) for r in out.collect())
            assert kept[BIG, "a key that no double holds"] == kept[None, "null key"] == 1 and kept[None, "½ ² 3"] == 1
            assert len({r.doc_id for r in out.collect()}) == len({i for i, _ in ROWS} - {1, 5}) and all(n == 1 for n in kept.values())
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == {i for i, _ in ROWS}
        assert stage(spark, none, str(tmp_path)).count() == 0
    assert neardup.THRESHOLD >= 0.8 and P.path("byte_bpe_50k.json")
