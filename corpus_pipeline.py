"""From raw documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read again as the next one's
input. All but the last return the columns of documents, and any further ones, whatever their names.

Rows of null or repeated keys and of null, empty or very long texts are judged like any others, each by itself; keys and other columns come
out as they went in. Null texts are read as empty. Without labels of both kinds quality and toxicity reject nothing. An empty table gives an
empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textquarry.llm.common import materialise, table
from textquarry.llm.cotraining import keep_good
from textquarry.llm.neardup import drop_near_duplicates
from textquarry.llm.packing import pack_documents
from textquarry.llm.toxicity import drop_toxic


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the co-trained classifier rejects. Repeated rows are kept or dropped alike."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose clauses the grammar scores as toxic; a text without words scores like one without matched clauses."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class: that of least (doc_id, digest of the text), null keys first; of repeated rows with both,
    one. Rows of one key with different texts stand each for themselves."""
    return drop_near_duplicates(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the rest into sequences of 2048 tokens: a row a piece. An empty text is one piece, the end id."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_dedup", near_dedup), ("packing", packing)]

#: Trained stages and tokenisation can't be said in SQL; tests/llm/test_pipeline.py holds run() against the stages done by hand.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, name)
    return docs
