"""Queries over tables with empty and blank texts give DuckDB's rows; the operators under them leave empty paragraphs out."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from textquarry import registry
from textquarry.functions import text as T
from textquarry.operators.chunking import chunks_of
from textquarry.plans.quality_plans import WHOLE

TEXTS = ["", " ", "\n", " \n \n ", "A word.", "Two lines.\nAnd é."]
QUERIES = ["c10_c11_processed_chunks", "c1_c2_header_chunks", "t5_t6_page_artefacts", "s11_t15_t17_html_reader", "s12_epub_reader", "s13_pdf_text", "s15_docx_reader", "s16_pptx_reader"]


@pytest.fixture(scope="module")
def blanks(tmp_path_factory):
    at = tmp_path_factory.mktemp("blanks")
    texts = [t for t in TEXTS for _ in range(3)]  # each at ids of every remainder by three
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}), at / "documents.parquet")
    return str(at)


@pytest.mark.parametrize("name", QUERIES)
def test_agrees_with_sql_on_empty_texts(spark, blanks, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{blanks}/documents.parquet'")
    want = c.execute(registry.oracle_sql()[name])
    columns = [x[0] for x in want.description]
    assert sorted(map(tuple, registry.queries()[name](spark, blanks).select(columns).collect())) == sorted(want.fetchall())


def test_chunker_strips_lines():
    assert [c for c, _ in chunks_of("# H 1\n\nbody ", "document", WHOLE)] == ["> H 1\n\nbody"]


def test_page_numbers_leave_no_blank_paragraph(spark):
    x = spark.createDataFrame([("0\n\n\n\nz",)], "x string")
    assert x.select(T.drop_page_numbers(x.x)).first()[0] == "0\n\nz"
