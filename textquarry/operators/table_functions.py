"""Chunkers as a table function for SQL: ``SELECT d.doc_id, c.* FROM documents d, LATERAL chunks(d.text, d.category) c``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf

from textquarry.operators.chunking import chunks_of
from textquarry.operators.quality import Profile

#: Settings that a call may name, with the profile's fields.
SETTINGS = ("chunk_size", "chunk_overlap", "header_levels", "min_slide", "rows_per_chunk", "quality_min", "quality_max", "auto_fix")


# as ``chunk_documents`` names them; there is no session to parse them where a call is analysed
_TYPES = {"chunk_index": T.IntegerType(), "content": T.StringType(), "breadcrumbs": T.ArrayType(T.StringType()), "chunk_type": T.StringType(), "slide_number": T.IntegerType(), "slide_numbers": T.ArrayType(T.IntegerType()), "title": T.StringType()}
ROWS = T.StructType([T.StructField(n, t) for n, t in _TYPES.items()])


class Chunks:
    """``chunks(text, category, chunk_size => 1000, ...)``: one row a chunk, as ``chunk_documents`` gives. The category is presentation, tabular, or else document;
    settings must be constants. Null and blank texts have no chunks."""

    def __init__(self):
        self.p = None

    @staticmethod
    def analyze(text: AnalyzeArgument, category: AnalyzeArgument | None = None, **settings: AnalyzeArgument) -> AnalyzeResult:
        for name, x in {"text": text, "category": category}.items():
            if x is not None and not isinstance(x.dataType, (T.StringType, T.NullType)):
                raise ValueError(f"{name} must be a string")
        for name, x in settings.items():
            if name not in SETTINGS:
                raise ValueError(f"no setting {name}: {', '.join(SETTINGS)}")
            if not x.isConstantExpression or x.value is None:
                raise ValueError(f"{name} must be a constant")
        return AnalyzeResult(ROWS)

    def eval(self, text, category=None, **settings) -> Iterator[tuple]:
        self.p = self.p or Profile(**settings)
        for n, (content, meta) in enumerate(chunks_of(text, category, self.p)):
            slides = meta.get("slide_numbers")
            yield n, content, meta.get("breadcrumbs", []), category or "document", slides[0] if slides else None, slides, meta.get("title")


def register(spark: SparkSession, name: str = "chunks") -> None:
    spark.udtf.register(name, udtf(Chunks))
