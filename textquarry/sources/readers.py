"""Files to Markdown: one row a file in, one row out, errors as columns.

Nothing is collected and no task holds more than its batch: files come as ``binaryFile`` rows, or any frame of (name, format, content).
A parser can be plugged in for any format: a function from bytes to (markdown, metadata). PDF has a plain one by default.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions.encodings import detect
from textquarry.functions.repair import SLIDE, post_process, sanitise, slide_markers, strip_links
from textquarry.sources import office
from textquarry.sources.detect import category, detect_format, page_count
from textquarry.sources.html import to_markdown
from textquarry.sources.pdf import read_pdf
from textquarry.sources.tables import MOST_COLUMNS, MOST_ROWS, as_markdown, delimiter_of, parse_csv

Parser = Callable[[bytes], tuple[str, dict]]


@dataclass(frozen=True)
class Options:
    """``pdf_parser``: fast or quality, which says what follows parsing; ``ocr_mode``: auto, force or never."""

    most_rows: int = MOST_ROWS
    most_columns: int = MOST_COLUMNS
    pdf_parser: str = "fast"
    ocr_mode: str = "auto"


def encoding_of(content: bytes) -> str:
    """By byte order mark, else UTF-8 where the bytes are, else by what the bytes look like."""
    return detect(content)[0]


def decode(content: bytes) -> tuple[str, str]:
    """(text, encoding); bytes that don't decode are replaced."""
    name = encoding_of(content)
    return sanitise(content.decode(name, errors="replace").lstrip("﻿")), name


def read_text(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with text, encoding and confidence in place of the bytes, and nothing else done to the text; nulls give nulls."""
    kept = [n for n in files.columns if n != content]

    def run(batches):
        for b in batches:
            told = [None if x is None else detect(x) for x in b.column(content).to_pylist()]
            texts = [None if x is None else x.decode(t[0], errors="replace").removeprefix("\ufeff") for x, t in zip(b.column(content).to_pylist(), told, strict=True)]
            added = [pa.array(texts, pa.string()), pa.array([t and t[0] for t in told], pa.string()), pa.array([t and t[1] for t in told], pa.float64())]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in kept], *added], names=[*kept, "text", "encoding", "confidence"])

    return files.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in files.dtypes if n != content) + ", text string, encoding string, confidence double")


def read_txt(content: bytes, name: str, o: Options) -> tuple[str, dict]:
    text, encoding = decode(content)
    return post_process(f"# {name}\n\n{text}"), {"encoding": encoding}


def read_md(content: bytes, name: str, o: Options) -> tuple[str, dict]:
    text, encoding = decode(content)
    return post_process(text), {"encoding": encoding}


def json_sentences(rows: list[dict], name: str) -> str:
    """A line for each object, its values that aren't blank as ``Key is value.``; a blank line after each."""
    lines = [f"# {name} (Data)"]
    for row in rows:
        said = [(k, " ".join(str(v).strip().split("\n"))) for k, v in row.items() if v is not None and str(v).strip()]
        if said:
            lines += [". ".join(f"{str(k).replace('_', ' ').title()} is {v}" for k, v in said) + ".", ""]
    return "\n".join(lines)


def json_markdown(text: str, name: str) -> str:
    """A list whose first five elements are objects as sentences, other values set out in a fence, what is no JSON as it is in a fence."""
    try:
        value = json.loads(text)
    except json.JSONDecodeError:
        return f"# {name}\n\n```\n{text}\n```"
    if isinstance(value, list) and value and all(isinstance(x, dict) for x in value[:5]):
        return json_sentences(value, name)
    return f"# {name}\n\n```json\n{json.dumps(value, indent=2, ensure_ascii=False)}\n```"


def read_json(content: bytes, name: str, o: Options) -> tuple[str, dict]:
    text, encoding = decode(content)
    return post_process(json_markdown(text, name)), {"encoding": encoding}


def read_csv(content: bytes, name: str, o: Options) -> tuple[str, dict]:
    text, encoding = decode(content)
    if not text.strip():
        return "", {}
    delimiter = delimiter_of(text)
    table = parse_csv(text, delimiter)
    if table is None or not table[0]:
        return "", {}
    markdown, strategy = as_markdown(*table, most_rows=o.most_rows, most_columns=o.most_columns)
    return post_process(markdown), {"encoding": encoding, "delimiter": delimiter, "strategy": strategy, "row_count": len(table[1]), "column_count": len(table[0])}


def read_xlsx(content: bytes, name: str, o: Options) -> tuple[str, dict]:
    markdown, facts = office.read_xlsx(content, o.most_rows, o.most_columns)
    return post_process(sanitise(markdown)), facts


def read_html(content: bytes, name: str, o: Options) -> tuple[str, dict]:
    text = sanitise(content.decode("utf-8", errors="replace"))
    if not text.strip():
        return "", {}
    markdown, title, description = to_markdown(text)
    return post_process(markdown), {"title": title, "description": description}


def read_epub(content: bytes, name: str, o: Options) -> tuple[str, dict]:
    markdown, facts = office.read_epub(content, sanitise)
    return (post_process(markdown), facts) if markdown else ("", {"error": "No content found in EPUB"})


def read_docx(content: bytes, name: str, o: Options) -> tuple[str, dict]:
    return post_process(sanitise(office.read_docx(content)[0])), {}


def read_pptx(content: bytes, name: str, o: Options) -> tuple[str, dict]:
    markdown = post_process(slide_markers(sanitise(office.read_pptx(content)[0])))
    return markdown, {"slide_count": markdown.count(SLIDE) + 1}


READERS: dict[str, Callable[[bytes, str, Options], tuple[str, dict]]] = {
    "txt": read_txt, "md": read_md, "json": read_json, "csv": read_csv, "xlsx": read_xlsx, "html": read_html, "epub": read_epub, "docx": read_docx, "pptx": read_pptx,
}


def needs_password(content: bytes | None) -> bool:
    """Whether a PDF's bytes name an encryption dictionary."""
    return bool(content) and b"/Encrypt" in content


def pdf_reader(parser: Parser):
    """A reader around a PDF parser: (markdown, {page_count, ...}) of bytes. What follows depends on the kind of parser."""

    def read(content: bytes, name: str, o: Options) -> tuple[str, dict]:
        if needs_password(content):
            raise office.Protected
        markdown, facts = parser(content)
        if o.pdf_parser == "fast":
            markdown = strip_links(markdown)
        chars, n = len(markdown), int(facts.get("page_count") or 0)
        ocr = o.ocr_mode == "force" or (o.ocr_mode == "auto" and o.pdf_parser == "quality" and chars / max(1, n) < 50)
        return post_process(sanitise(markdown), o.pdf_parser), facts | {"ocr_applied": ocr}

    return read


def _plain_reader(parser: Parser):
    def read(content: bytes, name: str, o: Options) -> tuple[str, dict]:
        markdown, facts = parser(content)
        return post_process(sanitise(markdown)), facts

    return read


FACTS = "error string, message string, encoding string, delimiter string, strategy string, title string, description string, author string, row_count long, column_count long, total_rows long, page_count int, slide_count int, sheet_count int, chapter_count int, ocr_applied boolean"
_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


def convert(content: bytes | None, name: str | None, fmt: str | None, o: Options = Options(), readers: dict | None = None) -> tuple[str, dict]:
    """(markdown, facts) of one file; what goes wrong is a fact, never an exception."""
    read = (READERS | (readers or {})).get((fmt or "").lower())
    if read is None:
        return "", {"error": f"Unsupported format: {fmt}"}
    if not content:
        return "", {}
    try:
        return read(bytes(content), name or "", o)
    except office.Protected:
        return "", {"error": "PASSWORD_PROTECTED", "message": "File is password protected. Remove password and re-upload."}
    except Exception as e:
        return "", {"error": str(e) or type(e).__name__}


def read_files(files: DataFrame, key: str = "path", name: str = "name", fmt: str = "format", content: str = "content", options: Options = Options(), parsers: dict[str, Parser] | None = None) -> DataFrame:
    """key, name, format, category, markdown, pages (the first count there is, else 1), and FACTS. ``parsers``: what a format is parsed
    by instead of the default. Rows with null content or an unknown format come out with empty Markdown."""
    extra = {f: pdf_reader(p) if f == "pdf" else _plain_reader(p) for f, p in ({"pdf": read_pdf} | (parsers or {})).items()}
    facts = [tuple(x.split()) for x in FACTS.split(", ")]
    names = ["k", "n", "f", "markdown", *[n for n, _ in facts]]

    def run(batches):
        for b in batches:
            got = [convert(*r, options, extra) for r in zip(*(b.column(x).to_pylist() for x in ("c", "n", "f")), strict=True)]
            columns = [pa.array([m for m, _ in got], pa.string())] + [pa.array([x.get(n) for _, x in got], _KINDS[t]) for n, t in facts]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("n"), b.column("f"), *columns], names=names)

    rows = files.select(F.col(key).alias("k"), F.col(name).alias("n"), F.col(fmt).alias("f"), F.col(content).alias("c"))
    out = rows.mapInArrow(run, f"k {dict(files.dtypes)[key]}, n string, f string, markdown string, {FACTS}")
    counts = [F.col(c) for c in ("page_count", "slide_count", "sheet_count", "chapter_count")]
    return out.select(F.col("k").alias(key), F.col("n").alias(name), F.col("f").alias(fmt), category(F.col("f")).alias("category"), "markdown", page_count(*counts).alias("pages"), *[n for n, _ in facts])


def load(spark: SparkSession, path: str, options: Options = Options(), parsers: dict[str, Parser] | None = None) -> DataFrame:
    """``read_files`` over a folder and all below it; formats by ending. Spark's file source passes over files without a byte."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("format", detect_format(F.lit(None).cast("string"), F.col("name")))
    return read_files(files.where(F.col("format").isNotNull()), options=replace(options), parsers=parsers)
