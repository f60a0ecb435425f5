"""Chunkers: one document per row in, one chunk per row out, no shuffle. Folds are plain Python run by mapInPandas."""

from __future__ import annotations

import re
from collections import deque

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.text import token_estimate
from textquarry.operators.quality import Profile, scored

_BREADCRUMB = re.compile(r"\A>[^\n]*\n?(?:[ \t]*\n)*")


def sections(text: str, levels: int = 3) -> list[tuple[tuple[str, ...], str]]:
    """(header path, body) of each section; headers inside fences don't count, deeper ones stay in the body."""
    levels = max(1, min(6, levels))
    out: list[tuple[tuple[str, ...], str]] = []
    stack: list[tuple[int, str]] = []
    lines: list[str] = []
    fence = ""

    def flush():
        body = "\n".join(lines).strip()
        lines.clear()
        path = tuple(h for _, h in stack)
        if body and out and out[-1][0] == path:
            out[-1] = (path, out[-1][1] + "  \n" + body)
        elif body:
            out.append((path, body))

    for line in text.split("\n"):
        bare = line.strip()
        if not bare.isprintable():
            bare = "".join(c for c in bare if c.isprintable())
        if not fence and bare[:3] in ("```", "~~~"):
            fence = bare[:3]
        elif fence and bare.startswith(fence):
            fence = ""
        elif not fence and (m := re.match(r"(#{1,6}) (.*)", bare)) and len(m[1]) <= levels:
            flush()
            while stack and stack[-1][0] >= len(m[1]):
                stack.pop()
            stack.append((len(m[1]), m[2].strip()))
            continue
        if bare or fence:
            lines.append(bare if not fence else line)
        else:
            flush()
    flush()
    return out


def split_recursively(text: str, size: int, overlap: int, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ", "")) -> list[str]:
    """Pieces of at most ``size``: parted at the first separator present, merged greedily with an overlap, too long ones parted further."""
    sep = next((s for s in separators if not s or s in text))
    rest = separators[separators.index(sep) + 1 :]
    if sep:
        first, *others = text.split(sep)
        parts = [p for p in [first, *(sep + o for o in others)] if p]
    else:
        parts = list(text)
    out: list[str] = []
    held: deque[str] = deque()
    size_held = 0

    def emit():
        if joined := "".join(held).strip():
            out.append(joined)

    for p in parts:
        if len(p) >= size and rest:
            emit()
            held.clear()
            size_held = 0
            out += split_recursively(p, size, overlap, rest)
            continue
        if held and size_held + len(p) > size:
            emit()
            while held and (size_held > overlap or size_held + len(p) > size):
                size_held -= len(held.popleft())
        held.append(p)
        size_held += len(p)
    emit()
    return out


def document_chunks(text: str, p: Profile = Profile()) -> list[tuple[str, list[str]]]:
    out = []
    for path, body in sections(text, p.header_levels):
        prefix = f"> {' > '.join(path)}\n\n" if path else ""
        parts = split_recursively(body, p.chunk_size, p.chunk_overlap) if len(prefix + body) > p.chunk_size else [body]
        out += [(prefix + part, list(path)) for part in parts]
    return out


def first_title(text: str) -> str | None:
    m = re.search(r"^#\s+(.+)$", text, re.M)
    return m[1].strip() if m else None


def slide_chunks(text: str, least: int = 200) -> list[tuple[str, dict]]:
    """(content, {slide_numbers, title}): slides gather until they are long enough; blank ones only count."""
    out, held, numbers, size = [], [], [], 0

    def emit():
        content = "\n\n".join(held)
        out.append((content, {"slide_numbers": list(numbers), "title": first_title(content)}))
        held.clear()
        numbers.clear()

    for i, slide in enumerate(text.split("<!-- slide -->"), 1):
        if slide := slide.strip():
            held.append(slide)
            numbers.append(i)
            size += len(slide)
        if held and size >= least:
            emit()
            size = 0
    if held:
        emit()
    return out


def tabular_chunks(text: str, rows: int = 20) -> list[tuple[str, dict]]:
    """(content, {breadcrumbs}): a section a sheet, under its header; a section that reads as a table stays whole, others are parted into
    batches of ``rows`` paragraphs, each under the header."""
    out = []
    for section in filter(None, map(str.strip, text.split("\n\n---\n\n"))):
        head, _, body = section.partition("\n") if section.startswith("# ") else ("", "", section)
        path, body = ([head[2:].strip()] if head else []), body.strip()
        if "\n|-" in body and body.count("|") > 2:
            out.append((section, {"breadcrumbs": path}))
            continue
        lines = list(filter(None, map(str.strip, body.split("\n\n"))))
        lead = f"# {path[0]}\n\n" if path else ""
        out += [(lead + "\n\n".join(lines[i : i + rows]), {"breadcrumbs": path}) for i in range(0, len(lines), rows)]
    return out


#: Fixed values of the auto-fixer, which takes none from the profile.
FIX_MOST, FIX_LEAST, FIX_PASSES = 2000, 50, 2


def split_long(content: str, most: int = FIX_MOST) -> list[str]:
    """A chunk by paragraphs, or by sentences if it has but one, gathered up to ``most``; a part that is longer by itself stays."""
    parts = content.split("\n\n")
    if len(parts) == 1:
        parts = [p if p.endswith(".") else p + "." for p in content.split(". ") if p.strip()]
    out, held = [], ""
    for p in parts:
        if held and len(held) + 2 + len(p) > most:
            out.append(held.strip())
            held = p
        else:
            held = f"{held}\n\n{p}" if held else p
    return [*out, held.strip()] if held.strip() else out or [content]


def merge_pairs(chunks: list[tuple[str, list]], least: int = FIX_LEAST) -> list[tuple[str, list]]:
    """A chunk under ``least`` takes in the next one, whatever its length, and keeps its own breadcrumbs."""
    out, todo = [], list(chunks)[::-1]
    while todo:
        content, path = todo.pop()
        if len(content.strip()) < least and todo:
            content = f"{content}\n\n{todo.pop()[0]}"
        out.append((content, path))
    return out


def auto_fix(chunks: list[tuple[str, list]]) -> list[tuple[str, list]]:
    """Blank chunks go, long ones are split, short ones merged; twice."""
    for _ in range(FIX_PASSES):
        split = [(part, path) for c, path in chunks if c.strip() for part in (split_long(c) if len(c.strip()) > FIX_MOST else [c])]
        chunks = merge_pairs(split)
    return chunks


def auto_fixed(chunks: Column) -> Column:
    """``auto_fix`` of a document's chunks (array<string>) that share their breadcrumbs, in Arrow batches."""

    def batch(s: pd.Series) -> pd.Series:
        return s.map(lambda found: [c for c, _ in auto_fix([(x, []) for x in found])])

    batch.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(batch, "array<string>")(F.coalesce(chunks, F.array().cast("array<string>")))


def merge_small(chunks: list[tuple[str, object]], least: int = 500, most: int = 2000) -> list[tuple[str, object]]:
    """Gathers chunks under ``least`` without passing ``most``. One chunk or none stays as it is."""
    if len(chunks) <= 1:
        return chunks
    done: list[list] = []
    acc: list | None = None
    fits = lambda a, b: len(a) + 2 + len(b) <= most

    def flush():
        nonlocal acc
        if acc:
            if len(acc[0]) < least and done and fits(done[-1][0], acc[0]):
                done[-1][0] += "\n\n" + acc[0]
            else:
                done.append(acc)
        acc = None

    for content, meta in chunks:
        if len(content) >= least:
            if acc and fits(acc[0], content):
                content, acc = acc[0] + "\n\n" + content, None
            flush()
            done.append([content, meta])
            continue
        bare = _BREADCRUMB.sub("", content)
        if not bare.strip():
            continue
        if acc and fits(acc[0], bare):
            acc[0] += "\n\n" + bare
        else:
            flush()
            acc = [bare, meta]
        if len(acc[0]) >= least:
            done.append(acc)
            acc = None
    flush()
    return [(c, m) for c, m in done]


def chunks_of(text: str | None, kind: str | None, p: Profile = Profile()) -> list[tuple[str, dict]]:
    """(content, metadata) of a document by its category: presentation, tabular, anything else as a document; small ones merged if the
    profile says so."""
    if not text or not text.strip():
        return []
    if kind == "presentation":
        chunks = slide_chunks(text, p.min_slide)
    elif kind == "tabular":
        chunks = tabular_chunks(text, p.rows_per_chunk)
    else:
        chunks = [(c, {"breadcrumbs": path}) for c, path in document_chunks(text, p)]
    return merge_small(chunks, p.quality_min, p.quality_max) if p.auto_fix else chunks


CHUNK = "chunk_index int, content string, breadcrumbs array<string>, chunk_type string, slide_number int, slide_numbers array<int>, title string"


def chunk_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", p: Profile = Profile(), kind: str | None = None) -> DataFrame:
    """key and CHUNK of each chunk. ``kind``: the column of the category; without one every text is a document. One row in, its chunks out, no
    shuffle. Null and blank texts have no chunks."""
    names = [x.split()[0] for x in CHUNK.split(", ")]
    types = (pa.int32(), pa.string(), pa.list_(pa.string()), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.string())

    def run(batches):
        for b in batches:
            at, rows = [], []
            for i, (t, k) in enumerate(zip(b.column("t").to_pylist(), b.column("c").to_pylist(), strict=True)):
                for n, (content, meta) in enumerate(chunks_of(t, k, p)):
                    at.append(i)
                    slides = meta.get("slide_numbers")
                    rows.append((n, content, meta.get("breadcrumbs", []), k, slides[0] if slides else None, slides, meta.get("title")))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["k", *names])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), (F.col(kind) if kind else F.lit("document")).alias("c"))
    return rows.mapInArrow(run, f"k {dict(docs.dtypes)[key]}, {CHUNK}").withColumnRenamed("k", key)


def process(docs: DataFrame, key: str = "doc_id", text: str = "text", p: Profile = Profile(), kind: str | None = None) -> DataFrame:
    """The whole way from Markdown to scored chunks: chunk, merge, flags, score, completeness, tokens."""
    rows = scored(chunk_documents(docs, key, text, p, kind), "content", F.size("breadcrumbs") > 0, p)
    return rows.withColumn("token_count", token_estimate(F.col("content")))
