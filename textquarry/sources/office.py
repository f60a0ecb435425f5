"""Zipped office formats by the standard library: XLSX, EPUB, DOCX, PPTX."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from datetime import datetime, timedelta
from urllib.parse import unquote
from xml.etree import ElementTree

from textquarry.sources.html import to_markdown
from textquarry.sources.tables import MOST_COLUMNS, MOST_ROWS, as_markdown, as_table

#: What a chapter's file name may not hold.
SKIPPED_CHAPTERS = "toc nav cover ncx copyright title license".split()
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_OLE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"


class Protected(Exception):
    """The file needs a password."""


def _open(content: bytes) -> zipfile.ZipFile:
    if content.startswith(_OLE):  # an encrypted office file is no zip but a container around one
        raise Protected
    return zipfile.ZipFile(io.BytesIO(content))


def _name(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _all(e, name: str):
    return (x for x in e.iter() if _name(x) == name)


def _attr(e, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def _xml(z: zipfile.ZipFile, path: str):
    return ElementTree.fromstring(z.read(path))


def _links(z: zipfile.ZipFile, path: str) -> dict[str, str]:
    """Relation id -> path, of a part of the file."""
    top, base = posixpath.split(path)
    rels = f"{top}/_rels/{base}.rels"
    if rels not in z.namelist():
        return {}
    return {e.get("Id"): posixpath.normpath(posixpath.join(top, e.get("Target"))).lstrip("/") if not e.get("Target").startswith("/") else e.get("Target").lstrip("/") for e in _xml(z, rels)}


def _text(e) -> str:
    return "".join(x.text or "" for x in _all(e, "t"))


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = _xml(z, "xl/styles.xml")
    own = {int(e.get("numFmtId")): e.get("formatCode") or "" for e in _all(root, "numFmt")}
    dated = lambda n: 14 <= n <= 22 or 45 <= n <= 47 or bool(re.search("[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(n, "").lower())))
    formats = next(_all(root, "cellXfs"), [])
    return {i for i, e in enumerate(formats) if dated(int(e.get("numFmtId") or 0))}


def _cell(c, shared: list[str], dates: set[int], epoch: datetime) -> str:
    kind, value = c.get("t"), next((e.text or "" for e in c if _name(e) == "v"), "")
    if kind == "s":
        return shared[int(value)]
    if kind == "inlineStr":
        return _text(c)
    if kind == "b":
        return str(value == "1")
    if kind in ("str", "e", "d") or not value:
        return value if kind != "e" else ""
    x = float(value)
    if int(c.get("s") or 0) in dates:
        return str(epoch + timedelta(seconds=round(x * 86400)))
    return str(int(x)) if x.is_integer() else str(x)


def _place(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]*", ref)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def _distinct(names: list[str]) -> list[str]:
    """Blank names are numbered, repeated ones get a suffix."""
    out: list[str] = []
    for i, name in enumerate(names):
        name = name or f"Unnamed: {i}"
        base, n = name, 0
        while name in out:
            n += 1
            name = f"{base}.{n}"
        out.append(name)
    return out


def sheets(content: bytes) -> list[tuple[str, list[str], list[list[str]]]]:
    """(name, column names, rows) of every sheet in order, all cells strings; the first row names the columns."""
    z = _open(content)
    book = _xml(z, "xl/workbook.xml")
    links, dates = _links(z, "xl/workbook.xml"), _date_styles(z)
    shared = [_text(e) for e in _all(_xml(z, "xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in z.namelist() else []
    epoch = datetime(1904, 1, 1) if any((e.get("date1904") or "") in ("1", "true") for e in _all(book, "workbookPr")) else datetime(1899, 12, 30)
    out = []
    for s in _all(book, "sheet"):
        grid: list[list[str]] = []
        for r in _all(_xml(z, links[s.get(_R)]), "row"):
            at = int(r.get("r") or len(grid) + 1) - 1
            grid += [[] for _ in range(at - len(grid) + 1)]
            for c in (e for e in r if _name(e) == "c"):
                i = _place(c.get("r")) if c.get("r") else len(grid[at])
                grid[at] += [""] * (i - len(grid[at]) + 1)
                grid[at][i] = _cell(c, shared, dates, epoch)
        while grid and not any(grid[-1]):
            grid.pop()
        width = max(map(len, grid), default=0)
        grid = [r + [""] * (width - len(r)) for r in grid]
        out.append((s.get("name"), _distinct(grid[0]) if grid else [], grid[1:]))
    return out


def read_xlsx(content: bytes, most_rows: int = MOST_ROWS, most_columns: int = MOST_COLUMNS) -> tuple[str, dict]:
    """(markdown before sanitising, metadata)."""
    every = sheets(content)
    parts = [f"# {name}\n\n" + as_markdown(names, rows, name, most_rows, most_columns)[0] for name, names, rows in every if rows]
    return "\n\n---\n\n".join(parts), {"sheet_count": len(every), "total_rows": sum(len(rows) for _, _, rows in every)}


def read_epub(content: bytes, clean) -> tuple[str, dict]:
    """(markdown before normalising, metadata); ``clean`` sanitises a chapter."""
    z = _open(content)
    opf = next(e.get("full-path") for e in _all(_xml(z, "META-INF/container.xml"), "rootfile"))
    book, top = _xml(z, opf), posixpath.dirname(opf)
    chapters = []
    for item in _all(book, "item"):
        name = unquote(item.get("href") or "")
        if item.get("media-type") != "application/xhtml+xml" or any(w in name.lower() for w in SKIPPED_CHAPTERS):
            continue
        text = clean(to_markdown(z.read(posixpath.normpath(posixpath.join(top, name))).decode("utf-8", "replace"), book=True)[0])
        if text.strip():
            chapters.append(text)
    said = lambda tag: next((e.text for e in _all(book, tag) if e.text), None)
    return "\n\n---\n\n".join(chapters), {"chapter_count": len(chapters), "title": said("title"), "author": said("creator")}


def _table(e) -> str:
    rows = [["\n".join(filter(None, map(_text, _all(c, "p")))) for c in r if _name(c) == "tc"] for r in e if _name(r) == "tr"]
    width = max(map(len, rows), default=0)
    rows = [r + [""] * (width - len(r)) for r in rows]
    return as_table(rows[0], rows[1:]) if rows else ""


def read_docx(content: bytes) -> tuple[str, dict]:
    """Headings by style, lists, tables and paragraphs in order."""
    z = _open(content)
    body, out = next(_all(_xml(z, "word/document.xml"), "body")), []
    for e in body:
        if _name(e) == "tbl":
            out.append(_table(e))
        elif _name(e) == "p" and (text := _text(e).strip()):
            style = next((_attr(s, "val") or "" for s in _all(e, "pStyle")), "")
            level = re.fullmatch(r"[Hh]eading\s*([1-6])|([Tt]itle)", style)
            out.append(f"{'#' * int(level[1] or 1)} {text}" if level else f"- {text}" if next(_all(e, "numPr"), None) is not None else text)
    return "\n\n".join(filter(None, out)), {}


def read_pptx(content: bytes) -> tuple[str, dict]:
    """Slides in order, parted by rules: the title as a header, paragraphs, tables."""
    z = _open(content)
    links, out = _links(z, "ppt/presentation.xml"), []
    for s in _all(_xml(z, "ppt/presentation.xml"), "sldId"):
        parts = []
        for shape in next(_all(_xml(z, links[s.get(_R)]), "spTree")):
            if (grid := next(_all(shape, "tbl"), None)) is not None:
                parts.append(_table(grid))
                continue
            title = any((_attr(p, "type") or "") in ("title", "ctrTitle") for p in _all(shape, "ph"))
            said = [t for p in _all(shape, "p") if (t := _text(p).strip())]
            parts += ["# " + " ".join(said)] if title and said else said
        out.append("\n\n".join(filter(None, parts)))
    return "\n\n---\n\n".join(out), {}
