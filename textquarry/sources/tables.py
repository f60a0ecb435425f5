"""Tables of strings as Markdown: small ones as tables, others as sentences."""

from __future__ import annotations

import csv
import io

import pandas as pd

from textquarry.functions.text import MONEY, PLAIN, SHARES, table_head

#: The largest table that is shown as one, delimiters that are looked for.
MOST_ROWS, MOST_COLUMNS = 35, 20
DELIMITERS = ",;\t|"


def smart_cell(header: str, value: str) -> str:
    """A cell formatted by words in its header: money, rates, thousands."""
    head, value = header.lower(), value.strip()
    try:
        x = float(value.replace(",", ""))
    except ValueError:
        return value
    has = lambda words: any(w in head for w in words)
    if has(MONEY):
        return f"${x:,.2f}"
    if has(SHARES):
        return f"{x:.1%}" if x < 1.0 else f"{x}%"
    if x > 999 and not has(PLAIN):
        return f"{x:,.0f}" if x.is_integer() else f"{x:,.2f}"
    return value


def as_table(names: list[str], rows: list[list[str]]) -> str:
    if not names:
        return ""
    safe = lambda v: v.strip().replace("|", "&#124;").replace("\n", "<br>")
    return "\n".join([table_head(names), *(f"| {' | '.join(map(safe, r))} |" for r in rows)])


def as_sentences(names: list[str], rows: list[list[str]], sheet: str | None = None) -> str:
    """``Name is value.`` for each cell that isn't blank, a blank line between rows."""
    lead = [f"Sheet: {sheet}"] if sheet is not None else []
    said = ([f"{n.strip()} is {smart_cell(n, v)}" for n, v in zip(names, r, strict=True) if v.strip()] for r in rows)
    return "\n\n".join(". ".join(lead + parts) + "." for parts in said if parts).strip()


def as_markdown(names: list[str], rows: list[list[str]], sheet: str | None = None, most_rows: int = MOST_ROWS, most_columns: int = MOST_COLUMNS) -> tuple[str, str]:
    """(markdown, strategy)."""
    if len(rows) <= most_rows and len(names) <= most_columns:
        return as_table(names, rows), "markdown_table"
    return as_sentences(names, rows, sheet), "sentence_serialization"


def delimiter_of(content: str) -> str:
    """By the first ten lines; a comma where that says nothing."""
    try:
        return csv.Sniffer().sniff("\n".join(content.split("\n")[:10]), delimiters=DELIMITERS).delimiter
    except csv.Error:
        return ","


def parse_csv(content: str, delimiter: str) -> tuple[list[str], list[list[str]]] | None:
    """(names, rows), all cells strings; None for what can't be parsed."""
    try:
        df = pd.read_csv(io.StringIO(content), delimiter=delimiter, dtype=str, keep_default_na=False)
    except Exception:
        return None
    return [str(c) for c in df.columns], [[str(v) for v in r] for r in df.itertuples(index=False, name=None)]
