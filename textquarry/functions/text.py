"""Text transforms as columns. Lengths are code points; white space is Unicode's where the rule says so."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Control characters, page numbers, fences.
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
PAGE_NUMBER = r"(?U)^(?:(?:[Pp]age\s+)?[1-9]\d{0,2}|[-–—]\s*[1-9]\d{0,2}\s*[-–—])$"
SLIDE = "<!-- slide -->"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def sanitise_basic(c: Column) -> Column:
    """Byte order marks, control characters, line ends and trailing blanks; composition and mojibake are in functions.repair."""
    c = F.regexp_replace(c, "^﻿+", "")
    c = F.regexp_replace(c, CONTROL, "")
    c = F.regexp_replace(c, "\r\n?", "\n")
    return F.regexp_replace(c, r"[ \t]+(?=\n|\z)", "")


def dash_bullets(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)(?<![^\n])(\s*)[*+](\s)", "$1-$2")


def squeeze_blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, "\n{3,}", "\n\n")


def close_fence(c: Column) -> Column:
    """Appends a fence where the number of fence lines is odd; white space may stand before a fence."""
    odd = F.regexp_count(c, F.lit(r"(?U)(?<![^\n])\s*```")) % 2 == 1
    return F.when(odd, F.concat(c, F.when(c.endswith("\n"), "```").otherwise("\n```"))).otherwise(c)


def drop_page_numbers(c: Column) -> Column:
    """Drops one-line paragraphs that hold a page number from 1 to 999."""
    kept = F.filter(F.split(c, r"(?U)\n\s*\n"), lambda p: strip(p).contains("\n") | ~F.rlike(strip(p), F.lit(PAGE_NUMBER)))
    return F.array_join(kept, "\n\n")


def drop_junk_fences(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?U)\n*```[^\n]*\n\s*```\n*", "\n\n")
    return F.regexp_replace(c, r"(?U)\n*```[^\n]*\n[\s|]*[1-9]\d{0,2}[\s|]*\n```\n*", "\n\n")


def strip_links(c: Column) -> Column:
    """``[text](url)`` becomes its text, one nested bracket level."""
    # possessive: Java's regexes take a stack frame for each turn of a group, one a character of the text otherwise
    return F.regexp_replace(c, r"\[((?:[^\[\]]++|\[[^\]]*+\])*+)\]\([^)]*+\)", "$1")


def drop_empty_sections(c: Column) -> Column:
    """A header that only another of its level follows goes; ten passes at most."""
    for _ in range(10):
        c = F.regexp_replace(c, r"(?U)(?<![^\n])(#{1,6})[ \t]+[^\n]+\n+(?=\1(?!#)\s+)", "")
    return c


def strip_breadcrumb(c: Column) -> Column:
    return F.regexp_replace(c, r"^>[^\n]*\n?(?:[ \t]*\n)*", "")


def first_title(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?<![^\n])#\s+([^\n]+)", 1), F.lit(""))


def token_estimate(c: Column) -> Column:
    words = F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))
    return F.least((words * F.lit(1.3)).cast("int"), F.lit(512))


def parse_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def slide_markers(c: Column) -> Column:
    """Keeps slide markers; else rules become markers; else one goes before each top header but the first."""
    rule, marker, head = r"(?U)\n\s*---\s*\n", f"\n\n{SLIDE}\n\n", r"(?s)\A((?:.*?\n)??# )(.*)\z"
    rest = F.replace(F.regexp_extract(c, head, 2), F.lit("\n# "), F.lit(f"{marker}# "))
    by_head = F.when(c.rlike(head), F.concat(F.regexp_extract(c, head, 1), rest)).otherwise(c)
    return F.when(c.contains(SLIDE), c).when(c.rlike(rule), F.regexp_replace(c, rule, marker)).otherwise(by_head)


# Words in a header that say what its numbers are.
MONEY, SHARES, PLAIN = ("revenue", "price", "cost", "salary", "usd", "amount"), ("rate", "percent"), ("id", "code", "year")


def smart_value(header: str, value: Column) -> Column:
    """A cell formatted by words in its header: money, rates, thousands. For finite numbers in plain notation; readers have ``smart_cell``."""
    head, v = header.lower(), strip(value)
    x = F.replace(v, F.lit(","), F.lit("")).try_cast("double")
    if any(w in head for w in MONEY):
        money = F.concat(F.lit("$"), F.format_number(x, 2))
        return F.when(x.isNull(), v).otherwise(money)
    if any(w in head for w in SHARES):
        return F.when(x.isNull(), v).when(x < 1, F.concat(F.format_string("%.1f", x * 100), F.lit("%"))).otherwise(F.concat(x.cast("string"), F.lit("%")))
    if any(w in head for w in PLAIN):
        return v
    return F.when(x.isNull() | (x <= 999), v).when(x == F.floor(x), F.format_number(x, 0)).otherwise(F.format_number(x, 2))


def table_head(names: list[str]) -> str:
    """Header and separator rows of a table."""
    safe = [n.replace("|", "&#124;").replace("\n", " ") for n in names]
    return f"| {' | '.join(safe)} |\n| {' | '.join('---' for _ in names)} |"


def table_head_of(names: Column) -> Column:
    """The same of an array of names, row by row."""
    safe = F.transform(names, lambda n: F.translate(F.replace(n, F.lit("|"), F.lit("&#124;")), "\n", " "))
    return F.concat(F.lit("| "), F.array_join(safe, " | "), F.lit(" |\n| "), F.array_join(F.transform(names, lambda _: F.lit("---")), " | "), F.lit(" |"))


def table_row(cells: list[Column]) -> Column:
    safe = [F.replace(F.replace(strip(F.coalesce(c, F.lit(""))), F.lit("|"), F.lit("&#124;")), F.lit("\n"), F.lit("<br>")) for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *safe), F.lit(" |"))


def sentence_row(names: list[str], cells: list[Column], sheet: str | None = None) -> Column:
    """``Name is value.`` for each cell that isn't blank, after the sheet's name where there is one; null for a row of blanks."""
    said = [F.when(strip(c) != "", F.concat(F.lit(f"{n.strip()} is "), smart_value(n, c))) for n, c in zip(names, cells, strict=True)]
    joined = F.concat_ws(". ", *said)
    lead = f"Sheet: {sheet}. " if sheet is not None else ""
    return F.when(joined != "", F.concat(F.lit(lead), joined, F.lit(".")))
