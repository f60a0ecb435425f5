"""Order-dependent text repair: plain functions with Arrow-batched column forms."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F

from textquarry.functions.encodings import repair_mojibake

# The patterns that define a fence, a fence line, a bullet, an empty section, a page number and an empty fence.
FENCED = re.compile(r"```[^\n]*\n.*?```", re.S)
FENCE_LINE = re.compile(r"^\s*```", re.M)
BULLET = re.compile(r"^(\s*)[*+](\s)", re.M)
EMPTY_SECTION = re.compile(r"^(#{1,6})[ \t]+[^\n]+\n+(?=\1(?!#)\s+)", re.M)
PAGE_NUMBER = re.compile(r"(?:[Pp]age\s+)?[1-9]\d{0,2}|[-–—]\s*[1-9]\d{0,2}\s*[-–—]")
JUNK_FENCES = (re.compile(r"\n*```[^\n]*\n\s*```\n*"), re.compile(r"\n*```[^\n]*\n[\s|]*[1-9]\d{0,2}[\s|]*\n```\n*"))
SLIDE = "<!-- slide -->"
RULE = re.compile(r"\n\s*---\s*\n")
LINK = re.compile(r"\[((?:[^\[\]]|\[[^\]]*\])*)\]\([^)]*\)")

# What stands for what in plain text.
QUOTES = {**dict.fromkeys("\u02bc\u2018\u2019\u201a\u201b", "'"), **dict.fromkeys("\u201c\u201d\u201e\u201f", '"')}
LIGATURES = dict(zip("ĲĳŉǱǲǳǄǅǆǇǈǉǊǋǌﬀﬁﬂﬃﬄﬅﬆ", "IJ ij ʼn DZ Dz dz DŽ Dž dž LJ Lj lj NJ Nj nj ff fi fl ffi ffl ſt st".split(), strict=True))
WIDTHS = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in (0x3000, *range(0xFF01, 0xFFF0)) if unicodedata.normalize("NFKC", chr(c)) != chr(c)}
_PLAIN = str.maketrans(LIGATURES | WIDTHS | QUOTES)


def _windows_char(c: str) -> str:
    try:
        return c.encode("latin-1").decode("cp1252")
    except UnicodeDecodeError:
        return c


def plain_characters(text: str) -> str:
    """Mojibake, quotes, ligatures, full and half widths, and Windows characters that stand as control codes. Entities stay, as tables need them."""
    text = repair_mojibake(text).translate(_PLAIN)
    return re.sub("[\x80-\x9f]", lambda m: _windows_char(m[0]), text)


def sanitise(text: str | None) -> str:
    if not text:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFC", plain_characters(text).lstrip("\ufeff"))
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", text)
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    return re.sub(r"[ \t]+$", "", text, flags=re.M)


class _Fences:
    """Takes fenced blocks out of a text and puts them back. What stands for a block is a number between marks that the text doesn't hold."""

    def __init__(self, text: str):
        self.kept: list[str] = []
        self.mark = "\x00" * (1 + max(map(len, re.findall("\x00+", text)), default=0))

    def out(self, text: str) -> str:
        def hold(m):
            self.kept.append(m[0])
            return f"{self.mark}{len(self.kept) - 1}\x01{self.mark}"

        return FENCED.sub(hold, text)

    def back(self, text: str) -> str:
        return re.sub(f"{self.mark}([0-9]+)\x01{self.mark}", lambda m: self.kept[int(m[1])], text)


def drop_empty_sections(text: str) -> str:
    """A header that only another of its level follows goes; ten passes at most."""
    for _ in range(10):
        text, n = EMPTY_SECTION.subn("", text)
        if not n:
            break
    return text


def close_fence(text: str) -> str:
    """Appends a fence where the number of fence lines is odd; white space may stand before a fence."""
    if len(FENCE_LINE.findall(text)) % 2:
        return text + ("```" if text.endswith("\n") else "\n```")
    return text


def normalise(text: str | None) -> str:
    """Markdown with ``-`` bullets, single blank lines, closed fences and no empty sections; fenced blocks stay as they are."""
    if not text:
        return ""
    fences = _Fences(text)
    text = fences.out(text.replace("\r\n", "\n").replace("\r", "\n"))
    text = fences.out(close_fence(text))
    text = re.sub("\n{3,}", "\n\n", BULLET.sub(r"\1-\2", text))
    return fences.back(drop_empty_sections(text).strip() + "\n")


def merge_soft_breaks(text: str | None) -> str:
    """Joins a line to a next one that begins with a-z, whatever the next one's indent, unless it ends in a bracket; also across one blank line
    if it ends no sentence either. A blank line joins nothing; fenced blocks stay as they are."""
    if not text:
        return ""
    fences = _Fences(text)
    todo = fences.out(text).split("\n")[::-1]
    out: list[str] = []
    while todo:
        line = todo.pop()
        now = line.rstrip()
        ahead = [x.lstrip() for x in reversed(todo[-2:])]
        gap = 1 if len(ahead) > 1 and not ahead[0] else 0
        goes_on = len(ahead) > gap and "a" <= ahead[gap][:1] <= "z"
        if now and goes_on and now[-1] not in ("])" if not gap else "]).!?:"):
            del todo[-1 - gap :]
            todo.append(f"{now} {ahead[gap]}")
        else:
            out.append(line)
    return fences.back("\n".join(out))


def drop_page_numbers(text: str | None) -> str:
    """Drops one-line paragraphs that hold a page number from 1 to 999; the others, those of several lines too, are parted by one blank line."""
    return "\n\n".join(p for p in re.split(r"\n\s*\n", text or "") if "\n" in p.strip() or not PAGE_NUMBER.fullmatch(p.strip()))


def drop_junk_fences(text: str | None) -> str:
    """Drops fences that are empty or hold a page number alone."""
    text = text or ""
    for pattern in JUNK_FENCES:
        text = pattern.sub("\n\n", text)
    return text


def post_process(text: str | None, parser: str = "") -> str:
    """What follows a reader: ``quality`` and ``fast`` name the two kinds of PDF parser, everything else is only normalised."""
    text = normalise(text)
    if parser == "fast":
        text = merge_soft_breaks(text)
    return drop_junk_fences(drop_page_numbers(text)) if parser else text


def strip_links(text: str | None) -> str:
    return LINK.sub(r"\1", text or "")


def slide_markers(text: str | None) -> str:
    """Keeps slide markers; else rules become markers; else one goes before each top header but the first."""
    text = text or ""
    if SLIDE in text:
        return text
    marker = f"\n\n{SLIDE}\n\n"
    if RULE.search(text):
        return RULE.sub(marker, text)
    first = re.search(r"^# ", text, re.M)
    return text if not first else text[: first.end()] + text[first.end() :].replace("\n# ", f"{marker}# ")


def column(function):
    """An Arrow-batched column form of a text function."""

    def batch(s: pd.Series) -> pd.Series:
        return s.map(function)

    batch.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(batch, "string")
