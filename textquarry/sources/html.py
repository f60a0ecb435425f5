"""HTML to Markdown by the standard library's parser, in one pass and without recursion."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame

# What is dropped with all it holds, and what a tag's content becomes.
DROPPED = frozenset("script style nav footer aside noscript iframe svg header".split())
DROPPED_IN_BOOKS = frozenset("script style meta link noscript".split())
FORMS = {
    "h1": "\n\n# {}\n\n", "h2": "\n\n## {}\n\n", "h3": "\n\n### {}\n\n", "h4": "\n\n#### {}\n\n", "h5": "\n\n#### {}\n\n", "h6": "\n\n#### {}\n\n",
    "p": "\n\n{}\n\n", "section": "\n\n{}\n\n", "article": "\n\n{}\n\n", "main": "\n\n{}\n\n", "div": "\n\n{}\n\n",
    "li": "\n- {}", "ul": "\n{}\n", "ol": "\n{}\n", "blockquote": "\n> {}\n", "pre": "\n```\n{}\n```\n",
    "b": "**{}**", "strong": "**{}**", "i": "*{}*", "em": "*{}*", "code": "`{}`", "tr": "\n{}", "td": " {} |", "th": " {} |",
}
LAYOUT = ("section", "article", "main", "div")
BOOK_FORMS = {tag: form for tag, form in FORMS.items() if tag not in LAYOUT}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An opening tag closes an open one of these before it.
_BLOCKS = frozenset("p div ul ol table blockquote pre section article main h1 h2 h3 h4 h5 h6 form hr".split())
CLOSES = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}} | {t: {"p"} for t in _BLOCKS}
_SCOPES = frozenset("ul ol table div section article main blockquote body html".split())


class _Node:
    __slots__ = ("tag", "href", "text", "strings")

    def __init__(self, tag: str, href: str | None = None):
        self.tag, self.href, self.text, self.strings = tag, href, [], 0

    def add(self, part: str) -> None:
        """One blank goes between parts, unless a blank stands there."""
        if part:
            if self.text and not self.text[-1].endswith(" ") and not part.startswith(" "):
                self.text.append(" ")
            self.text.append(part)


class TolerantParser(HTMLParser):
    """The library's parser, which raises on marked sections it doesn't know: here they are comments up to the next ``>``."""

    #: The kinds that the library reads itself.
    MARKED = re.compile(r"<!\[(?:temp|cdata|ignore|include|rcdata|if|else|endif)(?![-_.a-z0-9])", re.I)

    def parse_marked_section(self, i, report=1):
        if not self.MARKED.match(self.rawdata, i):
            return self.parse_bogus_comment(i)
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i)


class _Markdown(TolerantParser):
    def __init__(self, forms: dict[str, str], dropped: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.forms, self.dropped = forms, dropped
        self.open = [_Node("")]
        self.muted = self.head = 0  # depth inside what is dropped, and inside the head
        self.title: list[str] | None = None
        self.in_title, self.titles, self.description = False, 0, None

    def handle_starttag(self, tag, attrs):
        if tag == "meta" and self.description is None:
            a = dict(attrs)
            if a.get("name") == "description" and a.get("content"):
                self.description = a["content"].strip()
        if tag == "title" and not self.muted:
            self.titles += 1
            self.in_title = self.titles == 1
            if self.in_title:
                self.title = []
        if tag in self.dropped and tag not in VOID:
            self.muted += 1
        if tag == "head":
            self.head += 1
        elif tag == "body":
            self.head = 0
        if tag in VOID or self.muted or self.head or tag in ("html", "body", "head", "title"):
            return
        for node in reversed(self.open[1:]):
            if node.tag in CLOSES.get(tag, ()):
                self.close_to(node)
                break
            if node.tag in _SCOPES:
                break
        self.open.append(_Node(tag, dict(attrs).get("href") if tag == "a" else None))

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag == "head":
            self.head = 0
        if tag in self.dropped and tag not in VOID:
            self.muted = max(0, self.muted - 1)
            return
        if self.muted or self.head:
            return
        for node in reversed(self.open[1:]):
            if node.tag == tag:
                self.close_to(node)
                break

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.muted and not self.head:
            self.open[-1].add(data.strip())

    def close_to(self, node: _Node) -> None:
        """Closes open tags down to ``node``, each into the one around it."""
        while True:
            last = self.open.pop()
            text = "".join(last.text).strip()
            if text:
                if last.tag == "a":
                    text = f"[{text}]({last.href})" if last.href else text
                else:
                    text = self.forms.get(last.tag, "{}").replace("{}", text, 1)
                self.open[-1].add(text)
            if last is node:
                return

    def end(self) -> str:
        self.close()
        if len(self.open) > 1:
            self.close_to(self.open[1])
        return "".join(self.open[0].text).strip()


def to_markdown(html: str | None, book: bool = False) -> tuple[str, str | None, str | None]:
    """(markdown, title, description). ``book``: the rules for chapters of books, which keep layout tags' content as it stands."""
    p = _Markdown(BOOK_FORMS if book else FORMS, DROPPED_IN_BOOKS if book else DROPPED)
    p.feed(html or "")
    text = p.end()
    title = p.title[0].strip() if p.title and len(p.title) == 1 and p.title[0].strip() else None
    return text, title, p.description


def read_pages(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, markdown, title, description; the text as it stands, without sanitising and normalising (``readers.read_files`` does both)."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            rows = [to_markdown(h) for h in b.column("__html").to_pylist()]
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([b.column(key), *(pa.array(c, pa.string()) for c in columns)], names=[key, "markdown", "title", "description"])

    from pyspark.sql import functions as F

    return pages.select(key, F.col(html).alias("__html")).mapInArrow(run, f"`{key}` {dict(pages.dtypes)[key]}, markdown string, title string, description string")
