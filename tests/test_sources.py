"""Readers over bytes and folders."""

import json

import pytest
from pyspark.sql import functions as F

from textquarry.plans import source_plans as S
from textquarry.sources import detect, listing, office, pdf, readers, tables
from textquarry.sources.html import read_pages, to_markdown


@pytest.mark.parametrize(("html", "want"), [
    ("<h1>A</h1><h2>B</h2><h4>C</h4><h6>D</h6>", "# A\n\n \n\n## B\n\n \n\n#### C\n\n \n\n#### D"), ("<p>x <b>y</b>, <i>z</i></p>", "x **y** , *z*"), ("<ol><li>a<li>b</ol>", "- a \n- b"),
    ("a<br>b<hr>c", "a b c"), ("<pre><code>x = 1</code></pre>", "```\n`x = 1`\n```"), ("<a href='u'>t</a><a>s</a>", "[t](u) s"), ("<table><tr><th>h</th><td>d</td></tr></table>", "h | d |"), ("<blockquote>q</blockquote>", "> q"),
    ("<nav>n</nav><header>h</header><svg><text>s</text></svg><p>k</p><aside>x</aside>", "k"), ("<head><title>t</title></head><body>b</body>", "b"), ("<div><p>a</p></div>", "a"), ("", ""), (None, ""), ("<p></p><p> </p>", ""), ("a<!-- c -->b", "a b"),
    ("&lt;x&gt; &amp; &eacute;", "<x> & é"), ("<p>a<p>b", "a\n\n \n\nb"), ("</p></div>x", "x"),
])
def test_html(html, want):
    assert to_markdown(html)[0] == want


def test_html_facts():
    assert to_markdown("<title> T </title><meta name='description' content=' d '><p>x")[1:] == ("T", "d")
    assert to_markdown("<p>x")[1:] == (None, None)
    assert to_markdown("<div>" * 20000 + "deep" + "</div>" * 20000)[0] == "deep"  # no recursion
    assert to_markdown("<section>a</section><div>b</div><nav>c</nav>", book=True)[0] == "a b c"


def test_encodings():
    e = readers.encoding_of
    assert [e(b"abc"), e("é".encode()), e("é".encode("cp1252")), e(b"\xef\xbb\xbfx"), e("x".encode("utf-16")), e(b"\x81\x8d")] == ["ascii", "utf-8", "cp1252", "utf-8-sig", "utf-16", "latin-1"]
    assert readers.decode("﻿naïve\r\n".encode("utf-8-sig"))[0] == "naïve\n" and readers.decode("café".encode("latin-1"))[0] == "café"


@pytest.mark.parametrize(("text", "mark"), [("a,b\n1,2", ","), ("a;b\n1;2", ";"), ("a\tb\n1\t2", "\t"), ("a|b\n1|2", "|"), ("just words", ","), ("", ",")])
def test_delimiters(text, mark):
    assert tables.delimiter_of(text) == mark


def test_csv():
    read = lambda b: readers.convert(b, "x.csv", "csv")
    text, facts = read(b"Name,Age,City\nAlice,30,NYC\nBob,,LA\n")
    assert text == "| Name | Age | City |\n| --- | --- | --- |\n| Alice | 30 | NYC |\n| Bob |  | LA |\n"
    assert (facts["strategy"], facts["row_count"], facts["column_count"], facts["delimiter"]) == ("markdown_table", 2, 3, ",")
    many = "Name,Unit Price,Growth Rate,Paid,Size\n" + "".join(f"n{i},{i * 1000},0.{i % 10},2024,{i * 1000.5}\n" for i in range(36))
    text, facts = read(many.encode())
    rows = text.strip().split("\n\n")
    assert facts["strategy"] == "sentence_serialization" and len(rows) == 36
    assert rows[2] == "Name is n2. Unit Price is $2,000.00. Growth Rate is 20.0%. Paid is 2024. Size is 2,001."
    wide = ",".join(f"c{i}" for i in range(21)) + "\n" + ",".join("v" for _ in range(21))
    assert read(wide.encode())[1]["strategy"] == "sentence_serialization"
    assert read(b"") == ("", {}) and read(b"  \n ")[0] == "" and read(b"a,b\n1,2\n1,2,3,4\n")[0] == ""
    assert "a&#124;b" in read(b'h\n"a|b"\n')[0] and "x<br>y" in read(b'h,i\n"x\ny",2\n')[0]


@pytest.mark.parametrize(("header", "value", "want"), [
    ("Price", "1234", "$1,234.00"), ("price", "1,234.5", "$1,234.50"), ("price", "$5", "$5"), ("price", "n/a", "n/a"), ("rate", "0.456", "45.6%"), ("percent", "45", "45.0%"), ("rate", "-0.1", "-10.0%"), ("Count", "1000", "1,000"), ("Count", "999", "999"),
    ("Count", "1234.567", "1,234.57"), ("user_id", "123456", "123456"), ("Year", "2024", "2024"), ("zip code", "12345", "12345"), ("x", "  y ", "y"), ("x", "", ""), ("x", "1e5", "100,000"), ("x", "nan", "nan"), ("Paid", "5000", "5000"),
])
def test_smart_cells(header, value, want):
    assert tables.smart_cell(header, value) == want


def test_json():
    read = lambda v, raw=False: readers.convert((v if raw else json.dumps(v)).encode(), "f.json", "json")[0]
    assert read([{"first_name": "Al", "age": 3, "x": None, "y": " "}, {"first_name": "B\no"}]) == "# f.json (Data)\nFirst Name is Al. Age is 3.\n\nFirst Name is B o.\n"
    assert read({"é": 1}) == '# f.json\n\n```json\n{\n  "é": 1\n}\n```\n' and read("{bad", True) == "# f.json\n\n```\n{bad\n```\n" and read([]) == "# f.json\n\n```json\n[]\n```\n"
    assert read([{"it's": 1}]) == "# f.json (Data)\nIt'S is 1.\n"
    out, facts = readers.convert(json.dumps([{"a": 1}] * 5 + [3]).encode(), "f.json", "json")
    assert out == "" and facts["error"]  # only five are looked at


def test_office():
    sheets = [("S|1", [["Name", None, "Name"], ["a", 1, 2.5], [None, None, "x|y"]]), ("None", [])]
    text, facts = readers.convert(S.make_xlsx(sheets), "x", "xlsx")
    assert text == "# S|1\n\n| Name | Unnamed: 1 | Name.1 |\n| --- | --- | --- |\n| a | 1 | 2.5 |\n|  |  | x&#124;y |\n" and facts["sheet_count"] == 2
    long = [["Amount", "K"]] + [[i, "v"] for i in range(40)]
    text, _ = readers.convert(S.make_xlsx([("Big", long)]), "x", "xlsx")
    assert text.startswith("# Big\n\nSheet: Big. Amount is $0.00. K is v.\n\nSheet: Big. Amount is $1.00. K is v.")
    assert readers.convert(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1rest", "x", "xlsx")[1]["error"] == "PASSWORD_PROTECTED"
    assert readers.convert(b"no zip", "x", "docx")[1]["error"] and readers.convert(b"x", "x", "exe")[1]["error"] == "Unsupported format: exe"
    text, facts = readers.convert(S.make_epub([("a.xhtml", "<h1>A</h1>"), ("copyright.xhtml", "<p>c</p>"), ("b.xhtml", "<p> </p>")], "T", "W"), "x", "epub")
    assert (text, facts["chapter_count"], facts["title"], facts["author"]) == ("# A\n", 1, "T", "W")
    assert readers.convert(S.make_epub([("nav.xhtml", "x")], "T", "W"), "x", "epub")[1]["error"] == "No content found in EPUB"
    assert office.read_docx(S.make_docx([("Title", "T"), ("Heading3", "H"), ("", "p")]))[0] == "# T\n\n### H\n\np"
    text, facts = readers.convert(S.make_pptx([("A", ["x", "y"]), ("B", [])]), "x", "pptx")
    assert text == "# A\n\nx\n\ny\n\n<!-- slide -->\n\n# B\n" and facts["slide_count"] == 2


def test_folders(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("* x")
    (tmp_path / "sub" / "b.TXT").write_text("hello")
    (tmp_path / "c.zip").write_bytes(b"zz")
    (tmp_path / "d.csv").write_bytes(b"")
    got = {r.name: r for r in readers.load(spark, f"file://{tmp_path}").collect()}
    assert set(got) == {"a.md", "b.TXT"} and got["a.md"].markdown == "- x\n" and got["b.TXT"].markdown == "# b.TXT\n\nhello\n" and got["a.md"].pages == 1
    there = {r.name: (r.format, r["size"]) for r in listing.scan_folder(spark, f"file://{tmp_path}").collect()}
    assert there == {"a.md": ("md", 3), "b.TXT": ("txt", 5)}  # Spark's file source passes over empty files


def test_odd_rows(spark):
    rows = spark.createDataFrame([(None, None, None, None), (1, "x", "md", None), (1, "x", "nope", bytearray(b"a")), (2, None, "TXT", bytearray(b"t"))], "k long, name string, format string, content binary")
    got = sorted(((r.k, r.markdown, r.error) for r in readers.read_files(rows, key="k").collect()), key=str)
    assert got == sorted([(None, "", "Unsupported format: None"), (1, "", None), (1, "", "Unsupported format: nope"), (2, "# \n\nt\n", None)], key=str)
    assert readers.read_files(rows.where("1 = 0"), key="k").count() == 0
    assert spark.createDataFrame([(None,), (bytearray(b"x/Encrypty"),)], "c binary").select(detect.needs_password(F.col("c"))).collect() == [(False,), (True,)]


def test_pdf():
    text, facts = pdf.read_pdf(S.make_pdf([[("Hello (world) [x] \\", 14), ("second line", 30), ("Next é", 14)], [("Two", 14)]]))
    assert text == "Hello (world) [x] \\\nsecond line\n\nNext é\n\nTwo" and facts == {"page_count": 2}
    assert pdf.read_pdf(b"junk") == ("", {"page_count": 0}) and pdf.page_text(b"BT [(a) -250 (b) -20 (c)] TJ T* <64> Tj (\\101\\n) ' ET", {}) == "a bc\nd\nA"
    cmap = b"1 beginbfrange <0001> <0003> <0041> endbfrange 1 beginbfchar <0009> <00e9> endbfchar"
    assert pdf.page_text(b"/F2 9 Tf <00010002> Tj <0009> Tj", {b"/F2": pdf._unicode_map(cmap)}) == "ABé"
    read = lambda c, **o: readers.convert(c, "x.pdf", "pdf", readers.Options(**o), {"pdf": readers.pdf_reader(pdf.read_pdf)})
    one = S.make_pdf([[("It ends", 14), ("here.", 30), ("7", 14)]])
    assert read(one) == ("It ends here.", {"page_count": 1, "ocr_applied": False}) and read(one, pdf_parser="quality")[1]["ocr_applied"] and read(one, ocr_mode="force")[1]["ocr_applied"]
    assert read(one + b"/Encrypt 9 0 R")[1]["error"] == "PASSWORD_PROTECTED"


@pytest.mark.parametrize("odd", ["<![foo[ x ]]>", "<![ x ]>", "<![endif]>", "<![if !ie]>", "<![CDATA[x]]>", "<!DOCTYPE [", "<![", "<![[", "<!>", "<!x", "<?x", "</ >", "<![cdata", "<![include[", "<!-->", "<!--"])
def test_odd_markup_harms_no_page(spark, odd):
    pages = spark.createDataFrame([(i, f"<h1>one</h1><p>two {odd}</p><p>three</p>" * i) for i in range(3)], "page_id long, html string")
    got = {r.page_id: r.markdown for r in read_pages(pages).collect()}
    assert got[0] == "" and got[1].startswith("# one") and "two" in got[2]
