"""Text of plain digital PDFs by the standard library: pages in order, lines by position, fonts with a ToUnicode map or a Latin encoding.

A default for ``read_files`` where no better parser is plugged in. It draws no pictures, recognises no scans and follows no exotic filters: a
page of which nothing can be read is empty, as the rule for recognised text expects.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|/[^\s/<>\[\]()]+|[-+]?\d*\.?\d+|\[|\]|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _inflated(body: bytes) -> bytes:
    """An object's stream, unpacked if it is deflated; empty if it has another filter or is broken."""
    m = _STREAM.search(body)
    if not m:
        return b""
    head = body[: m.start()]
    if b"/Filter" not in head:
        return m[1]
    if b"/FlateDecode" not in head:
        return b""
    try:
        return zlib.decompressobj().decompress(m[1])
    except zlib.error:
        return b""


def objects(content: bytes) -> dict[int, bytes]:
    """Objects by number, those packed into object streams too; a later one takes the place of an earlier one."""
    found = {int(n): body for n, body in _OBJECT.findall(content)}
    for body in list(found.values()):
        if b"/ObjStm" in body:
            data = _inflated(body)
            first = int((re.search(rb"/First\s+(\d+)", body) or [0, b"0"])[1])
            numbers = list(map(int, data[:first].split()))
            places = list(zip(numbers[::2], numbers[1::2], strict=False))
            for (n, at), (_, end) in zip(places, [*places[1:], (0, len(data) - first)], strict=True):
                found.setdefault(n, data[first + at : first + end])
    return found


def _ref(body: bytes, name: bytes) -> int | None:
    m = re.search(rb"/" + name + rb"\s+(\d+)\s+\d+\s+R", body)
    return int(m[1]) if m else None


def _refs(body: bytes, name: bytes) -> list[int]:
    m = re.search(rb"/" + name + rb"\s*\[(.*?)\]", body, re.S)
    if m:
        return [int(n) for n in re.findall(rb"(\d+)\s+\d+\s+R", m[1])]
    one = _ref(body, name)
    return [] if one is None else [one]


def page_objects(found: dict[int, bytes]) -> list[bytes]:
    """Pages in the order of their tree, else of their numbers."""
    root = next((b for b in found.values() if re.search(rb"/Type\s*/Catalog", b)), b"")
    todo, seen, out = [_ref(root, b"Pages")], set(), []
    while todo:
        n = todo.pop()
        if n is None or n in seen or n not in found:
            continue
        seen.add(n)
        if re.search(rb"/Type\s*/Pages\b", found[n]):
            todo += _refs(found[n], b"Kids")[::-1]
        else:
            out.append(found[n])
    return out or [b for _, b in sorted(found.items()) if re.search(rb"/Type\s*/Page\b", b)]


def _unicode_map(data: bytes) -> dict[bytes, str]:
    """Codes to text, of a ToUnicode map."""
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    out = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
        out |= {bytes.fromhex(a.decode()): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            low, size, start = int(a, 16), len(a) // 2, int(c, 16)
            for i in range(min(int(b, 16) - low + 1, 65536)):
                out[(low + i).to_bytes(size, "big")] = text(b"%0*x" % (len(c), start + i))
    return out


def _fonts(page: bytes, found: dict[int, bytes]) -> dict[bytes, dict[bytes, str]]:
    """Fonts of a page that have a ToUnicode map."""
    held = found.get(_ref(page, b"Resources") or -1, page)
    m = re.search(rb"/Font\s*<<(.*?)>>", held, re.S)
    names = m[1] if m else found.get(_ref(held, b"Font") or -1, b"")
    out = {}
    for name, n in re.findall(rb"(/[^\s/<>]+)\s+(\d+)\s+\d+\s+R", names):
        cmap = _ref(found.get(int(n), b""), b"ToUnicode")
        if cmap in found:
            out[name] = _unicode_map(_inflated(found[cmap]))
    return out


def _literal(token: bytes) -> bytes:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    octal = lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], b"" if m[1] in (b"\n", b"\r") else m[1])
    return re.sub(rb"\\([0-7]{1,3}|.)", octal, token[1:-1], flags=re.S)


def _shown(raw: bytes, font: dict[bytes, str] | None) -> str:
    if not font:
        return raw.decode("cp1252", "replace")
    size = max(map(len, font))
    return "".join(font.get(raw[i : i + size], "") for i in range(0, len(raw), size))


def page_text(data: bytes, fonts: dict[bytes, dict[bytes, str]]) -> str:
    """Lines of a page's drawing: a move down begins a new one, a larger move a new paragraph."""
    out, line, stack, font, size, lead = [], [], [], None, 12.0, 0.0
    numbers = lambda n: [x for x in stack[-n:] if isinstance(x, float)]

    def down(by: float):
        if line:
            out.append("".join(line).rstrip())
            line.clear()
        if by > 1.6 * size and out and out[-1]:
            out.append("")

    at = 0.0
    for token in _TOKEN.findall(data):
        if token[:1] in b"(<":
            stack.append((_literal(token),))
        elif token[:1] in b"/[]":
            stack.append(token)
        elif re.fullmatch(rb"[-+]?\d*\.?\d+", token):
            stack.append(float(token))
        else:
            if token == b"Tf" and len(stack) > 1:
                font, size = fonts.get(stack[-2]), stack[-1] if isinstance(stack[-1], float) else size
            elif token == b"TL" and numbers(1):
                lead = stack[-1]
            elif token in (b"Td", b"TD") and len(numbers(2)) == 2 and stack[-1]:
                down(abs(stack[-1]))
                lead = -stack[-1] if token == b"TD" else lead
            elif token == b"Tm" and len(numbers(6)) == 6:
                if stack[-1] != at:
                    down(abs(stack[-1] - at) if at else 0.0)
                at = stack[-1]
            elif token in (b"T*", b"'", b'"'):
                down(lead)
            if token in (b"Tj", b"'", b'"', b"TJ"):
                for x in stack:
                    if isinstance(x, tuple):
                        line.append(_shown(x[0], font))
                    elif isinstance(x, float) and x < -180 and token == b"TJ":  # a gap as wide as a blank
                        line.append(" ")
            stack.clear()
    down(0.0)
    return "\n".join(out).strip()


def read_pdf(content: bytes) -> tuple[str, dict]:
    """(text, page_count)."""
    found = objects(content)
    pages = page_objects(found)
    texts = [page_text(b"\n".join(_inflated(found.get(n, b"")) for n in _refs(p, b"Contents")), _fonts(p, found)) for p in pages]
    return "\n\n".join(filter(None, texts)), {"page_count": len(pages)}
