"""Fill-in-middle transformation over ropes.

A text is a balanced tree of leaves; each node keeps how many units (a run of ASCII letters, or any other single code point) and how
many code points lie under it. A document is cut at two unit ranks by splitting its tree twice; the three subtrees are put together
in another order with the sentinels between, without touching the leaves inside them. ``restore`` builds the tree of an output, finds
the two inner sentinels, splits there by code points and joins the parts in their old order.

Null texts are read as empty. Empty texts, those that hold a sentinel already and a share picked by the key's digest stay plain. A
null key has the digest of the empty decimal. Repeated rows come out alike, equal keys have the same cuts where their texts have as many
units. Other columns pass as they are, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import fresh, table, whole_text, with_columns

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents, how many are transformed, and of 100 of these, how many have the suffix first.
RATE, SPM = 90, 20
#: Units a leaf holds.
LEAF = 1024


def unit_starts(text: str) -> np.ndarray:
    """Code-point places where a unit of ``text`` starts."""
    points = np.frombuffer(text.encode("ascii"), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = ((points | 32) >= 97) & ((points | 32) <= 122)
    inner = letter.copy()
    inner[1:] &= letter[:-1]
    inner[:1] = False
    return np.flatnonzero(~inner)


@dataclass(frozen=True, slots=True)
class Leaf:
    text: str
    units: int
    height = 0

    @property
    def chars(self) -> int:
        return len(self.text)


class Node:
    __slots__ = ("chars", "height", "left", "right", "units")

    def __init__(self, left: Rope, right: Rope):
        self.left, self.right = left, right
        self.units, self.chars = left.units + right.units, left.chars + right.chars
        self.height = 1 + max(left.height, right.height)


Rope = Leaf | Node
EMPTY = Leaf("", 0)


def rope(text: str) -> Rope:
    """The balanced tree of a text. Leaves end where units end, so counts of units add up."""
    starts = unit_starts(text)
    ends = [*starts[LEAF::LEAF].tolist(), len(text)]
    level: list[Rope] = []
    for i, end in enumerate(ends):
        begin = ends[i - 1] if i else 0
        level.append(Leaf(text[begin:end], min(LEAF, len(starts) - i * LEAF)))

    def over(a: int, b: int) -> Rope:
        return level[a] if b - a == 1 else Node(over(a, (a + b) // 2), over((a + b) // 2, b))

    return over(0, len(level))


def join(a: Rope, b: Rope) -> Rope:
    """The tree of ``a`` followed by ``b``, of a height at most one over that of the higher one: the lower tree goes down the other's edge."""
    if not a.chars or not b.chars:
        return a if a.chars else b
    if a.height > b.height + 1:
        return balanced(a.left, join(a.right, b))
    if b.height > a.height + 1:
        return balanced(join(a, b.left), b.right)
    return Node(a, b)


def balanced(a: Rope, b: Rope) -> Rope:
    """Node of two trees whose heights differ by at most two: turned once, or twice, if by two."""
    if a.height > b.height + 1:
        if a.right.height > a.left.height:
            return Node(Node(a.left, a.right.left), Node(a.right.right, b))
        return Node(a.left, Node(a.right, b))
    if b.height > a.height + 1:
        if b.left.height > b.right.height:
            return Node(Node(a, b.left.left), Node(b.left.right, b.right))
        return Node(Node(a, b.left), b.right)
    return Node(a, b)


def split(tree: Rope, rank: int, by: str = "units") -> tuple[Rope, Rope]:
    """The first ``rank`` units (or ``chars``, at the end of a unit) of a tree, and the rest."""
    if rank <= 0:
        return EMPTY, tree
    if rank >= getattr(tree, by):
        return tree, EMPTY
    if isinstance(tree, Node):
        under = getattr(tree.left, by)
        if rank < under:
            a, b = split(tree.left, rank, by)
            return a, join(b, tree.right)
        a, b = split(tree.right, rank - under, by)
        return join(tree.left, a), b
    starts = unit_starts(tree.text)
    at = int(starts[rank]) if by == "units" else rank
    units = rank if by == "units" else int(np.searchsorted(starts, rank))
    return Leaf(tree.text[:at], units), Leaf(tree.text[at:], tree.units - units)


def leaves(tree: Rope) -> Iterator[str]:
    todo = [tree]
    while todo:
        x = todo.pop()
        if isinstance(x, Node):
            todo += (x.right, x.left)
        else:
            yield x.text


def text_of(tree: Rope) -> str:
    return "".join(leaves(tree))


def sentinel(mark: str) -> Leaf:
    return Leaf(mark, len(unit_starts(mark)))


def arrange(tree: Rope, low: int, high: int, form: str) -> tuple[Rope, int, int]:
    """The tree cut after ``low`` and ``high`` units and put in the order of ``form``; code points of its prefix and middle."""
    prefix, rest = split(tree, low)
    middle, suffix = split(rest, high - low)
    p, s, m = map(sentinel, (PREFIX, SUFFIX, MIDDLE))
    order = (p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle)
    out = EMPTY
    for part in order:
        out = join(out, part)
    return out, prefix.chars, middle.chars


def restored(output: str, form: str) -> str:
    """The text that ``arrange`` made ``output`` of. The text holds no sentinel, and no sentinel overlaps another."""
    if form == "plain":
        return output
    _, tree = split(rope(output), len(PREFIX), "chars")
    inner = SUFFIX if form == "psm" else PREFIX
    at, end = output.index(inner, len(inner)), output.index(MIDDLE, len(inner))
    head, rest = split(tree, at - len(inner), "chars")
    _, rest = split(rest, len(inner), "chars")
    second, rest = split(rest, end - at - len(inner), "chars")
    _, middle = split(rest, len(MIDDLE), "chars")
    prefix, suffix = (head, second) if form == "psm" else (second, head)
    return text_of(join(join(prefix, middle), suffix))


def draws(key: Column, seed: int = 1) -> Column:
    """Four unsigned 32-bit integers (array<long>) of the digest of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: int = RATE, spm: int = SPM, seed: int = 1) -> DataFrame:
    """``docs`` with ``fim`` at the end: struct of n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and output."""
    if not (0 <= rate <= 100 and 0 <= spm <= 100):
        raise ValueError("rate and spm are shares of 100")
    t, h, fim = fresh(docs.columns, "t", "h", "fim")

    def make():
        def one(text: str, h: list[int]) -> dict:
            tree = rope(text)
            n = tree.units
            if not text or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= rate:
                return {"n": n, "form": "plain", "output": text}
            form = "spm" if h[3] % 100 < spm else "psm"
            low, high = sorted(x % (n + 1) for x in h[:2])
            out, p, m = arrange(tree, low, high, form)
            return {"n": n, "form": form, "prefix_chars": p, "middle_chars": m, "output": text_of(out)}

        return lambda b: [[one(x, y) for x, y in zip(b.column(t).to_pylist(), b.column(h).to_pylist(), strict=True)]]

    kind = f"{fim} struct<n:long,form:string,prefix_chars:long,middle_chars:long,output:string>"
    return with_columns(docs.withColumns({t: whole_text(text), h: draws(F.col(key), seed)}), kind, make, drop=(t, h))


def restore(rows: DataFrame, output: str = "output", form: str = "form", name: str = "restored") -> DataFrame:
    """``rows`` with the text that each output was made of, at the end. A null output gives a null."""

    def make():
        return lambda b: [[None if x is None else restored(x, f) for x, f in zip(b.column(output).to_pylist(), b.column(form).to_pylist(), strict=True)]]

    return with_columns(rows, f"`{name}` string", make)


def op11_rope_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fim.*")
    rows = rows.withColumn("output_sha256", F.sha2("output", 256))
    return restore(rows).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2("restored", 256).alias("restored_sha256"))


SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS s, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, s, regexp_extract_all(s, '[A-Za-z]+|[^A-Za-z]') AS w, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
  ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
v AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
  CASE WHEN s = '' OR contains(s, '{PREFIX}') OR contains(s, '{SUFFIX}') OR contains(s, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain'
    WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM u),
x AS (SELECT *, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:n], '') AS f FROM v)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN s WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || f || '{MIDDLE}' || m ELSE '{SUFFIX}' || f || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
  sha256(p || m || f) AS restored_sha256 FROM x
"""
