"""Byte-level BPE encoding and decoding by the tiktoken library from a local rank file.

Long texts are cut by a regex at safe boundaries, so that no call holds a very long text's state; decoding is of raw
bytes. Only a single run of letters, of digits, of marks or of white space is never cut, as it may be one token's worth of merges. A null or empty text has no ids and decodes to no bytes. Repeated rows give repeated rows; an empty table gives
none; other columns of the input are left out, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import table, whole_text, with_columns

#: Fixed value: the split pattern that SAFE was made for; texts under any other pattern go to the library whole.
KNOWN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that every version of Unicode puts into the same class.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öА-яぁ-ゖァ-ヺ一-龥가-힣", r"!-&(-/:-@\[-`{-~、。！，：；？"
#: Places that every match ends at, whatever stands around them. Before white space after a visible character: no match runs on from the
#: one into the other, and none that ends in the one looks ahead. And, so that texts without white space are cut too, between letters,
#: digits and marks: they never share a match, but for the apostrophe, which is left out.
SAFE = re.compile(f"(?<=[!-~])(?=[ \n])|(?<=[{_LETTERS}0-9])(?=[{_MARKS}])|(?<=[{_LETTERS}])(?=[0-9])|(?<=[0-9])(?=[{_LETTERS}])")
PIECE_CHARS = 20_000

_ENCODINGS: dict = {}


def load(path: str, pattern: str):
    """The encoding of a rank file, read once per worker."""
    if (path, pattern) not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path, pattern]


def safe_cut(pattern: str):
    """The regex of safe places under a split pattern; None where none are known."""
    return SAFE if pattern == KNOWN else None


def split_safely(text: str, size: int = PIECE_CHARS, safe=SAFE) -> list[str]:
    """Pieces of about ``size`` characters that encode as they would inside the text; a text without a safe place stays whole."""
    out, at = [], 0
    while len(text) - at > size:
        if safe is None or not (cut := safe.search(text, at + size)):
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def encode(text: str | None, enc, safe=SAFE) -> np.ndarray:
    if not text:
        return np.empty(0, dtype="<u4")
    if len(text) <= PIECE_CHARS:
        return np.array(enc.encode_ordinary(text), dtype="<u4")
    return np.concatenate([np.array(enc.encode_ordinary(p), dtype="<u4") for p in split_safely(text, safe=safe)])


def decode(ids: np.ndarray, enc) -> bytes:
    return enc.decode_bytes(ids.tolist())


def encode_documents(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """key, ids binary (little-endian unsigned 32-bit; left out if not ``ids``), n_tokens, ids_sha256, decoded_sha256."""

    def make():
        enc = load(path, pattern)
        safe = safe_cut(pattern)

        def run(b):
            rows = []
            for t in b.column("t").to_pylist():
                x = encode(t, enc, safe)
                raw = x.tobytes()
                rows.append((*([raw] if ids else []), len(x), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decode(x, enc)).hexdigest()))
            return list(zip(*rows, strict=True)) if rows else [[] for _ in range(3 + ids)]

        return run

    added = "ids binary, " * ids + "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return with_columns(docs.select(key, whole_text(text).alias("t")), added, make, drop=("t",))


def op3_bpe_roundtrip(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    out = encode_documents(table(spark, sf_dir, "documents"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, ids=False)
    return out.select(F.col("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")
