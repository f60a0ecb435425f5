"""Encoding by the tokenizers library, with each word encoded once per worker, as far as a bounded memory goes.

A text is cut only before white space that follows something else, and before an ASCII mark, but for the apostrophe, that follows a
letter from a to z. The split patterns of the supported files never join characters across such a place, so the ids of the pieces, set
side by side, are those of the whole text. Texts with other white space than blanks, tabs and line breaks, or with the
string of a special token, go to the library whole.

Pieces are found and numbered as arrays over a group of texts; only those not met before reach Python one by one.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

#: White space that the libraries and Python read differently, or that Unicode composition may touch.
ODD_SPACE = re.compile("[^\\S \n\t\r]|[\x1c-\x1f\x85᠎﻿]")

#: Texts are read in groups of about so many characters, and pieces in slices of so many.
GROUP_CHARS, SLICE = 4_000_000, 400_000
#: New pieces go to the library so many at a time: what it builds for a call is some hundreds of bytes a token.
LEARN = 16384


def _bytes_in(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_SPACE = _bytes_in(b" \n\t\r")
_LETTER = _bytes_in(bytes([*range(65, 91), *range(97, 123)]))
_STOP = _bytes_in(bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"))
#: First bytes of odd white space and of special tokens; only texts with one of them are searched.
_SUSPECT = _bytes_in(bytes([0x0B, 0x0C, *range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3, 0xEF, ord("<")]))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_LOADED: dict[tuple[str, bool, int], "WordEncoder"] = {}


class Pool:
    """Ids of known pieces, side by side."""

    def __init__(self, dtype):
        self.ids, self.used = np.empty(1 << 16, dtype=dtype), 0
        self.start, self.size, self.known = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64), 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Appends pieces of ``sizes`` ids each."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.known + len(sizes) > len(self.start):
            self.start, self.size = (np.concatenate([a, np.empty_like(a)]) for a in (self.start, self.size))
        at = slice(self.known, self.known + len(sizes))
        self.start[at], self.size[at] = self.used + np.cumsum(sizes) - sizes, sizes
        self.ids[self.used : self.used + len(ids)] = ids
        self.used, self.known = self.used + len(ids), at.stop

    def spell(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces in order, and where each piece's end."""
        sizes = self.size[numbers]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[numbers] - ends + sizes, sizes)
        return self.ids[at], ends


class WordEncoder:
    """Ids as little-endian bytes. ``spaced``: a word's leading space belongs to it (byte-level files); else case and white
    space don't count."""

    #: Distinct pieces held per worker, also between tasks (some 200 bytes each). Before a slice would pass it, all are forgotten but those
    #: of the slice; as a slice has fewer pieces, no more are ever held. Their ids count too, as a piece may be long.
    HELD, HELD_IDS = 600_000, 8_000_000

    def __init__(self, path: str, spaced: bool, width: int = 4):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.spaced, self.dtype = spaced, np.dtype(f"<u{width}")
        self.special = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([ODD_SPACE.pattern, *self.special]))
        self.suspect = _SUSPECT | _bytes_in(bytes(t.content.encode()[0] for t in self.tok.get_added_tokens_decoder().values()))
        self.simple = re.compile("[ \n][A-Za-zÀ-ÖØ-öø-ÿ]+" if spaced else "[ \n][a-zß-öø-ÿ]+").fullmatch
        vocab = self.tok.get_vocab()
        self.edge = np.zeros(max(vocab.values()) + 1, dtype=bool)  # ids that begin (spaced) or end a word
        self.edge[[i for t, i in vocab.items() if (t.startswith(("Ġ", "Ċ")) if spaced else t.endswith("</w>"))]] = True
        self.forget()

    def forget(self) -> None:
        self.numbers, self.pool = {}, Pool(self.dtype)

    def release(self) -> None:
        """Hands free memory back at the end of a task, as idle workers go on living; known pieces stay for the next task."""
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    def keep(self, pieces: list[bytes]) -> None:
        """Forgets all but ``pieces``, which are known."""
        at = np.fromiter(map(self.numbers.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        ids, sizes = self.pool.spell(at)[0], self.pool.size[at]
        self.forget()
        self.pool.add(ids, sizes)
        self.numbers.update(zip(pieces, range(len(pieces)), strict=True))

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.dtype) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: list[bytes]) -> None:
        for at in range(0, len(pieces), LEARN):
            self._learn(pieces[at : at + LEARN])

    def _learn(self, pieces: list[bytes]) -> None:
        """Encodes new pieces: plain words side by side in one text, whose ids part where a word begins or ends; others each."""
        words = [p.decode() for p in pieces]
        plain = list(map(self.simple, words))
        kept = [w for w, p in zip(words, plain, strict=True) if p]
        ids = self.whole(["".join(kept)])[0]
        cuts = np.flatnonzero(self.edge[ids]) + (0 if self.spaced else 1)
        if len(cuts) != len(kept):
            plain, kept = [None] * len(words), []
        else:
            self.pool.add(ids, np.diff(cuts, append=len(ids)) if self.spaced else np.diff(cuts, prepend=0))
        others = [w for w, p in zip(words, plain, strict=True) if not p]
        ids = self.whole(others)
        self.pool.add(np.concatenate(ids) if ids else np.empty(0, self.dtype), np.array(list(map(len, ids)), dtype=np.int64))
        order = [p for p, q in zip(pieces, plain, strict=True) if q] + [p for p, q in zip(pieces, plain, strict=True) if not q]
        self.numbers.update(zip(order, range(len(self.numbers), self.pool.known), strict=True))

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text as bytes."""
        out, group, size = [], [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size > GROUP_CHARS:
                out += self._group(group)
                group, size = [], 0
        return out + self._group(group)

    def _group(self, texts: list[str]) -> list[bytes]:
        raw = [t.encode() for t in texts]
        ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        seen = np.unique(np.searchsorted(ends, np.flatnonzero(self.suspect[data]), side="right"))
        odd = [i for i in seen.tolist() if self.odd.search(texts[i])]
        if odd:
            out: list = [None] * len(texts)
            for i, ids in zip(odd, self.whole([texts[i] for i in odd]), strict=True):
                out[i] = ids.tobytes()
            even = [i for i, o in enumerate(out) if o is None]
            raw = [raw[i] for i in even]
            for i, ids in zip(even, self._even(b"".join(raw), np.cumsum([len(r) for r in raw], dtype=np.int64)), strict=True):
                out[i] = ids
            return out
        return self._even(data, ends)

    def _even(self, data, ends: np.ndarray) -> list[bytes]:
        data = np.frombuffer(data, dtype=np.uint8)
        if not len(data):
            return [b""] * len(ends)
        if not self.spaced:
            data = _LOWER[data]
        space = _SPACE[data]
        start = np.empty(len(data), dtype=bool)
        start[0] = True
        start[1:] = (space[1:] & ~space[:-1]) | (_STOP[data[1:]] & _LETTER[data[:-1]])
        start[ends[ends < len(data)]] = True
        at = np.append(np.flatnonzero(start), len(data)).astype(np.int64)
        ids, upto = [], np.zeros(len(at), dtype=np.int64)
        for low in range(0, len(at) - 1, SLICE):
            here = at[low : low + SLICE + 1]
            held, ends_at = self._spell(data[here[0] : here[-1]], here - here[0])
            upto[low + 1 : low + len(here)] = ends_at + upto[low]
            ids.append(held)
        # a text ends where its last piece does
        stops = (upto[np.searchsorted(at, ends)] * self.dtype.itemsize).tolist()
        raw = b"".join(x.tobytes() for x in ids)
        return [raw[i:j] for i, j in zip([0, *stops[:-1]], stops, strict=True)]

    def _spell(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces that ``at`` parts, side by side, and where each piece's end."""
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        found = list(map(self.numbers.get, distinct))
        new = [p for p, n in zip(distinct, found, strict=True) if n is None]
        if new:
            if len(self.numbers) + len(new) > self.HELD or self.pool.used > self.HELD_IDS:
                self.keep([p for p, n in zip(distinct, found, strict=True) if n is not None])
                found = list(map(self.numbers.get, distinct))
            self.learn(new)
            number = self.numbers.__getitem__
            found = [number(p) if n is None else n for p, n in zip(distinct, found, strict=True)]
        return self.pool.spell(np.array(found, dtype=np.int64)[pieces.indices.to_numpy()])


def encoder(path: str, spaced: bool, width: int = 4) -> WordEncoder:
    """One per worker process and file."""
    key = (path, spaced, width)
    if key not in _LOADED:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _LOADED[key] = WordEncoder(path, spaced, width)
    return _LOADED[key]
