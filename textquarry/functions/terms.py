"""Terms of a text as a BM25 encoder has them: lower-cased words without English stop words, stemmed, numbered by hash.

The stemmer follows the published description of the English (Porter2) algorithm; the hash is MurmurHash3 in 32 bits.
"""

from __future__ import annotations

import re
from collections import Counter

# English stop words, longest word that counts, BM25's k, b and mean length.
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers herself it it's its itself they them "
    "their theirs themselves what which who whom this that that'll these those am is are was were be been being have has had having do does did doing a an the and but if or "
    "because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then "
    "once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don don't should should've "
    "now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn "
    "needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't".split()
)
MOST = 40
K, B, AVERAGE = 1.2, 0.75, 256.0

# Fixed values of the stemmer: exceptions, words that stay, suffixes and what they become.
EXCEPTIONS = dict(skis="ski", skies="sky", dying="die", lying="lie", tying="tie", idly="idl", gently="gentl", ugly="ugli", early="earli", only="onli", singly="singl")
STAY = frozenset("sky news howe atlas cosmos bias andes".split())
STAY_AFTER_S = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = dict(tional="tion", enci="ence", anci="ance", abli="able", entli="ent", izer="ize", ization="ize", ational="ate", ation="ate", ator="ate", alism="al", aliti="al", alli="al", fulness="ful",
             ousli="ous", ousness="ous", iveness="ive", iviti="ive", biliti="ble", bli="ble", fulli="ful", lessli="less")
STEP3 = dict(tional="tion", ational="ate", alize="al", icate="ic", iciti="ic", ical="ic", ful="", ness="")
STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()
_VOWELS, _DOUBLES = "aeiouy", ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def _region(w: str, start: int) -> int:
    """Where the region after the first vowel and non-vowel behind ``start`` begins."""
    m = re.search("[aeiouy][^aeiouy]", w[start:])
    return start + m.end() if m else len(w)


def _short_end(w: str) -> bool:
    return bool(re.fullmatch("[aeiouy][^aeiouy]", w) or re.search("[^aeiouy][aeiouy][^aeiouywxY]$", w))


def _longest(w: str, suffixes) -> str:
    return max((s for s in suffixes if w.endswith(s)), key=len, default="")


def stem(word: str) -> str:
    if len(word) < 3:
        return word
    if word in EXCEPTIONS or word in STAY:
        return EXCEPTIONS.get(word, word)
    w = word.lstrip("'") if word.startswith("'") else word
    w = re.sub("(^|[aeiouy])y", r"\1Y", w)  # such a y is no vowel
    low = re.match("gener|commun|arsen", w)
    r1 = low.end() if low else _region(w, 0)
    r2 = _region(w, r1)
    w = re.sub("('s'|'s|')$", "", w)
    # plurals
    end = _longest(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        w = w[:-2]
    elif end in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif end == "s" and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in STAY_AFTER_S:
        return w
    # past and progressive forms
    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and re.search("[aeiouy]", w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLES):
            w = w[:-1]
        elif _short_end(w) and r1 >= len(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    # suffixes of suffixes
    end = _longest(w, (*STEP2, "ogi", "li"))
    if end and len(w) - len(end) >= r1:
        if end == "ogi":
            w = w[:-1] if w.endswith("logi") else w
        elif end == "li":
            w = w[:-2] if w[-3:-2] and w[-3] in "cdeghkmnrt" else w
        else:
            w = w[: -len(end)] + STEP2[end]
    end = _longest(w, (*STEP3, "ative"))
    if end and len(w) - len(end) >= r1:
        if end != "ative":
            w = w[: -len(end)] + STEP3[end]
        elif len(w) - len(end) >= r2:
            w = w[:-5]
    end = _longest(w, (*STEP4, "ion"))
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4] in "st"):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def murmur3(data: bytes, seed: int = 0) -> int:
    """32 bits, unsigned."""
    mask, h = 0xFFFFFFFF, seed
    turn = lambda x, n: (x << n | x >> 32 - n) & mask
    mixed = lambda k: turn(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    whole = len(data) & ~3
    for i in range(0, whole, 4):
        h = (turn(h ^ mixed(int.from_bytes(data[i : i + 4], "little")), 13) * 5 + 0xE6546B64) & mask
    if data[whole:]:
        h ^= mixed(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> shift) * factor & mask
    return h


def term_id(term: str) -> int:
    """Absolute value of the hash as a signed number."""
    h = murmur3(term.encode())
    return abs(h - (1 << 32) if h >= 1 << 31 else h)


def terms(text: str | None) -> list[str]:
    words = re.sub(r"[^\w]", " ", (text or "").lower()).split()
    return [s for w in words if w not in STOP_WORDS and len(w) <= MOST and (s := stem(w))]


def bm25_embedding(text: str | None) -> dict[int, float]:
    """Term id -> tf (k + 1) / (tf + k (1 - b + b n / average)), n the terms of the text."""
    found = terms(text)
    counts = Counter(found)
    return {term_id(t): c * (K + 1) / (c + K * (1 - B + B * len(found) / AVERAGE)) for t, c in counts.items()}
