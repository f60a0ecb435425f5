"""Which encoding bytes are in, and texts that were read in a wrong one.

Bytes: marks and strict UTF-8 first. Then each charset decodes them strictly (for those of several bytes a character that rules most out) and is
scored by how likely what it gives is: the mean log-probability of a byte beyond ASCII under a model of the charset's languages. Letters have
probabilities by their rank; pairs count against a reading that breaks words: two scripts in one, a capital after a small letter, a
symbol between letters, long runs of accented letters. Latin alphabets share letters, so what tells them apart is which letters there are: how often
one comes again hardly counts.

Texts: UTF-8 read as a charset of one byte leaves runs that encode back to valid UTF-8. Each charset's runs are decoded anew where that makes
the run, with its neighbours, less bad; the charset that helps most goes first, and this repeats until nothing improves, which undoes
chains of wrong readings. A run that could be a word as it stands ("Ííí", "рё") is left, unless runs that couldn't are read anew more often in its text.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from functools import cache, lru_cache

# Letters and characters of a language, the most frequent first.
RUSSIAN = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё"
WESTERN = ("üäöß", "éèàêçâîôùûëïœæÿ", "óíáéñúü¿¡ªº", "ãçáéíêõóâúàô", "äåöæøéáðíþýúó", "àèìòùé")  # German, French, Spanish, Portuguese, Nordic, Italian
CENTRAL = ("ąęłóśżćńź", "íáéěřčšžýůúťďňóôľĺŕä", "áéíóöőúüű", "ăîâşţ", "čšžćđ")  # Polish, Czech and Slovak, Hungarian, Romanian, South Slavic
GREEK = "αοιετσνηυρπκμλωςγδθχφβξζψάίόέήύώ"
MARKS = "“”‘’–—…•€°©®§«»£„‚·№™½²³±×\xa0"
SIMPLIFIED = "的一是不了人我在有他这中大来上国个到说们为子和你地出道也时年得就那要下以生会自着去之过家学对可她里后小么心多天而能好都然没日于起还发成事只作当想看文无开手十用主行方又如前所本见经头面公同三已老从动两长知民样现分将外但身些与高意进把法此实回二理美点月明其种声全工己话儿者向情部正名定女问力机给等几很业最间新什打便位因重被走电四第门相次东政海口使教西再平真听世气信北少关并内加化由却代军产入先山"
TRADITIONAL = "的一是不了人我在有他這中大來上國個到說們為子和你地出道也時年得就那要下以生會自著去之過家學對可她裡後小麼心多天而能好都然沒日於起還發成事只作當想看文無開手十用主行方又如前所本見經頭面公同三已老從動兩長知民樣現分將外但身些與高意進把法此實回二理美點月明其種聲全工己話兒者向情部正名定女問力機給等幾很業最間新什打便位因重被走電四第門相次東政海口使教西再平真聽世氣信北少關並內加化由卻代軍產入先山"
KOREAN = "이다는을의에가하고지도사인은로리기어한서자아나대시정여스그과보제수전장들라일원부주상해게성면안만요내것있오와조마경동으국구계신모생우소선관위비개방연공문유무저실세중미치되더적말했분"
KANJI = "日一国人年大十二本中長出三時行見月後前生五間上東四今金九入学高円子外八六下来気小七山話女北午百書先名川千水半男西電校語土木聞食車何南万毎白天母火右読友左休父雨会同事自社発者地業方新場員立開手力問代明動京目通言理体田主題意不作用度強公持野以思家世多正安院心界教文元重近考画海売知道集別物使品計死特私始朝運終台広住無真有口少町料工建空急止送切転研足究楽起着店病質待試族銀早映親験英医仕去味写字答夜音注帰古歌買悪図週室歩風紙黒花春赤青館屋色走秋夏習駅洋旅服夕借曜飲肉貸堂鳥飯勉冬昼茶弟牛魚兄犬妹姉漢"


def ranked(letters: str, share: float) -> dict[str, float]:
    """Probabilities that fall off with the rank and come to ``share``."""
    w = [1 / (i + 4) for i in range(len(letters))]
    return {c: share * x / sum(w) for c, x in zip(letters, w, strict=True)}


def _range(first: str, last: str, share: float) -> dict[str, float]:
    n = ord(last) - ord(first) + 1
    return {chr(i): share / n for i in range(ord(first), ord(last) + 1)}


def _cased(letters: str, share: float) -> dict[str, float]:
    return ranked(letters.upper() if len(letters.upper()) == len(letters) else "".join(c.upper() if len(c.upper()) == 1 else c for c in letters), 0.12 * share) | ranked(letters, 0.88 * share)


_CJK_MARKS = dict.fromkeys("、。，．！？：；「」『』（）《》“”‘’…—　・ー％", 0.004)
#: (charset, models of its languages, bytes a character). The first of equals wins. Of what a model doesn't list each character has RARE, less in one byte's.
RARE = 2e-6


@cache
def models() -> tuple[tuple[str, dict[str, float], int], ...]:
    kana = _range("ぁ", "ん", 0.5) | _range("ァ", "ヶ", 0.14) | ranked(KANJI, 0.2) | _CJK_MARKS
    hanzi = {name: ranked(top, 0.6) | _CJK_MARKS for name, top in (("gb18030", SIMPLIFIED), ("big5", TRADITIONAL))}
    hangul = ranked(KOREAN, 0.55) | _CJK_MARKS
    one = [*(("cp1252", x) for x in WESTERN), ("cp1251", RUSSIAN), ("koi8_r", RUSSIAN), *((n, x) for n in ("iso8859_2", "cp1250") for x in CENTRAL), ("iso8859_5", RUSSIAN), ("cp866", RUSSIAN), ("cp1253", GREEK)]
    many = [("cp932", kana), ("euc_jp", kana), ("gb18030", hanzi["gb18030"]), ("big5", hanzi["big5"]), ("cp949", hangul)]
    return (*((n, ranked(MARKS, 0.1) | _cased(x, 0.85), 1) for n, x in one), *((n, m, 2) for n, m in many))


def _common(name: str, c: str) -> float:
    """Probability of a character that the model doesn't list: of the charset's first, common level, or beyond."""
    raw = c.encode(name, "replace")
    if name in ("euc_jp", "gb18030", "cp949") and len(raw) == 2 and raw[1] >= 0xA1:
        low, high, n = {"euc_jp": (0xB0, 0xCF, 2965), "gb18030": (0xB0, 0xD7, 3755), "cp949": (0xB0, 0xC8, 2350)}[name]
    elif name in ("cp932", "big5") and len(raw) == 2:
        low, high, n = {"cp932": (0x88, 0x97, 2965), "big5": (0xA4, 0xC6, 5401)}[name]
    else:
        return RARE
    return 0.3 / n if low <= raw[0] <= high else RARE


# what no word looks like: a letter beyond ASCII next to one of another script, a capital after a small one, a symbol between letters
_SMALL, _LARGE = ("".join(chr(i) for i in range(0xC0, 0x530) if kind(chr(i))) for kind in (str.islower, str.isupper))
_MIXED = re.compile("[a-zA-ZÀ-ɏ](?=[Ͱ-ԯ가-힣])|[Ͱ-ԯ](?=[a-zA-ZÀ-ɏ])|[Ͱ-Ͽ](?=[Ѐ-ԯ])|[Ѐ-ԯ](?=[Ͱ-Ͽ])")
_CAPITAL = re.compile(f"[a-z{_SMALL}](?=[{_LARGE}])|[{_SMALL}](?=[A-Z])|[{_LARGE}](?=[{_LARGE}][a-z{_SMALL}])")
_SYMBOL = re.compile("(?<=[^\\W\\d_])[^\\w\\s\x21-\x7e’‘·»«”“–—…](?=[^\\W\\d_])")
_ACCENTED = re.compile("[À-ɏ]{5,}")
#: What a broken pair counts, charsets of Latin letters, and what e times as many of a letter count more there.
_BROKEN = math.log(0.01)
_LATIN = frozenset(("cp1252", "cp1250", "iso8859_2"))
_AGAIN = 0.1


def plausibility(text: str, name: str, model: dict[str, float], width: int) -> float:
    """Mean log-probability of a byte beyond ASCII of ``text``, which the charset gave."""
    counts = {c: n for c, n in Counter(text).items() if c > "\x7f"}
    total, n, told = 0.0, 0, 0.0
    for c, k in counts.items():
        p = model.get(c)
        if p is None:
            p = 1e-7 if "\x80" <= c < "\xa0" or c >= "" else _common(name, c) if width > 1 else 2e-3 if c.isalpha() else 5e-4
        size = len(c.encode(name, "replace"))
        w = 1 + _AGAIN * math.log(k) if name in _LATIN else k
        total, n, told = total + w * math.log(p), n + k * size, told + w * size
    broken = len(_MIXED.findall(text)) + len(_CAPITAL.findall(text)) + len(_SYMBOL.findall(text)) + sum(map(len, _ACCENTED.findall(text)))
    # Western texts are the commonest: as much as a character and a half
    return (total + (1.5 if name == "cp1252" else 0)) / max(1, told) + broken * _BROKEN / max(1, n)


def detect(content: bytes) -> tuple[str, float]:
    """(encoding, confidence from 0 to 1). Bytes that no charset reads are Latin-1."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(mark):
            return name, 1.0
    for name in ("ascii", "utf-8"):
        try:
            content.decode(name)
            return name, 1.0
        except UnicodeDecodeError:
            pass
    found = []
    if sum(b > 127 for b in content) < 3 and not re.search(b"[A-Za-z]", content):  # too little to tell by
        try:
            content.decode("cp1252")
            return "cp1252", 0.0
        except UnicodeDecodeError:
            return "latin-1", 0.0
    for name, model, width in models():
        try:
            text = content.decode(name)
        except UnicodeDecodeError:
            continue
        found.append((plausibility(text, name, model, width), name))
    if not found:
        return "latin-1", 0.0
    best, name = max(found, key=lambda x: x[0])
    text, top = content.decode(name), {}
    for s, other in found:
        top[other] = max(s, top.get(other, s))
    others = [s for other, s in top.items() if other != name and content.decode(other) != text]
    n = sum(b > 127 for b in content)
    return name, 1 - math.exp(-max(0.0, best - max(others, default=best - 9)) * min(n, 50))


# texts that were read in a wrong charset


#: Charsets of one byte that UTF-8 is taken for.
TAKEN_FOR = ("cp1252", "cp1251", "cp1250", "iso8859_2", "koi8_r", "mac_roman", "cp437")
#: Wrong readings one upon another that are searched.
DEPTH = 3


@cache
def _reading(name: str) -> tuple[dict[str, int], re.Pattern]:
    """The byte of each character of a charset, and runs that are UTF-8 in it. Bytes that the charset leaves open, and the control codes that Latin-1 has
    in the place of others, stand for themselves."""
    byte = {chr(b): b for b in range(0x80, 0xA0)}
    for b in range(0x80, 0x100):
        try:
            byte[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            byte.setdefault(chr(b), b)
    of = lambda low, high: "[" + "".join(re.escape(c) for c, b in byte.items() if low <= b <= high) + "]"
    more = of(0x80, 0xBF)
    return byte, re.compile(f"(?:{of(0xC2, 0xDF)}{more}|{of(0xE0, 0xEF)}{more}{{2}}|{of(0xF0, 0xF4)}{more}{{3}})+")


_SCRIPTS = [("latin", 0x00C0, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("semitic", 0x0590, 0x07BF), ("indic", 0x0900, 0x0DFF), ("cjk", 0x3040, 0x30FF), ("cjk", 0x3400, 0x9FFF), ("cjk", 0xAC00, 0xD7AF), ("cjk", 0xF900, 0xFAFF), ("cjk", 0x20000, 0x2FFFF)]
#: Marks and signs that stand in texts as they are; a sign beside a letter is odd all the same.
_QUIET = frozenset("“”‘’„‚«»–—…•·¿¡ \xa0、。！？，：；（）「」ʼ")


#: Kinds of characters that hardly stand in texts.
_RARE_KINDS = frozenset(("Sk", "Lm", "Mn", "Cn", "Co", "Cf"))


@cache
def _script(c: str) -> str:
    if c.isascii():
        return "latin" if c.isalpha() else ""
    if not c.isalpha():
        return ""
    return next((s for s, low, high in _SCRIPTS if low <= ord(c) <= high), "other")


def badness(text: str) -> float:
    """How little a piece of text looks like text: each character beyond ASCII a little, what breaks words much."""
    bad, last = 0.0, ""
    for i, c in enumerate(text):
        if not c.isascii():
            bad += 0.5
            if "\x80" <= c < "\xa0" or "" <= c < "豈" or c == "�":
                bad += 3
            elif unicodedata.category(c) in _RARE_KINDS:
                bad += 2
            elif not c.isalpha() and c not in _QUIET and _script(last):
                bad += 1
        s, t = _script(last) if last else "", _script(c)
        if s and t and s != t:
            bad += 2
        if last.islower() and c.isupper():
            bad += 1
        if t and last and not last.isascii() and not last.isalpha() and last not in _QUIET:
            bad += 1
        if t == "other":
            bad += 2
        if t == "cjk" and not (s == "cjk" or i + 1 < len(text) and _script(text[i + 1]) == "cjk"):
            bad += 1.5  # one alone
        last = c
    return bad


def _read(piece: str, name: str) -> str:
    """A piece with the runs of UTF-8 in a charset read anew."""
    byte, runs = _reading(name)

    def fixed(m):
        try:
            return bytes(byte[c] for c in m[0]).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]

    return runs.sub(fixed, piece)


@lru_cache(maxsize=10_000)
def _chains(run: str, name: str) -> tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...]:
    """What a run may have been before one to DEPTH wrong readings, the last in the charset ``name``; the shortest chains first. With each the charsets
    and the pieces that were read anew."""
    found = new = [(x, (name,), (run,)) for x in [_read(run, name)] if x != run]
    for _ in range(DEPTH - 1):
        known = {x for x, *_ in found}
        new = [(x, (*path, other), (*steps, piece)) for piece, path, steps in new for other in TAKEN_FOR if (x := _read(piece, other)) not in known]
        found = found + new
    return tuple(found)


@lru_cache(maxsize=10_000)
def _seen(before: str, piece: str, after: str) -> tuple[float, bool]:
    """Badness of a piece between its neighbours, and whether it may be a word: letters of which nothing else counts but that they are beyond ASCII."""
    text = before + piece + after
    bad = badness(text)
    return bad, piece.isalpha() and bad <= 0.5 * sum(not c.isascii() for c in text)


def _again(text: str, name: str) -> tuple[str, float]:
    """The text with those runs of UTF-8 in a charset read anew that become less bad so, and by how much in all. What may be a word is read anew only by
    charsets by which more runs of the text are that can't be one."""
    todo, free, tied = [], Counter(), Counter()
    for m in _reading(name)[1].finditer(text):
        before, after = text[max(0, m.start() - 1) : m.start()], text[m.end() : m.end() + 1]
        was = _seen(before, m[0], after)[0]
        ways: dict[str, tuple[float, list, list]] = {}  # what it was -> its badness, charsets that lead there without a word, and through one
        for x, path, steps in _chains(m[0], name):
            way = ways.setdefault(x, (_seen(before, x, after)[0], [], []))
            way[1 + any(_seen(before, s, after)[1] for s in steps)].append(path)
        best = sorted(((bad, x) for x, (bad, *_) in ways.items() if bad < was), key=lambda x: x[0])
        if best:
            _, some, through = ways[best[0][1]]
            (free if some else tied).update(some or through)
            todo.append((m, was, best, ways))
    out, at, gain = [], 0, 0.0
    for m, was, best, ways in todo:
        for bad, fixed in best:
            _, some, through = ways[fixed]
            if some or any(free[path] > tied[path] for path in through):
                out += [text[at : m.start()], fixed]
                at, gain = m.end(), gain + was - bad
                break
    return "".join([*out, text[at:]]), gain


def repair_mojibake(text: str) -> str:
    """UTF-8 that was read in another charset, once or several times over, is read anew."""
    while not text.isascii():
        fixed, gain = max((_again(text, name) for name in TAKEN_FOR), key=lambda x: x[1])
        if gain <= 0:
            break
        text = fixed
    return text
