"""Charsets told by their bytes, and texts that were read in a wrong one."""

import pytest
from textquarry.functions import encodings as E
from textquarry.functions import repair
from textquarry.sources import readers

TEXTS = {
    'ru': 'Привет, мир! Это обычный русский текст, в котором есть несколько предложений. США и РФ» подписали.',
    'pl': 'Zażółć gęślą jaźń. Wczoraj poszedłem do sklepu, żeby kupić chleb i mąkę.',
    'cs': 'Příliš žluťoučký kůň úpěl ďábelské ódy.',
    'fr': 'Élève très appliqué, où est la garçonnière ? Ça va, cœur.',
    'de': 'Größe und Übung: schöne Grüße aus München, weiß.',
    'es': '¿Qué pasó mañana? El niño comió piñas.',
    'ja': 'これは日本語の文章です。今日は天気がいいですね。カタカナも使います。',
    'zh': '这是一个中文句子,我们在这里学习怎么说话。今天天气很好。',
    'tw': '這是一個中文句子,我們在這裡學習怎麼說話。今天天氣很好。',
    'ko': '안녕하세요. 이것은 한국어 문장입니다. 오늘은 날씨가 좋습니다.',
    'el': 'Καλημέρα κόσμε, αυτό είναι ένα κείμενο.',
}
READ = [('ru', 'cp1251'), ('ru', 'koi8_r'), ('ru', 'iso8859_5'), ('ru', 'cp866'), ('pl', 'iso8859_2'), ('pl', 'cp1250'), ('cs', 'iso8859_2'), ('cs', 'cp1250'), ('fr', 'cp1252'), ('de', 'cp1252'), ('es', 'cp1252'), ('ja', 'cp932'), ('ja', 'euc_jp'), ('zh', 'gb18030'), ('tw', 'big5'), ('ko', 'cp949'), ('el', 'cp1253')]


def wrongly(text, charset):
    """UTF-8 read in a charset of one byte; bytes that it leaves open as control codes."""
    out = []
    for b in text.encode():
        try:
            out.append(bytes([b]).decode(charset))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@pytest.mark.parametrize(("lang", "charset"), READ)
def test_charsets_are_told(lang, charset):
    text = TEXTS[lang].encode(charset, "ignore").decode(charset)
    for t in (text, text * 30, f"# {text}\n\n1,2,3\n", text.split(". ")[0]):
        name, sure = E.detect(t.encode(charset))
        assert t.encode(charset).decode(name) == t and sure > 0.3
    assert readers.decode(text.encode(charset))[0] == repair.sanitise(text)


@pytest.mark.parametrize("text", ["Et anè enpa. " * 33, "LE Êeux. " * 9, "é è ü ö ä ß ç É Ä ".replace(" ", "n te ") + "é é é è ü ö ä ç é é", "éan èan éo óa íen êle ça ñar é ó éd ó é ó é ó è è í"])
def test_western_texts_of_one_letter_or_several_languages(text):
    """A letter that comes again and again, or letters of several languages, are no Central European text."""
    for t in (text, text * 30):
        assert t.encode("cp1252").decode(E.detect(t.encode("cp1252"))[0]) == t


def test_odd_bytes():
    for b in (b"", b"abc", b"\x81", b"\x81\x8d", bytes(range(256)), b"\xff" * 1000, b"\x80" * 7, b"a\x00\xe9", bytes(range(128, 256)) * 50):
        name, sure = E.detect(b)
        assert 0 <= sure <= 1 and isinstance(b.decode(name, "replace"), str)
    assert E.detect(b"\xff\xfea\x00") == ("utf-16", 1.0) and E.detect("é".encode()) == ("utf-8", 1.0)


@pytest.mark.parametrize("lang", TEXTS)
def test_wrong_readings_are_undone(lang):
    text = TEXTS[lang]
    assert E.repair_mojibake(text) == text
    for charset in ("latin-1", "cp1252", "cp1251", "cp1250", "mac_roman", "koi8_r"):
        once = wrongly(text, charset)
        assert E.repair_mojibake(once) == text and E.repair_mojibake(wrongly(once, "cp1252")) == text
    mixed = f"{text} | {wrongly(text, 'cp1252')} | {wrongly(TEXTS['ru'], 'cp1251')}"
    assert E.repair_mojibake(mixed) == f"{text} | {text} | {TEXTS['ru']}"


@pytest.mark.parametrize("text", ["", "plain", "«США и РФ» № 5", "Ã", "naïve Ã", "© 2020 ÀÉ", "50 € ± 3", "日本語（かな）", "a“b”c", "É©", "Œuvre", "chauxç. Èèé aique", "Èèê", "ΑΒΓ»", "x\x80y"])
def test_clean_texts_stay(text):
    assert E.repair_mojibake(text) == text


def test_long_texts_are_repaired_in_time():
    text = wrongly(TEXTS["pl"] * 3000, "cp1250") + TEXTS["ru"] * 3000
    assert E.repair_mojibake(text) == TEXTS["pl"] * 3000 + TEXTS["ru"] * 3000


@pytest.mark.parametrize("word", ["Ííí", "Ííñ", "ßüä", "ßüü", "сёла", "тёплый", "берёза", "пёс"])
def test_words_that_are_utf8_in_another_charset_stay(word):
    """Found in the documents: each is valid UTF-8 in Mac Roman, code page 437 or KOI8-R."""
    text = f"{word} los que. {TEXTS['es']} der {word} {TEXTS['de']}"
    for t in (word, text):
        assert E.repair_mojibake(t) == t
        once = wrongly(t, "latin-1")
        assert E.repair_mojibake(once) == t and E.repair_mojibake(wrongly(once, "latin-1")) == t


def test_words_go_along_with_the_others_of_their_charset():
    text = "Мы и они в лесу у реки, а потом к дому."  # one letter alone gives two letters: "Рё", "РІ"
    once = wrongly(text, "cp1251")
    assert E.repair_mojibake(once) == text and E.repair_mojibake(wrongly(once, "cp1252")) == text
