"""License scans by ordered signature rules, with DataFrame functions only.

A text is lower-cased (A-Z) and read as words. Each rule is a regex over words that begins with a fixed pair of words, its
keyword, or with a short name that a version follows, in the same word or the next ones (GPL v3, GPLv3, GPL-3.0). One pass over the text looks for keywords; only texts with one are cut into words, and a rule's regex runs only where its
keyword stands. At one place the rule of highest priority that matches wins, then the longest; a detection that lies inside
another one is suppressed. Rules are listed by family and form, some hundreds in all.

Null and empty texts have no words, no places, empty labels and score 0. Repeated rows are kept. Other columns are left out.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import table, whole_text
from textquarry.llm.native import let

#: What separates words, after lower-casing A-Z.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose every place counts, and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]


@dataclass(frozen=True)
class Rule:
    priority: int
    label: str
    keyword: str
    regex: str
    score: float


#: Families: name in words, short names in words, label.
FAMILIES = [
    ("gnu general public licen[cs]e", ("gnu gpl", "gpl v", "gpl 1", "gpl 2", "gpl 3"), "gpl"),
    ("gnu lesser general public licen[cs]e", ("gnu lgpl", "lgpl v", "lgpl 2", "lgpl 3"), "lgpl"),
    ("gnu library general public licen[cs]e", (), "lgpl"),
    ("gnu affero general public licen[cs]e", ("gnu agpl", "agpl v", "agpl 1", "agpl 3"), "agpl"),
    ("gnu free documentation licen[cs]e", ("gnu fdl", "gfdl v", "gfdl 1"), "gfdl"),
    ("apache software licen[cs]e", ("asl v", "asl 1", "asl 2"), "apache"),
    ("apache licen[cs]e", ("apache v", "apache 2"), "apache"),
    ("mit licen[cs]e", ("mit expat", "expat licen[cs]e"), "mit"),
    ("bsd licen[cs]e", ("bsd 2", "bsd 3", "bsd 4", "new bsd", "simplified bsd", "modified bsd"), "bsd"),
    ("isc licen[cs]e", (), "isc"),
    ("mozilla public licen[cs]e", ("mpl v", "mpl 1", "mpl 2"), "mpl"),
    ("eclipse public licen[cs]e", ("epl v", "epl 1", "epl 2"), "epl"),
    ("common development and distribution licen[cs]e", ("cddl v", "cddl 1"), "cddl"),
    ("common public licen[cs]e", ("cpl 1",), "cpl"),
    ("european union public licen[cs]e", ("eupl v", "eupl 1"), "eupl"),
    ("artistic licen[cs]e", ("artistic 2",), "artistic"),
    ("academic free licen[cs]e", ("afl 3",), "afl"),
    ("open software licen[cs]e", ("osl 3",), "osl"),
    ("boost software licen[cs]e", ("bsl 1",), "boost"),
    ("zlib licen[cs]e", ("zlib libpng",), "zlib"),
    ("python software foundation licen[cs]e", ("psf licen[cs]e",), "psf"),
    ("php licen[cs]e", (), "php"),
    ("ruby licen[cs]e", (), "ruby"),
    ("open data commons open database licen[cs]e", ("odbl v", "odbl 1", "open database licen[cs]e"), "odbl"),
    ("open data commons attribution licen[cs]e", ("odc by",), "odc-by"),
    ("public domain dedication", ("pddl 1",), "pddl"),
    ("open government licen[cs]e", ("ogl v", "ogl 3"), "ogl"),
    ("sil open font licen[cs]e", ("ofl 1", "open font licen[cs]e"), "ofl"),
    ("microsoft public licen[cs]e", ("ms pl",), "ms-pl"),
    ("server side public licen[cs]e", ("sspl v", "sspl 1"), "sspl"),
    ("business source licen[cs]e", ("busl 1",), "busl"),
    ("elastic licen[cs]e", (), "elastic"),
    ("universal permissive licen[cs]e", ("upl 1",), "upl"),
    ("do what the fuck you want to public licen[cs]e", ("wtfpl v", "wtfpl 1", "wtfpl 2"), "wtfpl"),
    ("ibm public licen[cs]e", (), "ipl"),
    ("netscape public licen[cs]e", ("npl 1",), "npl"),
    ("sun public licen[cs]e", (), "spl"),
    ("qt public licen[cs]e", ("qpl 1",), "qpl"),
    ("latex project public licen[cs]e", ("lppl 1",), "lppl"),
    ("zope public licen[cs]e", ("zpl 2",), "zpl"),
]
#: Short names in which a number isn't a version.
COUNTED = ("bsd",)
#: What may follow a short name with its version, label's end, priority, score.
SHORT_FORMS = [
    (r"(?: \d+)?(?: or| and)? (?:any )?later(?: version)?", "-later", 50, 1.0),
    (r"(?: \d+)? only", "-only", 48, 1.0),
    (r"(?: \d+)?", "-versioned", 40, 0.95),
]
#: Forms a family's name takes: what may follow it, priority, score.
FORMS = [
    (r"(?: v(?:ersion)? ?\d+(?: \d+)?| v\d+(?: \d+)?| \d+(?: \d+)?)(?: or| and)? (?:any )?later(?: version)?", "-later", 50, 1.0),
    (r"(?: v(?:ersion)? ?\d+(?: \d+)?| v\d+(?: \d+)?| \d+ \d+| \d+) only", "-only", 48, 1.0),
    (r"(?: v(?:ersion)? \d+(?: \d+)?| v\d+(?: \d+)?| \d+ \d+)", "-versioned", 40, 0.95),
    (r"(?: agreement| terms| text| notice)", "", 32, 0.9),
    ("", "", 30, 0.9),
]
#: Hand-written signatures: first the two words of the keyword, then the rest as a regex over words, label, priority, score.
PHRASES = [
    ("permission is", r"hereby granted free of charge (?:to )?any person obtaining a copy", "mit", 44, 1.0),
    ("permission is", r"hereby granted free of charge", "mit", 43, 0.95),
    ("permission is", r"hereby granted without written agreement", "mit", 42, 0.9),
    ("permission is", r"granted to anyone to use this software for any purpose", "zlib", 44, 1.0),
    ("permission is", r"granted to copy distribute and or modify this document", "gfdl", 44, 1.0),
    ("permission is", r"granted to make and distribute verbatim copies", "verbatim", 40, 0.9),
    ("permission to", r"use copy modify and or distribute this software", "isc", 45, 1.0),
    ("permission to", r"use copy modify and or distribute this", "isc", 44, 0.95),
    ("permission to", r"use copy modify (?:and )?distribute and sell this software", "hpnd", 45, 1.0),
    ("permission to", r"reproduce", "permission", 12, 0.4),
    ("permission notice", r"shall be included in all copies", "mit", 40, 0.9),
    ("permission notice", r"appear in all copies", "isc", 40, 0.9),
    ("redistribution and", r"use in source and binary forms with or without modification", "bsd", 46, 1.0),
    ("redistribution and", r"use in source and binary forms", "bsd", 44, 0.95),
    ("redistributions of", r"source code must retain the above copyright notice", "bsd", 45, 1.0),
    ("redistributions in", r"binary form must reproduce the above copyright notice", "bsd", 45, 1.0),
    ("redistributions of", r"any form whatsoever must retain the following acknowledg(?:e)?ment", "bsd-advertising", 46, 1.0),
    ("neither the", r"names? of .{1,80}? may be used to endorse or promote products", "bsd-3-clause", 47, 1.0),
    ("neither the", r"name of the copyright holder nor the names of its contributors", "bsd-3-clause", 48, 1.0),
    ("advertising materials", r"mentioning features or use of this software", "bsd-4-clause", 48, 1.0),
    ("materials mentioning", r"features or use of this software must display", "bsd-4-clause", 47, 1.0),
    ("licensed under", r"the apache licen[cs]e version 2 0", "apache-2.0", 58, 1.0),
    ("licensed under", r"the apache licen[cs]e", "apache", 56, 1.0),
    ("licensed under", r"the mit licen[cs]e", "mit", 56, 1.0),
    ("licensed under", r"the (?:gnu )?(?:lesser|library) general public licen[cs]e", "lgpl", 57, 1.0),
    ("licensed under", r"the (?:gnu )?affero general public licen[cs]e", "agpl", 57, 1.0),
    ("licensed under", r"the (?:gnu )?general public licen[cs]e", "gpl", 56, 1.0),
    ("licensed under", r"the (?:terms of the )?mozilla public licen[cs]e", "mpl", 56, 1.0),
    ("licensed under", r"the (?:terms of the )?eclipse public licen[cs]e", "epl", 56, 1.0),
    ("licensed under", r"(?:a |the )?creative commons", "cc", 23, 0.9),
    ("licensed under", r"(?:a |the )?(?:modified |simplified |new |\d clause )?bsd", "bsd", 54, 0.95),
    ("licensed under", r"(?:the )?terms", "licensed", 15, 0.5),
    ("licensed to", r"the apache software foundation asf under one", "apache", 58, 1.0),
    ("licensed material", r"under this public licen[cs]e", "cc", 40, 0.9),
    ("apache org", r"licenses licen[cs]e 2 0", "apache-2.0", 57, 1.0),
    ("opensource org", r"licenses mit", "mit", 57, 1.0),
    ("opensource org", r"licenses bsd", "bsd", 57, 1.0),
    ("opensource org", r"licenses isc", "isc", 57, 1.0),
    ("opensource org", r"licenses \w+", "osi-link", 52, 0.8),
    ("gnu org", r"licenses gpl", "gpl", 57, 1.0),
    ("gnu org", r"licenses lgpl", "lgpl", 57, 1.0),
    ("gnu org", r"licenses agpl", "agpl", 57, 1.0),
    ("gnu org", r"licenses fdl", "gfdl", 57, 1.0),
    ("gnu org", r"copyleft", "copyleft", 50, 0.8),
    ("mozilla org", r"mpl", "mpl", 57, 1.0),
    ("eclipse org", r"legal epl", "epl", 57, 1.0),
    ("creativecommons org", r"publicdomain zero", "cc0", 58, 1.0),
    ("creativecommons org", r"publicdomain mark", "public-domain", 58, 1.0),
    ("creativecommons org", r"licenses by nc nd", "cc-by-nc-nd", 59, 1.0),
    ("creativecommons org", r"licenses by nc sa", "cc-by-nc-sa", 59, 1.0),
    ("creativecommons org", r"licenses by nc", "cc-by-nc", 58, 1.0),
    ("creativecommons org", r"licenses by nd", "cc-by-nd", 58, 1.0),
    ("creativecommons org", r"licenses by sa", "cc-by-sa", 58, 1.0),
    ("creativecommons org", r"licenses by", "cc-by", 57, 1.0),
    ("unlicense org", r"", "unlicense", 50, 0.95),
    ("the unlicense", r"", "unlicense", 50, 0.95),
    ("released into", r"the public domain", "public-domain", 44, 0.95),
    ("unencumbered software", r"released into the public domain", "unlicense", 48, 1.0),
    ("anyone is", r"free to copy modify publish use compile sell or distribute", "unlicense", 48, 1.0),
    ("relinquishment in", r"perpetuity of all present and future rights", "unlicense", 46, 0.95),
    ("dedicate any", r"and all copyright interest in the software to the public domain", "unlicense", 48, 1.0),
    ("waives all", r"(?:of )?(?:his or her |their |its )?rights to the work worldwide", "cc0", 46, 0.95),
    ("affirmer hereby", r"overtly fully permanently irrevocably and unconditionally waives", "cc0", 48, 1.0),
    ("public domain", r"dedication", "public-domain", 30, 0.9),
    ("public domain", r"", "public-domain", 22, 0.7),
    ("free software", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library)", "lgpl", 50, 1.0),
    ("free software", r"you can redistribute it and or modify it under the terms of the gnu affero", "agpl", 50, 1.0),
    ("free software", r"you can redistribute it and or modify", "gpl", 46, 0.95),
    ("free software", r"foundation either version \d", "gpl-versioned", 48, 1.0),
    ("free software", r"foundation", "fsf", 20, 0.6),
    ("open source", r"initiative", "osi", 18, 0.5),
    ("redistribute it", r"and or modify it under the terms of", "gpl", 38, 0.85),
    ("either version", r"\d(?: \d)? of the licen[cs]e or (?:at your option )?any later version", "gpl-later", 49, 1.0),
    ("at your", r"option any later version", "later", 36, 0.8),
    ("without even", r"the implied warranty of merchantability", "gpl", 40, 0.9),
    ("received a", r"copy of the gnu (?:lesser|library) general public licen[cs]e", "lgpl", 49, 1.0),
    ("received a", r"copy of the gnu affero general public licen[cs]e", "agpl", 49, 1.0),
    ("received a", r"copy of the gnu general public licen[cs]e", "gpl", 48, 1.0),
    ("temple place", r"suite 330 boston", "fsf", 30, 0.7),
    ("franklin street", r"fifth floor boston", "fsf", 30, 0.7),
    ("source code", r"form is subject to the terms of the mozilla public licen[cs]e", "mpl-2.0", 52, 1.0),
    ("incompatible with", r"secondary licenses", "mpl-2.0", 46, 0.95),
    ("covered software", r"is provided under this licen[cs]e on an as is basis", "mpl-2.0", 48, 1.0),
    ("initial developer", r"of the original code", "mpl-1.1", 46, 0.95),
    ("accompanying materials", r"are made available under the terms of the eclipse", "epl", 50, 1.0),
    ("recipient s", r"exercise of rights under this agreement", "epl", 40, 0.85),
    ("commercial distributors", r"of software may accept certain responsibilities", "epl", 44, 0.95),
    ("larger work", r"by combining (?:the )?covered", "cddl", 42, 0.9),
    ("boost org", r"license 1 0", "boost", 56, 1.0),
    ("boost software", r"license version 1 0", "boost", 56, 1.0),
    ("machine executable", r"object code generated by a source language processor", "boost", 48, 1.0),
    ("altered source", r"versions must be plainly marked as such", "zlib", 48, 1.0),
    ("origin of", r"this software must not be misrepresented", "zlib", 48, 1.0),
    ("must not", r"be misrepresented as being the original software", "zlib", 46, 1.0),
    ("reserved font", r"names?", "ofl", 42, 0.95),
    ("font software", r"is licensed under the sil open font licen[cs]e", "ofl", 52, 1.0),
    ("font software", r"may be (?:sold|bundled|redistributed)", "ofl", 44, 0.95),
    ("standard version", r"of the package", "artistic", 42, 0.9),
    ("copyright holder", r"maintain some semblance of artistic control", "artistic", 48, 1.0),
    ("freely available", r"means that no fee is charged for the item", "artistic", 46, 1.0),
    ("academic free", r"license version 3 0", "afl-3.0", 54, 1.0),
    ("licensed for", r"educational use only", "educational", 30, 0.8),
    ("licensed for", r"non ?commercial use only", "noncommercial", 32, 0.85),
    ("noncommercial use", r"only", "noncommercial", 30, 0.85),
    ("non commercial", r"use only", "noncommercial", 30, 0.85),
    ("non commercial", r"purposes only", "noncommercial", 30, 0.85),
    ("personal use", r"only", "noncommercial", 26, 0.75),
    ("evaluation purposes", r"only", "evaluation", 26, 0.75),
    ("free for", r"(?:non ?commercial|personal|academic) use", "noncommercial", 28, 0.7),
    ("commercial license", r"(?:is )?(?:required|available)", "commercial", 26, 0.75),
    ("proprietary and", r"confidential", "proprietary", 36, 0.95),
    ("confidential and", r"proprietary", "proprietary", 36, 0.95),
    ("trade secret", r"", "proprietary", 18, 0.5),
    ("unauthorized copying", r"of this (?:file|document|work|software)", "proprietary", 38, 0.95),
    ("unauthorized reproduction", r"or distribution", "proprietary", 36, 0.9),
    ("reproduction prohibited", r"", "proprietary", 30, 0.8),
    ("strictly prohibited", r"without (?:the )?(?:prior )?(?:written )?(?:permission|consent)", "proprietary", 34, 0.85),
    ("may not", r"be (?:reproduced|redistributed|republished|copied)(?: in whole or in part)?", "proprietary", 28, 0.75),
    ("not be", r"reproduced or transmitted in any form", "proprietary", 34, 0.9),
    ("no part", r"of this (?:publication|book|work|document) may be reproduced", "proprietary", 40, 0.95),
    ("prior written", r"(?:permission|consent) of the (?:publisher|copyright|author|owner)", "proprietary", 30, 0.8),
    ("reprinted with", r"(?:the )?(?:kind )?permission", "permission", 24, 0.7),
    ("used with", r"(?:the )?(?:kind )?permission", "permission", 20, 0.6),
    ("reproduced with", r"(?:the )?(?:kind )?permission", "permission", 24, 0.7),
    ("courtesy of", r"the (?:author|artist|publisher)", "permission", 14, 0.4),
    ("all rights", r"reserved", "reserved", 20, 0.6),
    ("some rights", r"reserved", "some-rights", 20, 0.6),
    ("no rights", r"reserved", "cc0", 32, 0.9),
    ("rights reserved", r"worldwide", "reserved", 18, 0.6),
    ("tous droits", r"r[ée]serv[ée]s", "reserved", 20, 0.6),
    ("todos los", r"derechos reservados", "reserved", 20, 0.6),
    ("alle rechte", r"vorbehalten", "reserved", 20, 0.6),
    ("derechos reservados", r"", "reserved", 16, 0.5),
    ("copyright c", r"\d{4}", "copyright", 10, 0.5),
    ("copyright notice", r"and this permission notice", "mit", 38, 0.9),
    ("copyrighted material", r"", "copyright", 12, 0.5),
    ("copyleft license", r"", "copyleft", 20, 0.7),
    ("copyleft licence", r"", "copyleft", 20, 0.7),
    ("general public", r"licen[cs]e", "gpl", 25, 0.9),
    ("lesser general", r"public licen[cs]e", "lgpl", 36, 0.95),
    ("affero general", r"public licen[cs]e", "agpl", 36, 0.95),
    ("creative commons", r"zero|0|cc0", "cc0", 46, 1.0),
    ("cc0 1", r"0", "cc0", 46, 1.0),
    ("cc0 license", r"", "cc0", 40, 0.95),
    ("cc0 licence", r"", "cc0", 40, 0.95),
    ("spdx license", r"identifier [\w]+(?: \d+){0,9}(?: only| or later)?", "spdx", 60, 1.0),
    ("spdx filecopyrighttext", r"", "spdx", 50, 0.9),
    ("without warranty", r"of any kind|express or implied", "warranty", 12, 0.5),
    ("without warranties", r"or conditions of any kind", "apache", 34, 0.8),
    ("provided as", r"is without (?:any )?(?:express or implied )?warrant(?:y|ies)", "warranty", 14, 0.5),
    ("merchantability or", r"fitness for a particular purpose", "warranty", 14, 0.5),
    ("merchantability fitness", r"for a particular purpose and noninfringement", "mit", 36, 0.85),
    ("noninfringement in", r"no event shall the authors or copyright holders", "mit", 38, 0.9),
    ("regents of", r"the university of california", "bsd", 34, 0.85),
    ("terms of", r"service|use", "terms", 8, 0.3),
    ("end user", r"licen[cs]e agreement", "eula", 30, 0.9),
    ("software license", r"agreement", "eula", 24, 0.8),
    ("license agreement", r"between you and", "eula", 28, 0.85),
    ("dual licensed", r"", "dual", 14, 0.5),
    ("dual license", r"", "dual", 14, 0.5),
    ("multi licensed", r"", "dual", 14, 0.5),
    ("do not", r"distribute|redistribute|copy or distribute", "proprietary", 16, 0.5),
    ("not for", r"redistribution|resale|distribution", "proprietary", 20, 0.6),
    ("open government", r"licen[cs]e v3 0", "ogl-3.0", 56, 1.0),
    ("crown copyright", r"", "crown", 20, 0.7),
    ("contains public", r"sector information licensed under", "ogl", 50, 1.0),
    ("open database", r"licen[cs]e odbl", "odbl", 50, 1.0),
    ("openstreetmap contributors", r"", "odbl", 30, 0.8),
    ("community data", r"licen[cs]e agreement", "cdla", 44, 1.0),
    ("etalab open", r"licen[cs]e", "etalab", 44, 1.0),
    ("licence ouverte", r"", "etalab", 40, 0.95),
    ("data licence", r"germany", "dl-de", 44, 1.0),
    ("european union", r"public licen[cs]e", "eupl", 36, 0.95),
    ("responsible ai", r"licen[cs]e", "rail", 40, 0.95),
    ("openrail m", r"", "rail", 40, 0.95),
    ("community license", r"agreement", "community", 30, 0.8),
    ("commons clause", r"licen[cs]e condition", "commons-clause", 46, 1.0),
    ("commons clause", r"", "commons-clause", 30, 0.8),
    ("polyform noncommercial", r"licen[cs]e", "polyform", 44, 1.0),
    ("polyform shield", r"licen[cs]e", "polyform", 44, 1.0),
    ("beerware license", r"", "beerware", 40, 0.95),
    ("buy me", r"a beer in return", "beerware", 40, 0.95),
    ("share alike", r"", "sharealike", 14, 0.5),
    ("share and", r"share alike", "sharealike", 18, 0.5),
]
CC_PARTS = ["by nc nd", "by nc sa", "by nc", "by nd", "by sa", "by"]
CC_NAMES = {"by": "attribution", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?", "sa": "share ?alike"}


def short_names() -> dict[str, tuple[str, str]]:
    """Short name -> label and the regex of the name with its version: any number after a v if a form ``name v`` is listed, the
    listed numbers also without one."""
    out = {}
    for _, shorts, label in FAMILIES:
        found: dict[str, list[str]] = {}
        for name, at in (x.split() for x in shorts if re.fullmatch(r"\w+ (?:v|\d)", x)):
            if name not in COUNTED:
                found.setdefault(name, []).append(at)
        for name, at in found.items():
            listed = "|".join(x for x in at if x != "v")
            marked = r"\d+" if "v" in at else f"(?:{listed})"
            out[name] = (label, f"{name}(?: ?v(?:ersion)? ?{marked}" + (f"| ?(?:{listed}))" if listed else ")"))
    return out


def most_words(regex: str) -> int:
    """Words of the longest text that a rule's regex matches."""

    def spaces(tree) -> int:
        n = 0
        for op, arg in tree:
            name = str(op)
            if name == "LITERAL":
                n += arg == ord(" ")
            elif name == "SUBPATTERN":
                n += spaces(arg[-1])
            elif name == "BRANCH":
                n += max(map(spaces, arg[1]))
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                n += spaces(arg[2]) and int(arg[1]) * spaces(arg[2])
        return n

    return 1 + spaces(re._parser.parse(regex))


def rules() -> list[Rule]:
    """All rules, in order of priority."""
    out = [Rule(p, label, key, key + (f" (?:{rest})" if rest else ""), s) for key, rest, label, p, s in PHRASES]
    for name, shorts, label in FAMILIES:
        for written in (name, *shorts):
            # the keyword is the first two words, each spelling of "license" on its own
            for spelt in {written.replace("licen[cs]e", x) for x in ("license", "licence")} if "licen[cs]e" in " ".join(written.split()[:2]) else {written}:
                key = " ".join(spelt.split()[:2])
                out += [Rule(p + 2 * (written == name), label + tail, key, spelt + form, s) for form, tail, p, s in FORMS]
    for name, (label, versioned) in short_names().items():
        out += [Rule(p, label + tail, name, versioned + form, s) for form, tail, p, s in SHORT_FORMS]
    for parts in CC_PARTS:
        names = " ".join(CC_NAMES[x] for x in parts.split())
        for port in (r"(?: v| version)? \d \d(?: (?:international|unported|generic|igo))?", r"(?: international)?"):
            more = 2 * ("1" not in port and "d d" in port) + len(parts.split())
            out.append(Rule(44 + more, "cc-" + parts.replace(" ", "-"), "cc by", f"cc {parts}{port}", 1.0))
            out.append(Rule(44 + more, "cc-" + parts.replace(" ", "-"), "creative commons", f"creative commons {names}{port}", 1.0))
    out.append(Rule(24, "cc", "creative commons", "creative commons(?: licen[cs]e)?", 0.8))
    return sorted(out, key=lambda r: (-r.priority, r.label, r.regex))


def plain_words(text: Column) -> Column:
    """The words of a text, parted by one space, with one before the first and after the last; a single space if there are none."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.concat(F.lit(" "), lowered, F.lit(" ")), NOT_WORD, " ")


def branches(keys: list[str]) -> str:
    """One regex for any of the strings, in which common beginnings stand once."""
    heads: dict[str, list[str]] = {}
    for k in sorted(set(keys)):
        heads.setdefault(k[:1], []).append(k[1:])
    parts = []
    for head, rests in heads.items():
        while head and len({r[:1] for r in rests}) == 1 and rests[0]:
            head, rests = head + rests[0][:1], [r[1:] for r in rests]
        parts.append(re.escape(head) + (branches(rests) if any(rests) else ""))
    return f"(?:{'|'.join(p for p in parts if p)})" + ("?" if "" in heads else "") if len(parts) > 1 else parts[0]


def gate() -> str:
    """One regex that finds any keyword or base phrase."""
    plain = ({r.keyword for r in rules()} | {p for p, _ in BASE}) - set(short_names())
    keys = [branches([k for k in plain if re.fullmatch(r"[\w ]+", k)]), *sorted(k for k in plain if not re.fullmatch(r"[\w ]+", k))]
    keys += [versioned for _, versioned in short_names().values()]
    first = "".join(sorted({k[0] for k in plain} | {k[0] for k in short_names()}))
    return f" (?=[{first}])(?:{'|'.join(keys)})(?= )"


RULE = "struct<priority:int,label:string,regex:string,score:double>"


def detections(norm: Column) -> Column:
    """array<struct<at, upto, priority, label, score>> in order of place, suppressed ones left out."""
    every = rules()
    reach = max(most_words(r.regex) for r in every)  # the longest rule, in words
    keys = sorted({r.keyword for r in every})
    pairs, short = [k for k in keys if " " in k], f"^({'|'.join(short_names())})(?:v(?:ersion)?)?\\d*$"
    # keyword -> its rules, as a constant map: what runs at a place is a handful of regexes
    by_key = {k: [{"priority": r.priority, "label": r.label, "regex": f"^(?:{r.regex})(?= |$)", "score": r.score} for r in every if r.keyword == k] for k in keys}
    table_ = F.from_json(F.lit(json.dumps(by_key)), f"map<string,array<{RULE}>>")
    words = F.split(F.trim(norm), " ")

    def found(w: Column) -> Column:
        pair = lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1))
        places = F.filter(F.transform(w, lambda x, i: F.when(pair(i).isin(pairs) | x.rlike(short), i)), lambda i: i.isNotNull())

        def rules_at(i: Column) -> Column:
            named = lambda k: F.coalesce(F.element_at(table_, k), F.from_json(F.lit("[]"), f"array<{RULE}>"))
            return F.concat(named(pair(i)), named(F.regexp_extract(F.get(w, i), short, 1)))

        def at(i: Column) -> Column:
            context = F.array_join(F.slice(w, i + 1, reach), " ")
            tried = let(context, lambda c: F.transform(rules_at(i), lambda r: F.struct(r["priority"].alias("priority"), F.call_function("regexp_extract", c, r["regex"], F.lit(0)).alias("match"), r["label"].alias("label"), r["score"].alias("score"))))
            hits = F.filter(tried, lambda r: r["match"] != "")
            best = F.array_max(F.transform(hits, lambda r: F.struct(r["priority"].alias("priority"), F.length(r["match"]).alias("chars"), r["label"].alias("label"), r["score"].alias("score"), F.size(F.split(r["match"], " ")).alias("n"))))
            return let(best, lambda b: F.when(b.isNotNull(), F.struct(i.alias("at"), (i + b["n"]).alias("upto"), b["priority"].alias("priority"), b["label"].alias("label"), b["score"].alias("score"))))

        raw = F.filter(F.transform(places, at), lambda d: d.isNotNull())
        # no rule is longer than ``reach`` words, so what holds a detection begins at most so many places earlier
        return let(raw, lambda ds: F.filter(ds, lambda d, k: ~F.exists(F.slice(ds, F.greatest(k - reach + 1, F.lit(1)), F.least(k, F.lit(reach))), lambda e: (e["at"] < d["at"]) & (e["upto"] >= d["upto"]))))

    return let(words, found)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score, detections."""
    norm = plain_words(whole_text(text))
    rows = docs.select(F.col(key), norm.alias("w"))
    count = lambda x: (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))).cast("long")
    base = "(?<= )(?:" + "|".join(p for p, _ in BASE) + ")(?= )"
    hit = F.col("w").rlike(gate())

    def places(x: Column) -> Column:
        parts, names = F.split(x, base), F.regexp_extract_all(x, F.lit(base), F.lit(0))

        def read(s: Column) -> Column:
            last = F.element_at(s["names"], -1)
            return F.struct(
                F.size(s["names"]).cast("long").alias("n"),
                F.when(F.size(s["names"]) > 0, count(F.element_at(s["parts"], 1)) - 1).alias("first"),
                F.when(F.size(s["names"]) > 0, count(x) - 1 - (count(F.element_at(s["parts"], -1)) - 1) - (count(last) + 1)).alias("last"),
                F.array_distinct(s["names"]).alias("names"),
            )

        return let(F.struct(parts.alias("parts"), names.alias("names")), read)

    rows = rows.withColumn("x", F.when(hit, F.struct(places(F.col("w")).alias("base"), detections(F.col("w")).alias("found"))))
    label = F.create_map(*[F.lit(y) for pair in BASE for y in pair])
    base_labels = F.coalesce(F.array_sort(F.transform(F.col("x.base.names"), lambda p: F.element_at(label, p))), F.array().cast("array<string>"))
    found = F.coalesce(F.transform(F.col("x.found"), lambda d: d["label"]), F.array().cast("array<string>"))
    return rows.select(
        key,
        F.greatest(count(F.col("w")) - 1, F.lit(0)).alias("n_words"),
        F.coalesce(F.col("x.base.n"), F.lit(0)).alias("n_base"),
        F.col("x.base.first").alias("first_word"),
        F.col("x.base.last").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, found))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform(F.col("x.found"), lambda d: d["score"])), F.lit(0.0)).alias("score"),
        F.col("x.found").alias("detections"),
    )


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("detections")
