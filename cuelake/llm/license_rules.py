"""Hand-written license signatures: label, priority, keyword that gates the rule, and pattern over normalised words.

Texts are words in lower case (A-Z), each followed by one space, with a space in front; patterns match whole words of that form.
Priorities: 4 an identifier tag, 3 a grant or full title with version, 2 a title or well-known sentence, 1 a family name.
A detection inside one of higher priority, or inside a longer one of its own priority, is suppressed.
"""

from __future__ import annotations

TAG, GRANT, TITLE, FAMILY = 4, 3, 2, 1

#: The base phrases and their labels.
BASE_PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Label, identifier words after a tag, and the words of the title as a pattern.
LICENSES = (
    ("mit", "mit", "mit"),
    ("mit-0", "mit 0", "mit no attribution"),
    ("apache-1.1", "apache 1 1", "apache (?:software )?license version 1 1"),
    ("apache-2", "apache 2 0", "apache (?:software )?license(?: version)? 2(?: 0)?"),
    ("bsd-2-clause", "bsd 2 clause", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"),
    ("bsd-3-clause", "bsd 3 clause", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-4-clause", "bsd 4 clause", "(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("0bsd", "0bsd", "(?:zero clause bsd|0 clause bsd|bsd zero clause)"),
    ("isc", "isc", "isc"),
    ("zlib", "zlib", "zlib(?: libpng)?"),
    ("libpng", "libpng", "libpng"),
    ("bsl-1.0", "bsl 1 0", "boost software(?: license)?(?: version)?(?: 1 0)?"),
    ("gpl-1", "gpl 1 0", "(?:gnu )?(?:general public license|gpl) (?:version |v)?1(?: 0)?"),
    ("gpl-2", "gpl 2 0", "(?:gnu )?(?:general public license|gpl) (?:version |v)?2(?: 0)?"),
    ("gpl-3", "gpl 3 0", "(?:gnu )?(?:general public license|gpl) (?:version |v)?3(?: 0)?"),
    ("lgpl-2", "lgpl 2 0", "(?:gnu )?(?:library general public license|lgpl) (?:version |v)?2(?: 0)?"),
    ("lgpl-2.1", "lgpl 2 1", "(?:gnu )?(?:lesser general public license|lgpl) (?:version |v)?2 1"),
    ("lgpl-3", "lgpl 3 0", "(?:gnu )?(?:lesser general public license|lgpl) (?:version |v)?3(?: 0)?"),
    ("agpl-3", "agpl 3 0", "(?:gnu )?(?:affero general public license|agpl) (?:version |v)?3(?: 0)?"),
    ("gfdl-1.2", "gfdl 1 2", "(?:gnu )?free documentation license version 1 2"),
    ("gfdl-1.3", "gfdl 1 3", "(?:gnu )?free documentation license version 1 3"),
    ("mpl-1.1", "mpl 1 1", "mozilla public license(?: version)? 1 1"),
    ("mpl-2", "mpl 2 0", "mozilla public license(?: version| v)? 2(?: 0)?"),
    ("epl-1", "epl 1 0", "eclipse public license(?: version| v)? 1(?: 0)?"),
    ("epl-2", "epl 2 0", "eclipse public license(?: version| v)? 2(?: 0)?"),
    ("cddl-1", "cddl 1 0", "common development and distribution license(?: version)?(?: 1 0)?"),
    ("cddl-1.1", "cddl 1 1", "common development and distribution license version 1 1"),
    ("cpl-1", "cpl 1 0", "common public license(?: version)? 1(?: 0)?"),
    ("ipl-1", "ipl 1 0", "ibm public license(?: version)? 1(?: 0)?"),
    ("artistic-1", "artistic 1 0", "artistic license(?: version)? 1(?: 0)?"),
    ("artistic-2", "artistic 2 0", "artistic license(?: version)? 2(?: 0)?"),
    ("eupl-1.1", "eupl 1 1", "european union public licen[cs]e(?: version| v)? 1 1"),
    ("eupl-1.2", "eupl 1 2", "european union public licen[cs]e(?: version| v)? 1 2"),
    ("ms-pl", "ms pl", "microsoft public"),
    ("ms-rl", "ms rl", "microsoft reciprocal"),
    ("osl-3", "osl 3 0", "open software license(?: version)? 3(?: 0)?"),
    ("afl-3", "afl 3 0", "academic free license(?: version)? 3(?: 0)?"),
    ("ecl-2", "ecl 2 0", "educational community license(?: version)? 2(?: 0)?"),
    ("upl-1", "upl 1 0", "universal permissive license(?: version)?(?: 1 0)?"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "do what the fuck you want to public"),
    ("cc0", "cc0 1 0", "(?:cc0|creative commons zero|cc zero)(?: 1 0)?(?: universal)?"),
    ("cc-by", "cc by (?:2 0|2 5|3 0|4 0)", "(?:creative commons attribution|cc by)(?: (?:2 0|2 5|3 0|4 0))?(?: international| unported)?"),
    ("cc-by-sa", "cc by sa (?:2 0|2 5|3 0|4 0)", "(?:creative commons attribution share ?alike|cc by sa)(?: (?:2 0|2 5|3 0|4 0))?(?: international| unported)?"),
    ("cc-by-nd", "cc by nd (?:2 0|2 5|3 0|4 0)", "(?:creative commons attribution no ?deriv(?:ative)?s|cc by nd)(?: (?:2 0|2 5|3 0|4 0))?(?: international| unported)?"),
    ("cc-by-nc", "cc by nc (?:2 0|2 5|3 0|4 0)", "(?:creative commons attribution non ?commercial|cc by nc)(?: (?:2 0|2 5|3 0|4 0))?(?: international| unported)?"),
    ("cc-by-nc-sa", "cc by nc sa (?:2 0|2 5|3 0|4 0)", "(?:creative commons attribution non ?commercial share ?alike|cc by nc sa)(?: (?:2 0|2 5|3 0|4 0))?(?: international| unported)?"),
    ("cc-by-nc-nd", "cc by nc nd (?:2 0|2 5|3 0|4 0)", "(?:creative commons attribution non ?commercial no ?deriv(?:ative)?s|cc by nc nd)(?: (?:2 0|2 5|3 0|4 0))?(?: international| unported)?"),
    ("odbl-1", "odbl 1 0", "open (?:data commons open )?database license"),
    ("odc-by-1", "odc by 1 0", "open data commons attribution"),
    ("pddl-1", "pddl 1 0", "(?:open data commons )?public domain dedication and license"),
    ("ofl-1.1", "ofl 1 1", "sil open font license(?: version)?(?: 1 1)?"),
    ("postgresql", "postgresql", "postgresql"),
    ("python-2", "python 2 0", "python software foundation license(?: version)?(?: 2)?"),
    ("php-3.01", "php 3 01", "php license(?: version)?(?: 3 01)?"),
    ("ruby", "ruby", "ruby s"),
    ("openssl", "openssl", "openssl"),
    ("curl", "curl", "curl"),
    ("ncsa", "ncsa", "(?:university of illinois ncsa open source|ncsa open source)"),
    ("w3c", "w3c", "w3c software(?: notice and)?"),
    ("vim", "vim", "vim"),
    ("zpl-2.1", "zpl 2 1", "zope public license(?: version)?(?: 2 1)?"),
    ("llama-2", "llama 2", "llama 2 community"),
    ("llama-3", "llama 3", "(?:meta )?llama 3(?: 1| 2)? community"),
    ("openrail", "openrail", "(?:bigscience |creativeml )?open ?rail(?: m)?"),
    ("bsl-1.1", "busl 1 1", "business source license(?: version)?(?: 1 1)?"),
    ("sspl-1", "sspl 1 0", "server side public license(?: version)?(?: 1)?"),
    ("elastic-2", "elastic 2 0", "elastic license(?: version)?(?: 2 0)?"),
)

#: Sentences that give a license away without its name, and family names without a version.
SENTENCES = (
    ("mit", TITLE, "permission", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", TITLE, "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", TITLE, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", TITLE, "endorse", "neither the name of .{1,80}? nor the names of its contributors may be used to endorse"),
    ("bsd-4-clause", TITLE, "advertising", "all advertising materials mentioning features or use of this software must display"),
    ("zlib", TITLE, "implied", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("unlicense", TITLE, "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("public-domain", TITLE, "domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", FAMILY, "domain", "public domain"),
    ("gpl-2-or-later", GRANT, "gnu", "gnu general public license .{0,80}?either version 2 of the license or (?:at your option )?any later version"),
    ("gpl-3-or-later", GRANT, "gnu", "gnu general public license .{0,80}?either version 3 of the license or (?:at your option )?any later version"),
    ("lgpl-2.1-or-later", GRANT, "gnu", "gnu lesser general public license .{0,80}?either version 2 1 of the license or (?:at your option )?any later version"),
    ("agpl-3-or-later", GRANT, "gnu", "gnu affero general public license .{0,80}?either version 3 of the license or (?:at your option )?any later version"),
    ("all-rights-reserved", TITLE, "rights", "all rights reserved"),
    ("proprietary", TITLE, "proprietary", "(?:proprietary and confidential|confidential and proprietary|proprietary license)"),
    ("copyleft", FAMILY, "copyleft", "copyleft"),
    ("gpl", FAMILY, "gpl", "gpl"),
    ("gpl", FAMILY, "gnu", "gnu general public license"),
    ("lgpl", FAMILY, "lgpl", "lgpl"),
    ("lgpl", FAMILY, "gnu", "gnu (?:lesser|library) general public license"),
    ("agpl", FAMILY, "agpl", "agpl"),
    ("agpl", FAMILY, "gnu", "gnu affero general public license"),
    ("apache", FAMILY, "apache", "apache (?:software )?license"),
    ("bsd", FAMILY, "bsd", "bsd (?:style )?license"),
    ("mit", FAMILY, "mit", "(?:the )?(?:mit|expat|x11) (?:style )?license"),
    ("mit", FAMILY, "expat", "(?:the )?(?:mit|expat|x11) (?:style )?license"),
    ("mit", FAMILY, "x11", "(?:the )?(?:mit|expat|x11) (?:style )?license"),
    ("mpl", FAMILY, "mozilla", "mozilla public license"),
    ("epl", FAMILY, "eclipse", "eclipse public license"),
    ("eupl", FAMILY, "european", "european union public licen[cs]e"),
    ("artistic", FAMILY, "artistic", "artistic license"),
    ("creative-commons", FAMILY, "creative", "creative commons(?: license)?"),
    ("gfdl", FAMILY, "gnu", "gnu free documentation license"),
)

#: Ways to grant a license by its title; %s is the title.
GRANTS = (
    "(?:is |are )?(?:licensed|released|distributed|available|published|made available|dual licensed) under (?:the )?(?:terms of )?(?:the )?%s(?: licen[cs]e)?",
    "(?:subject to|governed by|covered by) (?:the )?(?:terms of )?(?:the )?%s(?: licen[cs]e)?",
    "licen[cs]e %s",
)

_KEYWORD_STOPS = frozenset("the and to open public license software free general common source data commons of do what domain version community university".split())


def _split(body: str) -> list[str]:
    """The alternatives of a pattern at its outermost level."""
    parts, depth = [""], 0
    for c in body:
        depth += (c == "(") - (c == ")")
        if c == "|" and depth == 0:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def _plain(body: str) -> list[str]:
    """The ways to match a pattern, as the text that each must hold; a newline stands for what may differ."""
    out, i = [""], 0
    while i < len(body):
        ways, c = [body[i]], body[i]
        i += 1
        if c == "(":
            start, depth = i, 1
            while depth:
                depth += (body[i] == "(") - (body[i] == ")")
                i += 1
            ways = [w for part in _split(body[start : i - 1].removeprefix("?:")) for w in _plain(part)]
        elif c == "[":
            ways, i = ["\n"], body.index("]", i) + 1
        if body[i : i + 1] == "?":
            ways, i = ["\n"], i + 1
        out = [o + w for o in out for w in ways]
    return out


def _keywords(title: str) -> tuple[str, ...]:
    """Texts of which every match of the title holds one: a plain word that all its forms share, or else the longest stretch of each."""
    forms = _plain(title)
    words = [{w for piece in f.split("\n") for w in piece.split() if not w.isdigit() and w not in _KEYWORD_STOPS} for f in forms]
    shared = set.intersection(*words)
    if shared:
        return (max(sorted(shared), key=len),)
    return tuple(sorted({max(f.split("\n"), key=len).strip() for f in forms}))


def rules() -> list[tuple[str, int, str, str]]:
    """All rules as ``(label, priority, keyword, pattern)``, in order. A pattern whose matches share no word has a row for each of its keywords."""
    out: list[tuple[str, int, str, str]] = []
    for label, tag, title in LICENSES:
        out.append((label, TAG, "spdx", f" spdx license identifier {tag}(?: only| or later)?(?= )"))
        keywords = _keywords(title)
        for form in GRANTS:
            out.extend((label, GRANT, k, f" {form % title}(?= )") for k in keywords)
        named = title if "licen" in title else f"(?:the )?{title} licen[cs]e"
        out.extend((label, TITLE, k, f" {named}(?= )") for k in keywords)
    for label, priority, keyword, body in SENTENCES:
        out.append((label, priority, keyword, f" {body}(?= )"))
    return out
