"""License scans by ordered signature rules.

Several hundred regexes, a family of forms for each license; each runs only where the pieces that all its matches
contain stand in the text: grants in prose, with names or short tags; keys of package data, quoted, assigned, in XML or in a table, with every operand
of an expression; addresses; names with versions; sentences of the licenses' own texts. Detections are resolved in rule order: a detection that lies inside one of higher priority is suppressed.
The four base phrases are counted by word position. Null and empty texts have no words, no labels and score 0;
rows that repeat each give a row; an empty table gives none; whole texts are scanned, however long; other columns are not read; of two detections of one
span that of the family named first stays.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from re import _parser as parser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PY_WORD, byte_words

_W, _N = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Fixed values of the contract: phrase and label.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
_BASE_RE = re.compile(rf"(?<!{_W})(?:" + "|".join(f"({_N.join(p.split())})" for p in BASE) + rf")(?!{_W})", re.I | re.A)
_BASE_LABELS = list(BASE.values())

#: label, names (regexes), tag of the package-data form, addresses
FAMILIES = [
    ("agpl", [r"gnu\s+affero\s+general\s+public\s+licen[cs]e", r"affero\s+gpl", r"agpl(?:[\s-]?v?[13](?:\.0)?\+?)?"], r"agpl-[13]\.0(?:-only|-or-later|\+)?", [r"gnu\.org/licenses/agpl"]),
    ("lgpl", [r"gnu\s+(?:lesser|library)\s+general\s+public\s+licen[cs]e", r"lesser\s+gpl", r"lgpl(?:[\s-]?v?[23](?:\.[01])?\+?)?"], r"lgpl-(?:2\.0|2\.1|3\.0)(?:-only|-or-later|\+)?", [r"gnu\.org/licenses/(?:old-licenses/)?lgpl"]),
    ("gfdl", [r"gnu\s+free\s+documentation\s+licen[cs]e", r"gfdl"], r"gfdl-1\.[123](?:-only|-or-later)?", [r"gnu\.org/licenses/fdl"]),
    ("gpl", [r"gnu\s+general\s+public\s+licen[cs]e", r"gnu\s+gpl", r"gpl(?:[\s-]?v?[123](?:\.0)?\+?)?"], r"gpl-[123]\.0(?:-only|-or-later|\+)?", [r"gnu\.org/licenses/(?:old-licenses/)?gpl"]),
    ("apache-1.1", [r"apache\s+software\s+licen[cs]e,?\s+v(?:ersion)?\s*1\.[01]"], r"apache-1\.[01]", [r"apache\.org/licenses/license-1\.1"]),
    ("apache-2.0", [r"apache\s+licen[cs]e,?\s+v(?:ersion)?\.?\s*2(?:\.0)?", r"apache\s+2\.0"], r"apache-2\.0", [r"apache\.org/licenses/license-2\.0"]),
    ("apache", [r"apache\s+(?:software\s+)?licen[cs]e", r"asl\s+2"], r"apache", [r"apache\.org/licenses"]),
    ("mit-0", [r"mit\s+no\s+attribution", r"mit-0"], r"mit-0", [r"opensource\.org/licenses/mit-0"]),
    ("mit", [r"mit(?:/expat|/x11)?\s+licen[cs]e", r"expat\s+licen[cs]e", r"x11\s+licen[cs]e"], r"(?:mit|x11|expat)", [r"opensource\.org/licenses/mit\b"]),
    ("bsd-2-clause", [r"(?:simplified|freebsd|2-clause|two-clause)\s+bsd", r"bsd\s+2-clause"], r"bsd-2-clause(?:-freebsd|-patent)?", [r"opensource\.org/licenses/bsd-2-clause"]),
    ("bsd-3-clause", [r"(?:modified|revised|new|3-clause|three-clause)\s+bsd", r"bsd\s+3-clause"], r"bsd-3-clause(?:-clear|-lbnl)?", [r"opensource\.org/licenses/bsd-3-clause"]),
    ("bsd-4-clause", [r"(?:original|4-clause|four-clause)\s+bsd", r"bsd\s+4-clause"], r"bsd-4-clause(?:-uc)?", [r"spdx\.org/licenses/bsd-4"]),
    ("0bsd", [r"zero-clause\s+bsd", r"0bsd"], r"0bsd", [r"opensource\.org/licenses/0bsd"]),
    ("bsd", [r"bsd(?:-style)?\s+licen[cs]e"], r"bsd", [r"opensource\.org/licenses/bsd"]),
    ("isc", [r"isc\s+licen[cs]e"], r"isc", [r"opensource\.org/licenses/isc"]),
    ("mpl", [r"mozilla\s+public\s+licen[cs]e", r"mpl\s+[12]\.[01]"], r"mpl-[12]\.[01]", [r"mozilla\.org/mpl"]),
    ("epl", [r"eclipse\s+public\s+licen[cs]e", r"epl\s+[12]\.0"], r"epl-[12]\.0", [r"eclipse\.org/legal/epl"]),
    ("edl", [r"eclipse\s+distribution\s+licen[cs]e"], r"edl-1\.0", [r"eclipse\.org/org/documents/edl"]),
    ("cddl", [r"common\s+development\s+and\s+distribution\s+licen[cs]e", r"cddl"], r"cddl-1\.[01]", [r"opensource\.org/licenses/cddl"]),
    ("cpl", [r"common\s+public\s+licen[cs]e"], r"cpl-1\.0", [r"opensource\.org/licenses/cpl"]),
    ("eupl", [r"european\s+union\s+public\s+licen[cs]e", r"eupl"], r"eupl-1\.[012]", [r"joinup\.ec\.europa\.eu/\S*eupl"]),
    ("osl", [r"open\s+software\s+licen[cs]e"], r"osl-[123]\.[01]", [r"opensource\.org/licenses/osl"]),
    ("afl", [r"academic\s+free\s+licen[cs]e"], r"afl-[123]\.[012]", [r"opensource\.org/licenses/afl"]),
    ("artistic", [r"(?:perl\s+)?artistic\s+licen[cs]e"], r"artistic-[12]\.0(?:-perl)?", [r"opensource\.org/licenses/artistic"]),
    ("zlib", [r"zlib(?:/libpng)?\s+licen[cs]e"], r"zlib", [r"opensource\.org/licenses/zlib"]),
    ("libpng", [r"libpng\s+licen[cs]e"], r"libpng(?:-2\.0)?", [r"libpng\.org/\S*licen"]),
    ("unlicense", [r"(?:the\s+)?unlicense"], r"unlicense", [r"unlicense\.org"]),
    ("wtfpl", [r"wtfpl"], r"wtfpl", [r"wtfpl\.net"]),
    ("bsl-1.0", [r"boost\s+software\s+licen[cs]e"], r"bsl-1\.0", [r"boost\.org/license"]),
    ("busl", [r"business\s+source\s+licen[cs]e"], r"busl-1\.1", [r"mariadb\.com/bsl"]),
    ("sspl", [r"server\s+side\s+public\s+licen[cs]e"], r"sspl-1\.0", [r"mongodb\.com/licensing/server-side"]),
    ("elastic", [r"elastic\s+licen[cs]e"], r"elastic-2\.0", [r"elastic\.co/licensing"]),
    ("ms-pl", [r"microsoft\s+public\s+licen[cs]e", r"ms-pl"], r"ms-pl", [r"opensource\.org/licenses/ms-pl"]),
    ("ms-rl", [r"microsoft\s+reciprocal\s+licen[cs]e", r"ms-rl"], r"ms-rl", [r"opensource\.org/licenses/ms-rl"]),
    ("python", [r"python\s+software\s+foundation\s+licen[cs]e", r"psf\s+licen[cs]e"], r"(?:psf|python)-2\.0", [r"docs\.python\.org/\S*license"]),
    ("php", [r"php\s+licen[cs]e"], r"php-3\.0[01]?", [r"php\.net/license"]),
    ("ruby", [r"ruby\s+licen[cs]e"], r"ruby", [r"ruby-lang\.org/\S*license"]),
    ("openssl", [r"openssl\s+licen[cs]e"], r"openssl", [r"openssl\.org/source/license"]),
    ("ncsa", [r"(?:university\s+of\s+illinois/)?ncsa\s+open\s+source\s+licen[cs]e"], r"ncsa", [r"opensource\.org/licenses/ncsa"]),
    ("w3c", [r"w3c\s+software\s+(?:notice\s+and\s+)?licen[cs]e"], r"w3c(?:-\d+)?", [r"w3\.org/consortium/legal/\S*software"]),
    ("ofl", [r"sil\s+open\s+font\s+licen[cs]e", r"ofl\s+1\.1"], r"ofl-1\.[01]", [r"scripts\.sil\.org/ofl"]),
    ("odbl", [r"open\s+database\s+licen[cs]e", r"odbl"], r"odbl-1\.0", [r"opendatacommons\.org/licenses/odbl"]),
    ("odc-by", [r"open\s+data\s+commons\s+attribution\s+licen[cs]e"], r"odc-by-1\.0", [r"opendatacommons\.org/licenses/by"]),
    ("pddl", [r"public\s+domain\s+dedication\s+and\s+licen[cs]e", r"pddl"], r"pddl-1\.0", [r"opendatacommons\.org/licenses/pddl"]),
    ("cc0", [r"cc0(?:\s+1\.0)?", r"creative\s+commons\s+zero"], r"cc0-1\.0", [r"creativecommons\.org/publicdomain/zero"]),
    ("cc-by-nc-nd", [r"cc[\s-]by-nc-nd(?:\s+[1-4]\.[05])?", r"creative\s+commons\s+attribution-noncommercial-noderiv\w*"], r"cc-by-nc-nd-[1-4]\.[05]", [r"creativecommons\.org/licenses/by-nc-nd"]),
    ("cc-by-nc-sa", [r"cc[\s-]by-nc-sa(?:\s+[1-4]\.[05])?", r"creative\s+commons\s+attribution-noncommercial-sharealike"], r"cc-by-nc-sa-[1-4]\.[05]", [r"creativecommons\.org/licenses/by-nc-sa"]),
    ("cc-by-nc", [r"cc[\s-]by-nc(?:\s+[1-4]\.[05])?", r"creative\s+commons\s+attribution-noncommercial"], r"cc-by-nc-[1-4]\.[05]", [r"creativecommons\.org/licenses/by-nc\b"]),
    ("cc-by-nd", [r"cc[\s-]by-nd(?:\s+[1-4]\.[05])?", r"creative\s+commons\s+attribution-noderiv\w*"], r"cc-by-nd-[1-4]\.[05]", [r"creativecommons\.org/licenses/by-nd"]),
    ("cc-by-sa", [r"cc[\s-]by-sa(?:\s+[1-4]\.[05])?", r"creative\s+commons\s+attribution-sharealike"], r"cc-by-sa-[1-4]\.[05]", [r"creativecommons\.org/licenses/by-sa"]),
    ("cc-by", [r"cc[\s-]by(?:\s+[1-4]\.[05])?", r"creative\s+commons\s+attribution"], r"cc-by-[1-4]\.[05]", [r"creativecommons\.org/licenses/by\b"]),
    ("public-domain", [r"(?:released|placed|dedicated)\s+(?:in|to|into)\s+the\s+public\s+domain"], r"licenseref-public-domain", [r"creativecommons\.org/publicdomain/mark"]),
    ("proprietary", [r"(?:copyright|\(c\)|©)[^\n]{0,120}all\s+rights\s+reserved"], r"licenseref-proprietary", [r"licenseref-commercial"]),
]
_LEAD = r"(?:licen[cs]ed|released|distributed|available|published|provided)\s+(?:\w+\s+){0,3}under\s+(?:the\s+)?(?:terms\s+(?:and\s+conditions\s+)?of\s+)?(?:the\s+)?"
_VERSION = r",?\s+v(?:ersion)?\.?\s*\d+(?:\.\d+)*(?:\s*,?\s*or\s+(?:\(at\s+your\s+option\)\s+)?(?:any\s+)?later(?:\s+version)?)?"
#: The key of package data in its notations: bare, quoted, an assignment, a table with a text.
_KEY = r"(?:spdx-license-identifier|licen[cs]e)[\"']?\s*[:=]\s*(?:\{\s*[\"']?(?:text|type|name)[\"']?\s*[:=]\s*)?"
#: Confidence that a detection of each form is a grant.
FORMS = {"grant": 0.95, "tag": 0.98, "address": 0.9, "version": 0.85, "name": 0.6}
#: Sentences of the licenses' own texts, most of which do not name them: label and words. Three dots stand for up to six words.
TEXTS = [
    ("agpl", "free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("agpl", "if you modify the program your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("lgpl", "free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl", "free software you can redistribute it and or modify it under the terms of the gnu library general public license"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-1.1", "this product includes software developed by the apache software foundation"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files ... to deal in the software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd-3-clause", "neither the name of ... nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-3-clause", "the name of the author may not be used to endorse or promote products derived from this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("mpl", "the contents of this file are subject to the mozilla public license"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("eupl", "you may not use this work except in compliance with the licence"),
    ("artistic", "this package is free software you may copy use modify and redistribute it under the terms of the artistic license"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "do what the fuck you want to public license"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("ncsa", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers"),
    ("python", "psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("php", "products derived from this software may not be called php nor may php appear in their name"),
    ("openssl", "this product includes software developed by the openssl project"),
    ("w3c", "permission to copy modify and distribute this work with or without modification for any purpose and without fee or royalty is hereby granted"),
    ("ofl", "this font software is licensed under the sil open font license"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0", "to the extent possible under law ... has waived all copyright and related or neighboring rights"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "this file is confidential and proprietary"),
]
#: Between two words of such a sentence: white space, punctuation and the marks of comments.
_GAP = r"[\s\"'“”‘’.,;:()/*#>|!_-]+"


def sentence(words: str) -> str:
    """Regex of a sentence's words, however they are wrapped, quoted or commented."""
    parts = [_GAP.join(re.escape(w) for w in part.split()) for part in words.split("...")]
    return r"\b" + rf"{_GAP}(?:[^\s]+\s+){{0,6}}[^\s\w]*".join(parts) + r"\b"


def needed(rule) -> list[tuple[str, ...]]:
    """Pieces of lower-case text, of each tuple one, that every match of a parsed regex contains."""
    out, run = [], ""
    for op, arg in [*rule, (None, None)]:
        if op is parser.LITERAL:
            run += chr(arg).lower()
            continue
        if len(run) > 1:
            out.append((run,))
        run = ""
        if op is parser.SUBPATTERN:
            out += needed(arg[-1])
        elif op is parser.MAX_REPEAT and arg[0] > 0:
            out += needed(arg[-1])
        elif op is parser.BRANCH:
            ways = [[x for x in needed(way) if len(x) == 1] for way in arg[1]]
            if all(ways):
                out.append(tuple(max((x[0] for x in way), key=len) for way in ways))
    return out


def _rules() -> list[tuple[tuple[int, int], str, float, list[tuple[str, ...]], re.Pattern]]:
    """(priority, label, confidence, needed pieces, regex): priority is the family's place, then the form's."""
    out = []
    for place, (label, names, tag, addresses) in enumerate(FAMILIES):
        forms = [("grant", _LEAD + n + rf"(?:\s+licen[cs]e)?(?:{_VERSION})?") for n in names] + [("grant", sentence(words)) for of, words in TEXTS if of == label]
        forms += [("tag", rf"{_KEY}[\"'(]*{tag}\b"), ("tag", rf"<licen[cs]e(?:\s[^<>]{{0,80}})?>\s*(?:<name>\s*)?{tag}\b"), ("tag", rf"{_KEY}[\"'(]*[^\n\"'<>]{{1,160}}[\s)](?:and|or)\s+\(*({tag})(?![\w.-])")]
        forms += [("grant", rf"{_LEAD}{tag}(?![\w-]|\.\w)"), ("grant", rf"\b{tag}[\s-]+licen[cs]ed\b")]
        forms += [("address", rf"https?://(?:www\.)?{a}[^\s\"')]*") for a in addresses]
        forms += [("version", rf"\b{n}{_VERSION}") for n in names] + [("name", rf"\b{n}\b") for n in names]
        out += [((place, i), label, FORMS[f], needed(parser.parse(r)), re.compile(r, re.I | re.A)) for i, (f, r) in enumerate(forms)]
    return out


RULES = _rules()
#: Rules under the longest piece that they need, with the others; rules that need one of several pieces are under the first tuple.
_BY_PIECE: dict[tuple[str, ...], list] = {}
for _r in RULES:
    _first = max(_r[3], key=lambda x: (len(x) == 1, min(map(len, x))))
    _BY_PIECE.setdefault(_first, []).append(([x for x in _r[3] if x != _first], _r))


def candidates(low: str) -> list[tuple]:
    """Rules whose needed pieces all stand in a lower-cased text: a match of any other is impossible."""
    return [r for first, rules in _BY_PIECE.items() if any(k in low for k in first) for rest, r in rules if all(any(k in low for k in x) for x in rest)]


def detections(text: str, low: str) -> list[tuple[int, int, str, float]]:
    """Spans (start, end, label, confidence) that stay after suppression by containment."""
    # a rule with a group finds what the group holds: an operand, not the expression before it
    found = [(p, *m.span(rx.groups), label, conf) for p, label, conf, _, rx in candidates(low) for m in rx.finditer(text)]
    kept: list[tuple[int, int, str, float]] = []
    # the spans kept that no other one contains: starts and ends both rise
    starts: list[int] = []
    ends: list[int] = []
    # families in their order, in a family the longest span first: a span goes only where one of equal or higher priority contains it
    for _, a, b, label, conf in sorted(found, key=lambda x: (x[0][0], x[1] - x[2], x[0][1])):
        i = bisect_right(starts, a)
        if i and ends[i - 1] >= b:
            continue
        kept.append((a, b, label, conf))
        i = j = bisect_left(starts, a)
        while j < len(ends) and ends[j] <= b:
            j += 1
        starts[i:j], ends[i:j] = [a], [b]
    return sorted(kept)


def scan_text(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, spans of a text."""
    text = text or ""
    n_words = len(byte_words(text))
    low = text.lower()
    first = last = None
    n_base, base, at, word = 0, set(), 0, 0
    if "license" in low or "cc" in low:
        for m in _BASE_RE.finditer(text):
            word += len(PY_WORD.findall(text, at, m.start()))
            at = m.start()
            first, last, n_base = (word if first is None else first), word, n_base + 1
            base.add(_BASE_LABELS[m.lastindex - 1])
    spans = detections(text, low)
    miss = 1.0
    for _, _, _, conf in spans:
        miss *= 1 - conf
    labels = base | {s[2] for s in spans}
    return n_words, n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), max(1 - miss, 0.6 if base else 0.0), ",".join(f"{x}:{a}:{b}" for a, b, x, _ in spans)


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def _scan(texts: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame([scan_text(t) for t in texts], columns=[x.split()[0] for x in FIELDS.split(", ")])
    return out.astype({"n_words": "int64", "n_base": "int64", "first_word": "Int64", "last_word": "Int64", "score": "float64"})


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, word and base counts, base_labels, labels, score and spans (label:start:end) of each row."""
    return docs.select("doc_id", F.pandas_udf(_scan, FIELDS)("text").alias("_r")).select("doc_id", "_r.*")
