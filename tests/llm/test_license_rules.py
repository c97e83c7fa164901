"""License rules: gated and ungated scans agree, and priority decides what is suppressed."""

import random
import time
from re import _parser as parser

import pytest

from tarn.llm import licenses


def some_match(rule, rng):
    """A text that a parsed regex matches, drawn at random."""
    out = ""
    for op, arg in rule:
        if op is parser.LITERAL:
            out += rng.choice([chr(arg).lower(), chr(arg).upper()])
        elif op is parser.NOT_LITERAL:
            out += "x"
        elif op is parser.IN:
            kind, x = rng.choice(arg[1:]) if arg[0][0] is parser.NEGATE else rng.choice(arg)
            if arg[0][0] is parser.NEGATE:
                out += "x"
            elif kind is parser.CATEGORY:
                out += {parser.CATEGORY_SPACE: rng.choice(" \n\t"), parser.CATEGORY_DIGIT: "2", parser.CATEGORY_WORD: "w", parser.CATEGORY_NOT_SPACE: "x"}[x]
            else:
                out += chr(rng.randint(*x) if kind is parser.RANGE else x)
        elif op is parser.SUBPATTERN:
            out += some_match(arg[-1], rng)
        elif op is parser.MAX_REPEAT:
            out += "".join(some_match(arg[2], rng) for _ in range(rng.randint(arg[0], min(arg[0] + 2, arg[1]))))
        elif op is parser.BRANCH:
            out += some_match(rng.choice(arg[1]), rng)
        else:
            assert op in (parser.AT, parser.ASSERT_NOT)
    return out


def test_gated_and_ungated_scans_agree_on_matches_of_every_rule():
    rng = random.Random(1)
    for rule in licenses.RULES:
        # word boundaries are not drawn, so a few texts do not match
        texts = [t for _ in range(15) if rule[4].search(t := some_match(parser.parse(rule[4].pattern), rng))]
        assert texts, rule
        for text in texts:
            may = {r[0] for r in licenses.candidates(text.lower())}
            assert {r[0] for r in licenses.RULES if r[4].search(text)} <= may, (rule[1], text)
            assert licenses.scan_text(text)[5]


def test_tags_addresses_and_line_breaks_need_no_prose_name():
    for text, label in {
        "SPDX-License-Identifier: Artistic-2.0": "artistic", "SPDX-License-Identifier: BSL-1.0": "bsl-1.0", "SPDX-License-Identifier: OSL-3.0": "osl", "https://www.boost.org/license": "bsl-1.0",
        'license = "MIT"': "mit", "License:MIT": "mit", "License: BSD": "bsd", "BSD\nLicense": "bsd", "GNU Lesser\nGeneral Public License": "lgpl",
        'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software': "mit",
    }.items():
        assert licenses.scan_text(text)[5] == label


def test_a_catch_all_leaves_the_license_named_inside_it():
    """A span goes only where one of equal or higher priority contains it."""
    for text, label in {
        "Copyright (c) 2015 Foo. Released under the BSD license. All rights reserved.": "bsd,proprietary",
        "Copyright (c) 2015 Foo. Licensed under the Apache License, Version 2.0. All rights reserved.": "apache,apache-2.0,proprietary",
        "Copyright 2015 Foo. All rights reserved.": "proprietary",
        "Apache License, Version 2.0 or later": "apache,apache-2.0", "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause", "GNU Affero GPL": "agpl", "Creative Commons Attribution-NonCommercial-NoDerivs": "cc-by-nc-nd",
    }.items():
        # 'apache' is a base label, or the longer span of the family of lower priority
        assert licenses.scan_text(text)[5] == label


def test_sentences_of_license_texts_give_their_label_however_wrapped():
    for label, words in licenses.TEXTS:
        plain = words.replace("...", "the Foo (and Bar)")
        wrapped = "/*\n * " + "\n * ".join(" ".join(plain.split()[i : i + 7]) for i in range(0, len(plain.split()), 7)) + ", or\n */"
        for text in (plain, plain.upper(), wrapped):
            assert label in licenses.scan_text(text)[5].split(","), (label, text)
    assert licenses.scan_text("the origin of the word license is not this software")[5] == ""


def plainly(found):
    """Suppression by its definition, each span against all kept ones."""
    kept = []
    for _, a, b, label, conf in sorted(found, key=lambda x: (x[0][0], x[1] - x[2], x[0][1])):
        if not any(s <= a and b <= e for s, e, _, _ in kept):
            kept.append((a, b, label, conf))
    return sorted(kept)


def test_suppression_agrees_with_its_definition():
    rng = random.Random(3)
    names = ["GNU GPL", "GNU Lesser General Public License, version 2.1", "MIT License", "Apache License 2.0", "Copyright Foo", "all rights reserved", "BSD", "License: MIT", "\n", "and", "under the terms of the"]
    for _ in range(150):
        text = " ".join(rng.choice(names) for _ in range(25))
        found = [(r[0], *m.span(r[4].groups), r[1], r[2]) for r in licenses.RULES for m in r[4].finditer(text)]
        assert licenses.detections(text, text.lower()) == plainly(found)


def test_many_mentions_take_little_time():
    began = time.process_time()
    assert licenses.scan_text("MIT License, GNU GPL; " * 20_000)[5] == "gpl,mit"
    assert time.process_time() - began < 15


@pytest.mark.parametrize("text,labels", [
    ('{"name": "x", "license": "MIT"}', {"mit"}), ("<license>Apache-2.0</license>", {"apache-2.0"}), ("<licenses><license><name>BSD-2-Clause</name></license></licenses>", {"bsd-2-clause"}),
    ('license = {text = "BSD-3-Clause"}', {"bsd-3-clause"}), ("This is GPLv3 code", {"gpl"}), ("LGPLv2.1+ applies", {"lgpl"}), ("Released under MIT.", {"mit"}), ("It is Apache-2.0 licensed", {"apache-2.0"}),
    ("Licensed under BSD-3-Clause", {"bsd-3-clause"}), ("SPDX-License-Identifier: (MIT OR Apache-2.0)", {"mit", "apache-2.0"}), ("SPDX-License-Identifier: MIT AND (ISC OR BSD-2-Clause)", {"mit", "isc", "bsd-2-clause"}),
    ("SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0", {"gpl"}), ('license: "MIT OR Apache-2.0"', {"mit", "apache-2.0"}), ("licence = ISC", {"isc"}),
    ("omit the limit; he is a graduate", set()), ("released under pythons and rubies", set()), ("the license: none", set()), ("driver's license or isc2", set()),
])
def test_forms_of_package_data_and_prose(text, labels):
    assert set(filter(None, licenses.scan_text(text)[5].split(","))) == labels
