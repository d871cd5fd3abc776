import re

import pytest

from glintframe.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plainly(text):
    """n_words, n_base, first, last, base labels, by looking at every word."""
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(i, label) for i in range(len(words)) for phrase, label in licenses.BASE.items() if words[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


TEXTS = [
    None, "", "   ", "cc by", "CC-BY cc by, cc\nBY", "xcc by cc byx cc by", "GNU General Public License v3. All rights reserved.", "general general public license license",
    "all rights all rights reserved", "cc by cc by", "É cc by É", "cc by" * 3, "cc by " * 20_000, "All Rights Reserved " + "x " * 50_000, "K cc by", "all rights reserved cc by general public license",
    "Permission is hereby granted, free of charge, to any person", "\x00cc\x7fby\x00",
]


@pytest.mark.parametrize("text", TEXTS)
def test_places_against_every_word(text):
    n_words, n_base, first, last, base_labels, labels, score, *_ = licenses.scan(text)
    assert (n_words, n_base, first, last, base_labels) == plainly(text)
    assert set(filter(None, base_labels.split(","))) <= set(labels.split(",")) and 0 <= score <= 1
    assert labels.split(",") == sorted(set(labels.split(",")))


@pytest.mark.parametrize("text, want", [
    ("MIT", [{"mit"}]),
    ("MIT OR Apache-2.0", [{"mit"}, {"apache-2.0"}]),
    ("MIT AND (BSD-3-Clause OR Apache-2.0)", [{"mit", "bsd-3-clause"}, {"mit", "apache-2.0"}]),
    ("MIT OR GPL-2.0-only AND ISC", [{"mit"}, {"gpl-2.0-only", "isc"}]),
    ("GPL-2.0-or-later WITH Classpath-exception-2.0 OR MIT", [{"gpl-2.0-or-later with classpath-exception-2.0"}, {"mit"}]),
    ("((MIT))", [{"mit"}]),
    ("MIT, as the text below says", [{"mit"}]),
])
def test_expressions(text, want):
    assert sorted(sorted(c) for c in licenses.evaluated(text)[1].choices()) == sorted(sorted(c) for c in want)


@pytest.mark.parametrize("text", ["", "OR MIT", "(MIT", "MIT OR", "MIT AND ()", "WITH x"])
def test_broken_expressions(text):
    assert licenses.evaluated(text) is None


def test_many_choices_are_all_kept():
    names, tree = licenses.evaluated(" AND ".join(f"(a{k} OR b{k})" for k in range(12)))
    assert len(names) == 24 and len(set(tree.choices())) == 4096
    wide = licenses.evaluated(" AND ".join(f"(MIT OR b{k})" for k in range(500)))[1]
    assert wide.met(licenses.permissive) and wide.form.count("mit") == 500


@pytest.mark.parametrize("text, form, permissive", [
    ("MIT or apache-2.0 OR mit", "apache-2.0 or mit", True),
    ("GPL-3.0-only AND (MIT OR ISC)", "gpl-3.0-only and (isc or mit)", False),
    ("GPL-3.0-only OR (MIT AND ISC)", "gpl-3.0-only or isc and mit", True),
    ("Apache-2.0 WITH LLVM-exception AND MIT", "apache-2.0 with llvm-exception and mit", True),
])
def test_normal_form_and_evaluation(text, form, permissive):
    names, tree = licenses.evaluated(text)
    assert tree.form == form and tree.met(licenses.permissive) == permissive == any(all(map(licenses.permissive, c)) for c in tree.choices())
    assert licenses.evaluated(form)[1].form == form


def test_deep_expressions():
    depth = 3000
    text = "".join(f"a{k} {'or' if k % 2 else 'and'} (" for k in range(depth)) + "MIT" + ")" * depth
    names, tree = licenses.evaluated(text)
    assert len(names) == depth + 1 and not tree.met(licenses.permissive) and tree.met(lambda name: True)


def test_expressions_come_from_the_places_of_the_automaton():
    text = "é SPDX-License-Identifier : MIT\nxspdx-license-identifier: ISC\nSPDX License Identifier: Zlib OR GPL-2.0-only\nspdx-license-identifier MIT\nSPDX-License-Identifier:\tGPL-2.0-only"
    found = licenses.scan(text)
    assert found[-2:] == (["mit", "gpl-2.0-only or zlib", "gpl-2.0-only"], False)
    assert licenses.scan("SPDX-License-Identifier: MIT")[-1] is True and licenses.scan("MIT")[-2:] == ([], None)


def test_tag_gives_labels_and_certainty():
    *_, labels, score, expressions, permissive = licenses.scan("// SPDX-License-Identifier: (MIT OR Apache-2.0)\ncode")
    assert labels == "apache-2.0,mit" and score == pytest.approx(0.95) and expressions == ["apache-2.0 or mit"] and permissive


def test_documents(spark, documents, folder):
    rows = [*enumerate(TEXTS), (5, "cc by"), (5, "cc by"), (None, "cc by")]
    out = licenses.op7_license_scan(spark, folder(documents=documents(rows))).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in out), key=str) == sorted(((i, *plainly(t)) for i, t in rows), key=str)


def test_empty(spark, documents, folder):
    assert licenses.op7_license_scan(spark, folder(documents=documents([]))).count() == 0
