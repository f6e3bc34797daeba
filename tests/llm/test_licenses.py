"""License scans: base places against a plain search, tag expressions, awkward rows."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from rentalytics.llm.licenses import BASE_PHRASES, Scanner, evaluate, family, parse, scan
from tests.llm.data import CLASHING, ROWS, awkward, empty

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def by_hand(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    words = WORD.findall(low)
    places, labels = [], set()
    for phrase, label in BASE_PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


SAMPLES = [
    None, "", "   ", "MIT License", "mit-license", "the MIT  LICENSE, the mit\nlicense", "ApacheLicense apache license",
    "GNU General Public License v2 or GENERAL public LICENSE", "mit license mit license mit license",
    "MIT LİCENSE", "mit_license", "mit license2", "ÜMIT license", "général public license", "2 mit license 3",
]


def test_base_against_plain_search():
    s = Scanner()
    for text in SAMPLES:
        f = s.scan(text)
        assert (f.n_words, f.n_base, f.first_word, f.last_word, f.base_labels) == by_hand(text), text
        assert set(f.base_labels.split(",")) <= set(f.labels.split(",")) and 0.0 <= f.score <= 1.0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["mit", "MIT", "license", "apache", "general", "public", "x", ",", " ", "\n", "é", "-"]),
                max_size=30))
def test_base_property(parts):
    text = " ".join(parts)
    f = Scanner().scan(text)
    assert (f.n_words, f.n_base, f.first_word, f.last_word, f.base_labels) == by_hand(text)


def test_expressions():
    assert evaluate(parse("mit or apache-2.0")) == [frozenset({"apache-2.0"}), frozenset({"mit"})]
    assert evaluate(parse("(gpl-2.0 with classpath-exception-2.0) and bsd-3-clause")) == [
        frozenset({"gpl-2.0", "with:classpath-exception-2.0", "bsd-3-clause"})]
    assert evaluate(parse("a or b and c")) == [frozenset({"a"}), frozenset({"b", "c"})]
    assert evaluate(parse("(a or b) and c")) == [frozenset({"a", "c"}), frozenset({"b", "c"})]
    assert evaluate(parse("mit */")) == [frozenset({"mit"})]
    assert parse("mit and") is None and parse("(mit") is None and parse("or mit") is None and parse("") is None
    assert family("gpl-3.0-or-later") == "gpl" and family("lgpl-2.1") == "lgpl" and family("wtfpl") == "wtfpl"
    f = Scanner().scan("/* SPDX-License-Identifier: Apache-2.0 OR MIT */\nint x;\nSPDX-License-Identifier: (broken")
    assert f.labels == "apache,mit" and f.base_labels == "" and f.n_base == 0 and abs(f.score - 0.95) < 1e-12
    assert f.expressions == "apache-2.0 | mit"
    g = Scanner().scan("Permission is hereby granted, free of charge, to any person. Redistribution and use in source "
                       "and binary forms. GNU Lesser General Public License")
    assert g.labels == "bsd,gpl,lgpl,mit" and g.base_labels == "gpl" and g.n_base == 1


def test_rows_keep_place_and_columns(spark):
    df = awkward(spark)
    out = scan(df, "text")
    assert out.count() == len(ROWS)
    for r in out.collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == by_hand(r.text)
    assert [c for c in out.columns[:len(df.columns)] if c in {"labels", "score"}] == []
    assert "own label" in {r.label for r in out.select("label").collect()}
    assert scan(empty(spark), "text").count() == 0


def test_long_text():
    text = ("MIT License " + "word " * 100_000) * 3
    f = Scanner().scan(text)
    assert (f.n_words, f.n_base, f.first_word, f.last_word) == (300_006, 3, 0, 200_004)
