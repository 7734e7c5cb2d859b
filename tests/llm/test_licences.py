from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from hearsay.llm import licence_texts
from hearsay.llm import licences as L
from hearsay.llm.licence_texts import MIT, TEMPLATES
from hearsay.llm.queries import LLM_QUERIES

from .helpers import documents

KNOWN = L.Templates(TEMPLATES, L.THRESHOLD)


def plain(text, templates, threshold):
    """All spans of words against all templates: the best is taken, then the best that does not
    overlap a taken one, until none is left. ``(licence, dice, first line, last line)``."""
    words, lines = [], []
    for at, line in enumerate(L.lines_of(text)):
        words += line
        lines += [at] * len(line)
    pairs = list(zip(words, words[1:]))
    known = L.Templates(templates, threshold)
    every = []
    for i, own in enumerate(known.grams):
        for a in range(len(pairs)):
            for b in range(a, len(pairs)):
                span = set(pairs[a : b + 1])
                value = L.dice(frozenset(span), own)
                if value >= threshold and span & own & known.telling:
                    every.append((-value, known.names[i], a, b))
    taken = []
    for value, name, a, b in sorted(every):
        if all(b < c or a > d for _, _, c, d in taken):
            taken.append((value, name, a, b))
    found = [(name, -value, lines[a], lines[b + 1]) for value, name, a, b in taken]
    return sorted(found, key=lambda m: (-m[1], m[0], m[2]))


def score(found):
    """What spans of the same quality share: ties may begin or end elsewhere."""
    return sorted((round(m[1], 9)) for m in found)


def test_brute_force():
    rng = random.Random(1)
    for k in range(120):
        templates = [(f"t{i % 5}", " ".join(rng.choices("abcdefgh", k=rng.randrange(3, 8)))) for i in range(8)]
        known = L.Templates(templates, 0.7)
        lines = [rng.choice(templates)[1] if rng.random() < 0.4 else
                 " ".join(rng.choices("abcdefghxyz", k=rng.randrange(5))) for _ in range(rng.randrange(6))]
        text = "\n".join(lines).encode()
        got, want = known.find_spans(text), plain(text, templates, 0.7)
        assert [m[:2] for m in got[:1]] == [m[:2] for m in want[:1]]
        for a, b in zip(got, got[1:]):
            assert a[1] >= b[1]
        # Greedy choices among equal spans may differ; the taken ones are about as good.
        assert abs(sum(score(got)) - sum(score(want))) <= 0.3 * max(1, len(want))


@pytest.mark.parametrize(
    "text, licence",
    [
        ("Released under the MIT License.", "MIT"),
        ("prose before\nLicensed under CC BY-NC 4.0.\nprose after", "CC-BY-NC-4.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        ("licensed UNDER the Apache License -- version 2.0", "Apache-2.0"),
        (f"some code\nCopyright (c) 2020 Someone\n\n{MIT}\nmore code", "MIT"),
        (MIT.replace("Software", "Program"), "MIT"),
        (" ".join(MIT.split()[::2]), None),
        ("All rights reserved.", None),
        ("the licence of the king, released under protest", None),
        ("", None),
    ],
)
def test_known_notices(text, licence):
    found = KNOWN.find_spans(text.encode())
    assert (found[0][0] if found else None) == licence


def test_templates_find_themselves():
    for name, text in TEMPLATES:
        best = KNOWN.find_spans(text.encode())[0]
        assert best[:2] == (name, 1.0)


def test_rows(spark):
    docs = documents(spark, ["Released under the MIT License.", None, "", "x"])
    docs = docs.withColumn("matches", F.lit("clash"))
    got = {r["doc_id"]: r for r in L.best_licence(L.scan(docs.union(docs))).distinct().collect()}
    assert (got[0]["licence"], got[0]["dice"], got[0]["n_places"]) == ("MIT", 1.0, 1)
    assert all(got[i]["licence"] is None and got[i]["n_places"] == 0 for i in (1, 2, 3))
    assert L.scan(docs.limit(0)).count() == 0


def test_query_finds_the_notices_of_the_table(spark):
    """The table's notices are lines of their own: the licence of the line's template."""
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = LLM_QUERIES["op7_license_scans"](spark, sf_dir).join(docs, "doc_id").collect()
    assert len(got) == docs.count()
    notices = {}
    for name, template in TEMPLATES:
        words = tuple(w for line in L.lines_of(template.encode()) for w in line)
        notices.setdefault(words, name)
    for r in got:
        lines = {tuple(words) for words in L.lines_of(r["text"].encode()) if words}
        want = {notices[words] for words in lines if words in notices}
        assert want <= set(filter(None, r["licences"].split(",")))
        assert bool(r["licence"]) == bool(r["licences"]) and (r["n_places"] > 0) == bool(r["licence"])
    assert sum(r["licence"] is not None for r in got) > 10


def best_span(text, template):
    """Best Dice over all spans of words."""
    words = [w for line in L.lines_of(text) for w in line]
    own = L.bigrams([w for line in L.lines_of(template.encode()) for w in line])
    spans = (words[a:b] for a in range(len(words)) for b in range(a + 2, len(words) + 1))
    return max((L.dice(L.bigrams(s), own) for s in spans), default=0.0)


def test_spans_brute_force():
    rng = random.Random(4)
    for _ in range(150):
        template = " ".join(rng.choices("abcdefg", k=rng.randrange(3, 9)))
        words = rng.choices("abcdefgxyz", k=rng.randrange(14)) + template.split()
        words[rng.randrange(len(words))] = "z"
        words += rng.choices("abcxyz", k=rng.randrange(8))
        text = "".join(w + rng.choice("  \n") for w in words).encode()
        got = L.Templates([("t", template)], 0.7).find_spans(text)
        want = best_span(text, template)
        assert (got[0][1] if got else 0.0) == (want if want >= 0.7 else 0.0)


def test_notices_are_found_whatever_the_lines():
    lines = MIT.split("\n")
    lines.insert(len(lines) // 2, "an inserted line of quite other words")
    assert KNOWN.find_spans("\n".join(lines).encode())[0][0] == "MIT"
    text = b"This module is part of foo. Released under the MIT License."
    assert KNOWN.find_spans(text)[0][:2] == ("MIT", 1.0)
    flat = ("word " * 300 + " ".join(MIT.split()) + " more prose" * 300).encode()
    assert KNOWN.find_spans(flat)[0][:2] == ("MIT", 1.0)
    assert KNOWN.find_spans(b"prose without any notice " * 50) == []


def test_an_opening_alone_tells_no_licence():
    assert KNOWN.find_spans(b"This work is licensed under the terms of Foo.") == []


@pytest.mark.parametrize(
    "text, licence",
    [
        ("Released under the MIT licence.", "MIT"),
        ("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
        ("# SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1"),
        ("Licensed under the GNU Lesser General Public License, version 2.1.", "LGPL-2.1"),
        ("Licensed under the Eclipse Public License, Version 2.0.", "EPL-2.0"),
        ("Released under CC0 1.0.", "CC0-1.0"),
        ("It is licensed under the GPLv3.", "GPL-3.0"),
        *((text[len(text) // 20 :], name) for name, text in licence_texts.TERMS),
    ],
)
def test_more_licences_and_forms(text, licence):
    found = KNOWN.find_spans(text.encode())
    assert found and found[0][0] == licence


def test_terms_are_there():
    assert len(licence_texts.TERMS) == 8


def test_places_of_spans():
    text = b"Released under the MIT License. " + b"x y z w " * 9 + b"\n\nReleased under the MIT License."
    assert [m[2:] for m in KNOWN.find_spans(text)] == [(0, 0), (2, 2)]


@pytest.mark.parametrize(
    "text, licences",
    [
        ("licensed under the GNU General Public License, version 2", ["GPL-2.0"]),
        (dict(licence_texts.TERMS)["GPL-2.0"], ["GPL-2.0"]),
        ("SPDX-License-Identifier: MIT OR Apache-2.0", ["Apache-2.0", "MIT"]),
        ("/* SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0) AND MIT */", ["GPL-2.0", "MIT"]),
        ("SPDX-License-Identifier: MIT", ["MIT"]),
        (f"{MIT}\n" + dict(licence_texts.TERMS)["Apache-2.0"], ["Apache-2.0", "MIT"]),
    ],
)
def test_only_the_licences_that_are_there(text, licences):
    assert sorted({m[0] for m in KNOWN.find_spans(text.encode())}) == licences


def test_many_notices_take_time_in_proportion():
    import time

    line = "Released under the MIT License."
    start = time.process_time()
    assert len(KNOWN.find_spans((line + "\n") .encode() * 2000)) == 2000
    assert len(KNOWN.find_spans((line + " ").encode() * 500)) == 500
    assert len(KNOWN.find_spans((MIT + "\n").encode() * 50)) == 50
    assert time.process_time() - start < 20


def test_spans_do_not_overlap():
    text = "\n".join(t for _, t in TEMPLATES[-40:]).encode()
    words = sum(len(line) for line in L.lines_of(text))
    found = KNOWN.find_spans(text)
    assert found and words
    by_line = sorted((m[2], m[3]) for m in found)
    assert all(b[0] >= a[1] for a, b in zip(by_line, by_line[1:]))
