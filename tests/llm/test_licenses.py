from __future__ import annotations

import pytest

from tallyguard.llm import licenses

# Each sentence that is a license by itself, and that license.
ALONE = [(s, name) for name, (only,) in ((n, w) for n, w in licenses._RULES if len(w) == 1) for s in licenses.SENTENCES[only]]
HEADER = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
    "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
    "any later version."
)
NONE = [
    HEADER,
    "This program is free software.",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.",
    "SPDX-License-Identifier: Zlib",
]


def test_no_two_sentences_have_the_same_parts():
    known = licenses.known_sentences()
    owners = {}
    for name, sentences in licenses.SENTENCES.items():
        for sentence in sentences:
            key = tuple(known[x] for x in licenses._parts(sentence))
            assert owners.setdefault(key, name) == name


@pytest.fixture(scope="module")
def found(spark):
    texts = [s + end for s, _ in ALONE for end in (".", "\nimport os\n", "")] + NONE
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {texts[r.doc_id]: r.licenses for r in rows}


def test_every_sentence_is_its_own_license(found):
    assert {(s + end, name) for s, name in ALONE for end in (".", "")} <= set(found.items())


def test_a_tag_before_code_is_its_license(found):
    tags = [(s + "\nimport os\n", name) for s, name in ALONE if s.startswith("SPDX")]
    assert len(tags) == 9 and set(tags) <= set(found.items())


def test_other_licenses_with_the_same_beginning_are_not_known(found):
    assert [found[t] for t in NONE] == [""] * len(NONE)
