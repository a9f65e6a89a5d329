from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from compare import connect, differences
from conftest import SF_DIR
from llm.plain import AWKWARD, awkward

from tallyguard.llm import licenses, repeats
from tallyguard.llm.queries import ORACLES, QUERIES
from tallyguard.llm.topk import exact_top_k

LICENSES = [
    (1, "Released under the MIT Licence."),
    (2, "Some words.\nAll rights reserved\nLicensed under the Apache License, Version 2.0.\nMore."),
    (3, "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0! ALL RIGHTS RESERVED."),
    (
        4,
        "Redistribution and use in source and binary forms, with or\nwithout modification, are permitted provided that the\n"
        "following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer.",
    ),
    (5, "The license is unknown. Released under the MIT License but not really."),
    (6, "You may obtain a copy of the License at: here."),
]


def duck_of(docs):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    if docs:
        con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    return con


def test_license_scan(spark):
    rows = {r.doc_id: (r.licenses, r.unmatched) for r in licenses.scan(awkward(spark, LICENSES)).collect()}
    assert rows[1] == ("MIT", "")
    assert rows[2] == ("Apache-2.0,all-rights-reserved", "")
    assert rows[3] == ("CC-BY-NC-4.0,all-rights-reserved", "")
    assert rows[4] == ("", "BsdGrant,BsdSource")
    assert rows[5] == ("", "")
    assert rows[6] == ("", "ApacheCopy")
    docs = LICENSES + [r for r in AWKWARD if "\x00" not in (r[1] or "")]
    assert differences(licenses.scan(awkward(spark, docs)), duck_of(docs), licenses.oracle()) == []
    assert licenses.scan(awkward(spark, [])).count() == 0


def test_rules_take_their_sentences_in_order(spark):
    full = " ".join(
        licenses.SENTENCES[name][0] + "." for name in ("MitGrant", "MitNotice", "MitWarranty", "MitLiability", "Reserved")
    )
    row = licenses.scan(awkward(spark, [(1, full)])).first()
    assert (row.licenses, row.unmatched, row.n_sentences) == ("MIT,all-rights-reserved", "", 5)


def test_every_known_sentence_has_a_keyword_and_a_rule():
    assert all(any(k in s for k in licenses.KEYWORDS) for s in licenses.known_sentences())
    assert {x for _, sequence in licenses.RULES for x in sequence} <= set(licenses.SENTENCES)


LONG = " ".join(f"w{i}" for i in range(60))
HALF = [" ".join(f"{c}{i}" for i in range(30)) for c in "xy"]
REPEATS = [
    (1, f"intro one\n{LONG}\nshort line"),
    (2, f"{LONG.upper()}\nshort line\nother"),
    (3, f"{HALF[0]}\n\n{HALF[1]}\nend of three"),
    (4, f"start\n{HALF[0]}\n{HALF[1]}"),
    (5, f"only half\n{HALF[0]}\nnothing more"),
    (6, None),
    (7, ""),
    (8, f"ünï 😀\n  {LONG}  \nshort line"),
]


def plain_spans(docs, least=50):
    """Every window of every text, in the order of ids and places; words of a repeated one go."""
    seen, out = {}, []
    for name, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        words = [(m.start(), m.end(), m.group().lower()) for m in re.finditer("[^ \t\r\n\f\v]+", text or "")]
        gone = set()
        for i in range(len(words) - least + 1):
            key = tuple(w for _, _, w in words[i : i + least])
            if key in seen:
                gone |= set(range(i, i + least))
            else:
                seen[key] = name
        for i in sorted(gone):
            if i - 1 not in gone:
                first = i
            if i + 1 not in gone:
                out.append((name, words[first][0], words[i][1], i + 1 - first))
    return Counter(out)


def spans(rows):
    return Counter((r.doc_id, r.start, r.end, r.words) for r in rows.collect())


def stitched(seed, n, least):
    """Texts made of pieces of a few passages, own words, and one word over and over."""
    rng = random.Random(seed)
    passages = [[f"{c}{i}" for i in range(rng.randint(least // 2, 3 * least))] for c in "abcdef"]
    passages.append(["same"] * 3 * least)
    docs = []
    for name in range(n):
        words = []
        for _ in range(rng.randint(0, 6)):
            passage = rng.choice(passages)
            low = rng.choice([0, 0, rng.randrange(len(passage))])
            words += passage[low : rng.choice([len(passage), rng.randint(low, len(passage))])]
            words += [f"own{rng.randrange(10**6)}" for _ in range(rng.choice([0, 1, 3, least]))]
        docs.append((name, "".join((w.upper() if rng.random() < 0.1 else w) + rng.choice([" ", " ", "  ", "\n", "\r\n", "\t"]) for w in words)))
    return docs


def test_repeated_passages(spark):
    size = len(LONG)
    found = repeats.repeats(awkward(spark, REPEATS))
    assert spans(found) == plain_spans(REPEATS)
    rows = sorted((r.doc_id, r.start, r.end, r.words, r.kept_doc_id) for r in found.collect())
    assert rows == [
        (2, 0, size + 11, 62, 1),
        (4, 6, len(REPEATS[3][1]), 60, 3),
        (8, 8, len(REPEATS[7][1]), 62, 1),
    ]
    assert repeats.repeats(awkward(spark, [])).count() == 0


SENTENCES = [" ".join(f"{c}{i}" for i in range(14)) + mark for c, mark in zip("abcde", "..!?.", strict=True)]
PASSAGE = " ".join(SENTENCES)
GLUED = [
    (1, f"First words {PASSAGE} last words.\nMore."),
    (2, f"Other text begins here {PASSAGE} and ends. There."),
    (3, f"Only one sentence. {SENTENCES[1]} Nothing else of it."),
    (4, f"{' '.join(SENTENCES[1:3])} is too short."),
    (5, "Yes. No. Yes. No. First words."),
    (6, f"{' '.join(SENTENCES[1:3])}\nThis line is common, and what follows it here has many other words of its own to read."),
]


def test_a_passage_inside_a_line_is_found_whole(spark):
    found = repeats.repeats(awkward(spark, GLUED)).collect()
    start = GLUED[1][1].index(PASSAGE)
    assert [(r.doc_id, r.start, r.end, r.words) for r in found] == [(2, start, start + len(PASSAGE), 70)]


def test_parts_whose_first_occurrences_differ(spark):
    a, b = ([f"{c}{i}" for i in range(40)] for c in "ab")
    docs = [(1, " ".join(["x"] + a + ["y"])), (2, " ".join(["z"] + b)), (3, " ".join(a + b)), (4, " ".join(["q"] + a + b + ["r"]))]
    found = spans(repeats.repeats(awkward(spark, docs)))
    assert found == plain_spans(docs) and set(found) == {(4, 2, 2 + len(" ".join(a + b)), 80)}


@pytest.mark.parametrize("seed, least", [(1, 50), (2, 9), (3, 8), (4, 4)])
def test_spans_equal_all_windows(spark, seed, least):
    docs = stitched(seed, 60, least) + AWKWARD[2:4]
    docs = [(n, t) for n, (_, t) in enumerate(docs)]
    found = spans(repeats.repeats(awkward(spark, docs).repartition(5), least))
    assert found == plain_spans(docs, least)


@pytest.mark.parametrize("docs", [REPEATS, GLUED, stitched(1, 60, 50)])
def test_repeats_equal_their_sql(spark, docs):
    found = repeats.repeats(awkward(spark, docs)).drop("place", "kept_doc_id")
    assert differences(found, duck_of(docs), repeats.oracle()) == []


def test_repeats_are_cut_out(spark):
    docs = awkward(spark, REPEATS + [(i and i + 1000, t) for i, t in AWKWARD] + [(7, LONG), (7, LONG)])
    rows = repeats.without_repeats(docs.withColumn("__place", docs.doc_id))
    assert rows.columns == [*docs.columns, "__place"] and rows.count() == docs.count()
    assert rows.where("NOT __place <=> doc_id").count() == 0
    texts = {r.doc_id: r.text for r in rows.where("doc_id in (2, 4, 5)").collect()}
    assert texts[2] == "other" and texts[4] == "start\n" and texts[5] == dict(REPEATS)[5]
    assert repeats.repeats(rows).where("doc_id < 1000").count() == 0


def test_rank_decides_what_stays(spark):
    body = LONG + "\n" + HALF[0]
    docs = [(1, f"a\n\n{body}"), (2, f"{body}\n\nb")]
    table = awkward(spark, docs).selectExpr("doc_id", "text", "-doc_id AS rank")
    row = repeats.repeats(table, rank_col="rank").collect()
    assert [(r.doc_id, r.start, r.end, r.kept_doc_id) for r in row] == [(1, 3, 3 + len(body), 2)]


def test_a_line_that_everyone_has(spark):
    docs = [(i, f"{LONG}\nown line {i}") for i in range(500)]
    found = repeats.repeats(awkward(spark, docs).repartition(16)).collect()
    assert sorted(r.doc_id for r in found) == list(range(1, 500))
    assert {r.kept_doc_id for r in found} == {0}


def test_text_that_repeats_itself_is_one_stretch(spark):
    docs = [(1, "tick tock " * 400), (2, "a b c " * 300 + "end " + "tick tock " * 100), (3, "tick tock " * 400)]
    found = spans(repeats.repeats(awkward(spark, docs)))
    assert found == plain_spans(docs)
    words = repeats.Words([t for _, t in docs])
    text, position, digest = repeats.anchors_of(words, 50)
    distance, deep = repeats.nearest_before(text, position, digest, 50)
    for i in range(len(text)):
        before = position[:i][(text[:i] == text[i]) & (digest[:i] == digest[i])]
        assert distance[i] == (position[i] - before.max() if len(before) else 0)
    assert deep.sum() > 0.7 * len(text)


@pytest.mark.parametrize("common", [0, 3_000])
def test_first_occurrences_take_one_shuffle(spark, common):
    # (doc_id, place, rank, pos, digest); with ``common`` one digest is most of all rows.
    rows = [(i % 50, i, i % 7, i % 3, -1 if i < common else i % (600 if common else 2_000)) for i in range(4_000)]
    table = spark.createDataFrame(rows, "doc_id long, place long, rank long, pos int, digest long").cache()
    later = repeats._first_of(table, ["digest"])
    if not common:
        assert later._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    first = {}
    for doc, place, rank, pos, digest in rows:
        first[digest] = min(first.get(digest, (99,)), (rank, doc, place, pos))
    expected = sorted((r[1], first[r[4]][2]) for r in rows if first[r[4]] != (r[2], r[0], r[1], r[3]))
    assert sorted((r.place, r.first.place) for r in later.collect()) == expected
    table.unpersist()


def test_hashes_and_minima_of_runs():
    values = np.random.default_rng(4).integers(0, 6, 300).astype(np.uint64)
    for size in (1, 2, 3, 25, 50):
        runs = [tuple(values[i : i + size].tolist()) for i in range(len(values) - size + 1)]
        hashes = repeats.run_hashes(values, size).tolist()
        assert len(hashes) == len(runs) and len(set(zip(runs, hashes))) == len(set(runs)) == len(set(hashes))
        last = [i + size - 1 - int(np.argmin(values[i : i + size][::-1])) for i in range(len(runs))]
        assert repeats.last_minima(values, size).tolist() == last
    assert len(repeats.run_hashes(values[:3], 25)) == len(repeats.last_minima(values[:3], 25)) == 0


def test_offsets_of_words():
    texts = ["", " \t", "É  b\n😀c ", "x"]
    words = repeats.Words(texts)
    found = [[t[a:b] for a, b in zip(*(x.tolist() for x in words.of(i)[1:]))] for i, t in enumerate(texts)]
    assert found == [[], [], ["É", "b", "😀c"], ["x"]]
    assert words.of(2)[0][0] == repeats.Words(["é"]).hashes[0]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    assert differences(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLES[name]) in ([], ["no rows"])


def brute_top(rows, queries, k):
    out = []
    for name, vector in queries:
        own = [int(np.floor(np.float64(x) * 1024)) for x in vector]
        scored = [
            (-sum(a * int(np.floor(np.float64(x) * 1024)) for a, x in zip(own, other, strict=True)), i)
            for i, other in rows
            if i != name and len(other) == len(own)
        ]
        out += [(name, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def top_rows(spark, rows, queries, **more):
    schema = "vec_id long, embedding array<double>, query long, rank int"
    table = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], schema).repartition(5)
    asked = spark.createDataFrame([(i, v, 0, 0) for i, v in queries], schema)
    return sorted(tuple(r) for r in exact_top_k(table, asked, **more).collect())


def test_top_k_with_many_ties(spark):
    random.seed(1)
    rows = [(i, [1.0, 0.5, -0.25]) for i in range(0, 900, 2)] + [(i, [random.gauss(0, 1) for _ in range(3)]) for i in range(1, 900, 2)]
    random.shuffle(rows)
    queries = [r for r in rows if r[0] % 100 < 2]
    assert top_rows(spark, rows, queries) == brute_top(rows, queries, 10)
    assert top_rows(spark, rows, queries[:5], k=3, block=2) == brute_top(rows, queries[:5], 3)


def test_top_k_of_awkward_rows(spark):
    good = [(1, [1.0, 2.0]), (2, [0.5, 0.5]), (-3, [0.0, 0.0]), (7, [1.5]), (8, [-2.0])]
    bad = [(None, [1.0, 1.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0])]
    asked = good[:2] + bad + [(99, [1.0, 1.0]), (1, [1.0, 2.0])]
    assert top_rows(spark, good + bad, asked) == brute_top(good, good[:2] + [(99, [1.0, 1.0])], 10)
    assert top_rows(spark, [], asked) == [] and top_rows(spark, good, []) == []


def test_top_k_of_huge_components_is_exact_or_the_nearest_long(spark):
    rows = [(1, [2.0**40, 1.0]), (2, [-(2.0**40), 3.0]), (3, [1.0, 1.0])]
    found = {(r[0], r[2]): r[3] for r in top_rows(spark, rows, rows)}
    assert found[1, 2] == -(2**63) and found[3, 1] == 2**20 * (2**40 + 1)
