from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm import plain
from llm.plain import AWKWARD, awkward

from tallyguard.llm import personal, toxicity
from tallyguard.llm.toxicity import FuzzyTrie

PARTS = ["a", "@", ".", "b.c", "1", "255", "256", "0", "-", " ", "+", "(", ")", "4111111111111111", "10.0.0.1", "x@y.z", "+12 345 678 9", "%", "é"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=16))
def test_base_spans(parts):
    text = "".join(parts)
    assert personal.base_spans(text) == plain.base_spans(text)


@pytest.mark.parametrize("text", ["1" * 50_000, "a" * 50_000 + "@", "+1" + " " * 50_000, "1." * 30_000, "a@" * 20_000, "1 " * 30_000])
def test_long_runs_take_linear_time(text):
    assert personal.candidates(text) is not None


def joined(spans):
    return ",".join(f"{plain.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_personal_data(spark):
    rows = personal.personal_data(awkward(spark).coalesce(1)).collect()
    for (name, text), r in zip(AWKWARD, rows, strict=True):
        base = plain.base_spans(text)
        assert r.doc_id == name
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert set(joined(base).split(",")) <= set(r.spans.split(","))
    assert personal.personal_data(awkward(spark, [])).count() == 0


def test_votes_survive_the_code():
    for kind in range(4):
        for votes in ((-1, 0, 1, 1), (1, 1, -1, 0), (0, 0, 0, 0)):
            for length in (3, 9, 17, 90):
                code = personal.code_of(kind, True, votes, length)
                assert personal.parts_of(code) == (kind, True, votes, min(3, length // 8))


def test_estimate_finds_the_reliable_labelers():
    random = np.random.default_rng(1)
    truth = random.random(4000) < 0.4
    good = np.where(random.random(4000) < 0.95, truth, ~truth) * 2 - 1
    fair = np.where(random.random(4000) < 0.85, truth, ~truth) * 2 - 1
    noise = (random.random(4000) < 0.5) * 2 - 1
    votes, counts = np.unique(np.stack([good, fair, noise, good * 0], axis=1), axis=0, return_counts=True)
    share, tables, _ = personal.estimate(votes, counts.astype(float))
    assert abs(share - 0.4) < 0.1
    assert tables[0, 1, 2] > 0.85
    assert abs(tables[2, 1, 2] - tables[2, 0, 2]) < 0.15


def test_a_candidate_is_added_on_good_votes_and_base_spans_stay(spark):
    good = [(i, f"please call my phone (212) 555-01{i:02d} today") for i in range(60)]
    rows = personal.personal_data(awkward(spark, good)).collect()
    assert all(r.n_phone == 0 and r.spans == "phone:21:35" for r in rows)


def test_masking_keeps_all_other_columns(spark):
    docs = awkward(spark)
    model = personal.train_on(personal.find_candidates(docs))
    masked = personal.mask_personal_data(docs, model)
    assert masked.schema == docs.schema
    rows = {r.doc_id: r for r in masked.collect()}
    assert rows[12].text.startswith("Mail [EMAIL] or [IP], card [CARD] now, tel [PHONE].")
    assert rows[6].text == dict(AWKWARD)[6]
    assert masked.count() == len(AWKWARD)


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abcx", max_size=8), st.lists(st.text("abc", min_size=5, max_size=7), min_size=1, max_size=5, unique=True))
def test_the_automaton_accepts_what_is_one_edit_away(word, terms):
    trie = FuzzyTrie({t: 1.0 for t in terms}, {})
    found = trie.match(word)
    assert (found is not None) == any(edits(word, t) <= 1 for t in terms)
    if word in terms:
        assert found == (word, 1.0)


def test_stems_short_terms_and_common_words():
    trie = FuzzyTrie({"scum": 2.0, "moron": 3.0}, {"hateful": 1.5}, frozenset(["oron"]))
    assert trie.match("scum") == ("scum", 2.0)
    assert trie.match("scam") is None
    assert trie.match("morron") == ("moron", 1.5)
    assert trie.match("oron") is None
    assert trie.match("hatefully") == ("hateful", 1.5)
    assert trie.match("hateful") is None
    assert trie.match("") is None


def test_a_quotation_weighs_less_than_abuse():
    hits = toxicity._Hits(FuzzyTrie({"idiot": 4.0}, {}))
    plainly = toxicity.features("you are an idiot and nothing else", hits)
    quoted = toxicity.features('they wrote "you are an idiot" and left', hits)
    reported = toxicity.features("he said idiot and left", hits)
    assert plainly[0] > 3 * quoted[0] and plainly[0] > 3 * reported[0]
    assert quoted[3] > 0 == plainly[3]


def small_corpus():
    clean = [f"calm words number{i} about weather and bread" for i in range(300)]
    toxic = [f"you are a total {w} and a fool{i}" for i, w in enumerate(["moronic", "stupidly", "uselessly"] * 40)]
    texts = clean + toxic
    docs = [(i, t) for i, t in enumerate(texts)]
    labels = [(i, int(i >= len(clean))) for i in range(len(texts)) if i % 3]
    return docs, labels


def test_scores(spark):
    docs, labels = small_corpus()
    odd = [(None, None), (10_000, ""), (10_001, "you moronlc"), (10_002, "x" * 40_000), (0, "calm words")]
    table = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    rows = toxicity.score(awkward(spark, docs + odd), toxicity.train(awkward(spark, docs + odd), table)).collect()
    assert len(rows) == len(docs) + len(odd)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    known = {i: toxic for i, toxic in enumerate(int(i >= 300) for i in range(len(docs)))}
    unseen = [r for r in rows if r.doc_id in known and r.held_out and r.doc_id > 0]
    assert sum(r.predicted == known[r.doc_id] for r in unseen) >= 0.95 * len(unseen)


def test_held_out_labels_are_not_learned_from(spark):
    docs, labels = small_corpus()
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    scores = [
        sorted(
            (r.doc_id, r.score)
            for r in toxicity.score(
                awkward(spark, docs), toxicity.train(awkward(spark, docs), spark.createDataFrame(x, "doc_id long, toxic int"))
            ).collect()
        )
        for x in (labels, turned)
    ]
    assert scores[0] == scores[1]


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(1, 1)]])
def test_too_few_labels_give_a_constant(spark, labels):
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    docs = awkward(spark)
    rows = toxicity.score(docs, toxicity.train(docs, table)).collect()
    assert len({r.score for r in rows}) == 1
    model = toxicity.train(awkward(spark, []), table)
    assert toxicity.score(awkward(spark, []), model).count() == 0


def test_scores_of_stored_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = toxicity.score(docs, toxicity.train(docs, labels)).where("held_out").join(labels, "doc_id").collect()
    right = sum(r.predicted == r.toxic for r in rows)
    caught = sum(r.predicted for r in rows if r.toxic)
    assert right >= 0.96 * len(rows)
    assert caught >= 0.8 * sum(r.toxic for r in rows)
