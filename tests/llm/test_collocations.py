from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from compare import differences
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyguard.llm import collocations as col

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_pieces(text):
    for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(A_Z)):
        yield re.findall("[^\x20\x09]+", piece)


def plain_counts(rows, most):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for words in plain_pieces(text):
            totals[lang] += len(words)
            for size in range(1, most + 1):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    return counts, totals


def plain_collocations(rows, most=3, least=10, per_lang=2000, covered=50):
    counts, totals = plain_counts(rows, most)
    out = []
    for lang, f in counts.items():
        candidates = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        cover = Counter()
        for p, n in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    cover[p[i : i + size]] = max(cover[p[i : i + size]], n)
        found = []
        for p, a in candidates.items():
            cuts = [(10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            if 100 * cover[p] < covered * a or p not in cover:
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:per_lang], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


SCHEMA = "text string, lang string"
NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def found(spark, rows, schema=SCHEMA, **options):
    df = col.collocations(spark.createDataFrame(rows, schema).repartition(3), **options)
    assert df.columns == NAMES
    return sorted(tuple(r) for r in df.collect())


def corpus(n, seed, words=30):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["É", "é", "THE", "the", "x y", "\x00", "n m"]
    rows = []
    for _ in range(n):
        text = ""
        for _ in range(rng.randint(0, 40)):
            text += rng.choice(vocabulary) if rng.random() < 0.7 else "New york city"
            text += rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "; "])
        rows.append((text, rng.choice(["en", "en", "en", "fr", None, ""])))
    return rows


AWKWARD = [(None, "en"), ("", "en"), ("   \t ", None), (" . , ;", "de"), ("one", "de"), ("a b " * 300, "rep")]


def test_collocations_equal_brute_force(spark):
    rows = corpus(300, 1) + AWKWARD + [("same row here", "en")] * 200
    assert found(spark, rows) == plain_collocations(rows)


def test_a_small_sample_needs_more_passes(spark, monkeypatch):
    passes = []
    counting = col.count_phrases

    def counted(*args):
        passes.append(args)
        return counting(*args)

    monkeypatch.setattr(col, "count_phrases", counted)
    rows = corpus(400, 2, words=60) + AWKWARD
    assert found(spark, rows, sample_bytes=300) == plain_collocations(rows)
    assert len(passes) > 2
    passes.clear()
    assert found(spark, rows, sample_bytes=0) == plain_collocations(rows)
    # Nothing proposed: words, then pairs, then threes, after the pass over an empty sample.
    assert len(passes) == 4
    passes.clear()
    assert found(spark, rows) == plain_collocations(rows)
    assert len(passes) == 2


def test_full_filters_lose_nothing(spark):
    rows = corpus(300, 3, words=60)
    assert found(spark, rows, sample_bytes=300, filter_bits=7) == plain_collocations(rows)


def test_longer_phrases_other_limits(spark):
    rows = corpus(200, 4)
    options = dict(most_words=4, least_count=5, per_lang=25, covered=80)
    assert found(spark, rows, **options) == plain_collocations(rows, 4, 5, 25, 80)


def test_no_rows_and_clashing_columns(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, None)]) == []
    rows = corpus(60, 5)
    more = [(*r, "x", 1, 2.0, "k") for r in rows]
    schema = f"{SCHEMA}, phrase string, words int, n double, key string"
    assert found(spark, more, schema) == plain_collocations(rows)


def test_without_languages(spark):
    rows = [(t, None) for t, _ in corpus(100, 6)]
    assert found(spark, rows, lang_col=None) == plain_collocations(rows)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \t.,\n\r", max_size=60), st.integers(1, 9), st.integers(1, 4))
def test_parts_of_a_long_text_count_like_the_whole(text, size, most):
    filters = None
    whole, parts = Counter(), Counter()
    for words in plain_pieces(text):
        for n in range(1, most + 1):
            whole.update(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    chunk = [("en", part, rest) for part, rest in col.parts_of(text, most, size)]
    for length, _, phrases, counts in col._count_chunk(chunk, most, filters, None):
        for kind, phrase, count in zip(length.to_pylist(), phrases.to_pylist(), counts.to_pylist()):
            if kind:
                parts[phrase] += count
    assert parts == whole


def test_hashes_agree_between_filter_and_count(spark):
    phrases = spark.createDataFrame([("en", "new york"), ("fr", "new york"), ("en", "é")], "lang string, phrase string")
    holds = col.build_filter(phrases)
    sure = col.np.array([col.phrase_hash(*p) for p in phrases.collect()], dtype=col.np.uint64)
    assert holds.holds(sure).all()
    others = col.np.array([col.phrase_hash("en", f"york {i}") for i in range(1000)], dtype=col.np.uint64)
    assert holds.holds(others).sum() == 0


@pytest.mark.parametrize("a, left, right", [(10**13 + 7, 10**13 + 11, 10**13 + 9), (99_999_999_999_999,) * 3, (10, 10**14 - 1, 10)])
def test_scores_are_exact(spark, a, left, right):
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    score = df.select(col._score(*(df[c] for c in "alr"))).first()[0]
    assert score == 10**6 * a * a // (left * right)


def test_sql_says_the_same(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate(corpus(200, 7) + AWKWARD)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    df = spark.createDataFrame(rows, f"doc_id long, {SCHEMA}")
    assert differences(col.collocations(df), con, col.oracle()) == []


@pytest.mark.parametrize("n_words", [9, 1 << 30])
def test_phrases_are_told_apart_with_and_without_room_in_a_number(n_words):
    rng = np.random.default_rng(3)
    ids, of_lang = rng.integers(0, 9, 400), np.repeat([0, 1], 200)
    at = np.arange(198)
    at = np.concatenate([at, at + 200])
    (lang, *parts), counts = col._alike(at, 3, ids, of_lang, n_words)
    found = dict(zip(zip(lang.tolist(), *(p.tolist() for p in parts)), counts.tolist()))
    assert found == Counter((int(of_lang[i]), *ids[i : i + 3].tolist()) for i in at)
