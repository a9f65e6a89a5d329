from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm import plain
from llm.plain import AWKWARD, SENTENCE, awkward

from tallyguard.llm.simhash import SEGMENTS, fingerprint, links, near_duplicates, pivot_rows, stars
from tallyguard.llm.suffixes import Index, benchmark_overlap, search, words_of

ITEMS = [
    ("b", SENTENCE),
    ("a", "one"),
    ("c", None),
    ("d", ""),
    ("e", "zeta, ETA; theta"),
    ("f", SENTENCE),
    (None, "Two words"),
    ("g", " ".join(f"word{i}" for i in range(400, 440))),
]


def overlap_rows(spark, docs, items, **more):
    table = spark.createDataFrame(items, "item_id string, text string")
    found = benchmark_overlap(awkward(spark, docs).coalesce(1), table, **more).collect()
    return [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found], found


def test_overlap_equals_brute_force_in_one_block_and_in_many(spark):
    named = [i for i in ITEMS if i[0] is not None]
    wanted = plain.overlap(AWKWARD, named)
    rows, found = overlap_rows(spark, AWKWARD, ITEMS)
    assert rows == wanted
    assert overlap_rows(spark, AWKWARD, ITEMS, block_bytes=100)[0] == wanted
    whole = next(r for r in found if r.doc_id == 6)
    assert (whole.longest_match, whole.longest_start, whole.items) == (19, 0, ["b", "e", "f"])


def test_overlap_of_empty_tables(spark):
    assert overlap_rows(spark, [], ITEMS)[0] == []
    assert all(r[1:3] == (0, 0) and not r[4] for r in overlap_rows(spark, AWKWARD, [])[0])


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.lists(st.sampled_from("abc"), max_size=12), max_size=6),
    st.lists(st.lists(st.sampled_from("abcd"), max_size=30), max_size=6),
)
def test_search_on_small_alphabets(items, docs):
    index = Index([(str(i), " ".join(x).encode()) for i, x in enumerate(items)], window=3)
    found = search([index.numbers(words_of(" ".join(d).encode())) for d in docs], index)
    at = 0
    for d, names in zip(docs, found.items, strict=True):
        marks, wanted = [False] * len(d), set()
        for i, x in enumerate(items):
            size = min(3, len(x))
            for w in {tuple(x[j : j + size]) for j in range(len(x) - size + 1)} if x else ():
                for j in range(len(d) - size + 1):
                    if tuple(d[j : j + size]) == w:
                        wanted.add(str(i))
                        marks[j : j + size] = [True] * size
        assert names == wanted
        assert found.marks[at : at + len(d)].tolist() == marks
        at += len(d) + 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["A", "b", "é", "\x0b", "\x1c", "\xa0", "word", "12", "日"]), max_size=9), st.sampled_from([" ", "\n", "  ", "\t"]))
def test_fingerprint(parts, space):
    text = space.join(parts)
    assert fingerprint(text.encode()) == plain.simhash(text)


def test_pivot_tables_bring_all_near_pairs_together():
    random.seed(3)
    base = random.getrandbits(64)
    others = [base ^ (1 << a) ^ (1 << b) for a in range(0, 64, 5) for b in range(0, 64, 7)]
    prints = np.array([base, *others], dtype=np.uint64)
    keys = [key for _, key in pivot_rows(prints, 2)]
    assert len(keys) == SEGMENTS * (SEGMENTS - 1) // 2
    assert all(any(k[0] == k[i] for k in keys) for i in range(1, len(prints)))


def test_links_are_a_spanning_forest():
    random.seed(5)
    prints = sorted({random.getrandbits(64) for _ in range(50)} | {x for k in range(40) for x in (k, k << 20)})
    signed = np.array(prints, dtype=np.uint64).view(np.int64)
    own = links(signed, 2)
    parent = list(range(len(prints)))
    for a, b in own:
        assert (prints[a] ^ prints[b]).bit_count() <= 2
        old, new = parent[b], parent[a]
        assert old != new
        parent = [new if p == old else p for p in parent]
    wanted = plain.components(prints)
    assert len(set(zip(parent, wanted, strict=True))) == len(set(wanted)) == len(set(parent))


def test_stars_of_a_long_chain_and_a_hub(spark):
    edges = [(i + 1, i) for i in range(60)] + [(1000 + i, 999) for i in range(200)]
    rows = stars(spark.createDataFrame(edges, "u long, v long")).collect()
    roots = {r.node: r.root for r in rows}
    assert roots == {i: 0 for i in range(1, 61)} | {1000 + i: 999 for i in range(200)}


def near_rows(spark, docs):
    return [(r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(awkward(spark, docs)).collect()]


def wanted_rows(docs):
    prints = [plain.simhash(t) for _, t in docs]
    roots = plain.components(prints)
    least = {}
    for (name, _), root in zip(docs, roots, strict=True):
        if name is not None:
            least[root] = min(name, least.get(root, name))
    return [(n, f"{p:016x}", least.get(r)) for (n, _), p, r in zip(docs, prints, roots, strict=True)]


def test_near_duplicates_equal_brute_force(spark):
    own = " ".join(f"w{i * i % 991}" for i in range(400))
    docs = AWKWARD + [(100 + i, own.replace("w0", f"v{i}", 1)) for i in range(30)] + [(200 + i, own) for i in range(40)]
    key = lambda r: (str(r[0]), r[1], str(r[2]))
    assert sorted(near_rows(spark, docs), key=key) == sorted(wanted_rows(docs), key=key)
    assert near_rows(spark, []) == []


def test_near_duplicates_of_stored_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted(near_rows(spark, docs)) == sorted(wanted_rows(docs))
