from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.plain import AWKWARD, awkward, crc

from tallyguard.llm import elias_fano
from tallyguard.llm.packing import Packer, StepGroups, pack
from tallyguard.llm.token_files import TokenFile, file_bytes, read_token_files, write_token_files
from tallyguard.llm.tokens import default_tokenizer, encoder


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


PARTS = ["a", "é", " ", "  ", "\n", "\t", "'s", "'", "1", "½", "!", "日本", "😀", "\x1c", "<|endoftext|>", "İ", "\x85", "\xa0", "x.", "'ll"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12))
def test_ids_are_the_librarys(library, parts):
    text = "".join(parts)
    assert np.frombuffer(encoder(default_tokenizer()).encode(text), "<u4").tolist() == library(text)


def test_ids_of_stored_documents(spark, library):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    encode = encoder(default_tokenizer()).encode
    for row in rows:
        assert np.frombuffer(encode(row.text), "<u4").tolist() == library(row.text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**40) | st.integers(0, 300), max_size=700))
def test_elias_fano_round_trip(values):
    values.sort()
    data = elias_fano.encode(np.array(values, dtype=np.uint64))
    read = elias_fano.RisingList(data + b"after")
    assert read.all().tolist() == values
    assert [read.get(i) for i in range(0, len(values), 7)] == values[::7]
    assert read.size == len(data)


def test_elias_fano_is_small():
    values = np.cumsum(np.full(10_000, 700, dtype=np.uint64))
    assert len(elias_fano.encode(values)) * 8 / len(values) < 13


def test_file_finds_documents_by_select():
    ids = [np.arange(n, dtype="<u4").tobytes() for n in (1, 5, 2, 300)]
    data = TokenFile(file_bytes([None, -3, 4, 4], ids))
    assert len(data) == 4
    assert [data.doc_id(i) for i in range(4)] == [None, -3, 4, 4]
    assert [len(data.ids(i)) for i in range(4)] == [1, 5, 2, 300]
    assert data.ids(3).tolist() == list(range(300))


@pytest.mark.parametrize("file_ids", [50, 4_000_000])
def test_token_files(spark, library, file_ids):
    folder, manifest = write_token_files(awkward(spark), default_tokenizer(), 2, file_ids=file_ids)
    rows = sorted(read_token_files(folder, manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((i for i, _ in AWKWARD), key=lambda i: (i is not None, i or 0))
    assert rows[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    wanted = Counter((i, len(x := [*library(t), 2]), crc(x)) for i, t in AWKWARD)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == wanted


def test_token_files_of_an_empty_table(spark):
    folder, manifest = write_token_files(awkward(spark, []), default_tokenizer(), 2)
    assert read_token_files(folder, manifest).count() == 0


def check_pieces(rows, texts, library):
    sequences, whole = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length, r.tier))
        whole[r.doc_id].append(r)
    for parts in sequences.values():
        at = 0
        for offset, length, tier in sorted(parts):
            assert offset == at
            at += length
        assert at == tier and at <= 2048 and at & (at - 1) == 0
    for name, parts in whole.items():
        copies = [[*library(t), 1] for i, t in texts if i == name]
        assert sum(p.length for p in parts) == sum(map(len, copies))
        for p in parts:
            assert any(
                p.doc_tokens == len(ids) and p.ids_crc32 == crc(ids[p.start : p.start + p.length]) for ids in copies
            )
        if len(copies) == 1:
            at = 0
            for p in sorted(parts, key=lambda p: p.start):
                assert p.start == at
                at += p.length
    assert set(whole) == {i for i, _ in texts}


def test_packing(spark, library):
    check_pieces(pack(awkward(spark), default_tokenizer()).collect(), AWKWARD, library)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = pack(docs, default_tokenizer(), pool=30).collect()
    check_pieces(rows, [(r.doc_id, r.text) for r in docs.collect()], library)
    assert pack(awkward(spark, []), default_tokenizer()).count() == 0


def test_short_rests_fill_the_gaps_of_long_windows():
    packer = Packer((4, 8), pool=100)
    packer.add_document(1, b"\0" * 4 * 7)
    packer.add_document(2, b"\0" * 4 * 1)
    packer.add_document(3, b"\0" * 4 * 4)
    packer.pack(last=True)
    assert sorted((tier, sorted(p.doc_id for p in s)) for tier, s in packer.done) == [(4, [3]), (8, [1, 2])]


def test_step_groups_are_full_and_balanced():
    groups = StepGroups(tokens=8, rounds=4)
    dealt = [x for cost in (9, 1, 8, 2, 7, 3, 6, 4) for x in groups.add(4, cost, cost)] + list(groups.rest())
    steps = defaultdict(list)
    for step, cost in dealt:
        steps[step].append(cost)
    assert sorted(map(sum, steps.values())) == [10, 10, 10, 10]
