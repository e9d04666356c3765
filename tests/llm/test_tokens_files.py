"""Ids, packing and Huffman files against the library and an exact round trip."""

from __future__ import annotations

import gc
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnflow.llm import binary, huffman, packing
from tarnflow.llm.queries import tokenizer_path
from tarnflow.llm.tokens import Words

BPE = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def words():
    return Words(BPE)


def library(words, texts):
    return [e.ids for e in words.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_ids_are_the_librarys(words):
    pick = random.Random(1)
    letters = " \n\tab'sé²½Ⅷ١_-.12日😀\xa0\u200b\u2028\x1c\x85\u0301ªʰ\0"
    texts = ["", " ", "a  b ", "x \n y", "<|endoftext|> a", "it's 'll", "\0 x"] + ["".join(pick.choice(letters) for _ in range(pick.randint(1, 30))) for _ in range(3000)]
    for _ in range(2):  # the second time from the cache
        assert [i.tolist() for i in words.encode(texts)] == library(words, texts)


def test_cache_may_start_afresh(words):
    words.words.most = 3
    texts = ["alpha beta gamma delta epsilon", "alpha beta gamma zeta eta", "theta alpha, beta"] * 3
    for t in texts:
        assert words.encode([t])[0].tolist() == library(words, [t])[0]
    words.words.most = 1_000_000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=3000), st.integers(1, 9))
def test_file_round_trip(ids, cuts):
    counts = dict(zip(*[x.tolist() for x in np.unique(np.array(ids, np.int64), return_counts=True)], strict=True)) if ids else {}
    lengths = huffman.code_lengths(counts, 401)
    parts = np.array_split(np.array(ids, np.uint32), cuts)
    keys, sizes, back = huffman.unpack_file(huffman.pack_file([None, *range(1, cuts)], parts, lengths, huffman.canonical(lengths)))
    assert back.tolist() == ids and sizes.tolist() == [len(p) for p in parts] and keys == [None, *range(1, cuts)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10**9), min_size=2, max_size=300))
def test_code_lengths(counts):
    of = dict(enumerate(counts))
    lengths = huffman.code_lengths(of, len(counts))
    assert huffman.kraft(lengths) == 1.0 and lengths.max() <= huffman.LONGEST
    cost = sum(n * int(lengths[s]) for s, n in of.items())
    assert cost >= huffman.huffman_cost(of)
    if max(lengths) < huffman.LONGEST:
        assert cost == huffman.huffman_cost(of)


def expected(words, df):
    out = []
    for r in df.collect():
        out.append((r.doc_id, [int(i) for i in words.encode([r.text or ""])[0]]))
    return out


def check(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("which", ["odd", "empty", "corpus"])
def test_files_hold_every_document_in_order(words, which, request):
    df = request.getfixturevalue(which)
    got = binary.round_trip(df, BPE).collect()
    want = sorted((-1 if k is None else k, len(i) + 1, check(i + [0])) for k, i in expected(words, df))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    rows = sorted(got, key=lambda r: r.start)
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]
    assert [-1 if r.doc_id is None else r.doc_id for r in rows] == sorted(-1 if r.doc_id is None else r.doc_id for r in rows)


@pytest.mark.parametrize("which", ["odd", "empty", "corpus"])
def test_packing_holds_every_id_once(words, which, request):
    df = request.getfixturevalue(which)
    rows = [r.asDict() for r in packing.packed(df, BPE).collect()]
    want = sorted((-1 if k is None else k, tuple(i + [1])) for k, i in expected(words, df))
    total = sum(len(i) for _, i in want)
    assert sum(r["length"] for r in rows) == total
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
        assert sum(r["length"] for r in own) <= packing.WIDTH
    pieces = {(-1 if r["doc_id"] is None else r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows}
    for k, ids in want:
        for start in range(0, len(ids), packing.WIDTH):
            part = ids[start : start + packing.WIDTH]
            assert (k, start, len(part), check(part), len(ids)) in pieces
    if which == "corpus":
        assert total / (len(by_sequence) * packing.WIDTH) > 0.95


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200), st.integers(1, 8))
def test_windows_are_bounded_and_lose_nothing(lengths, most):
    windows, closed = packing.Windows(50, most), []
    for k, n in enumerate(lengths):
        if full := windows.put((k, n), n):
            closed += packing._split(full)
        assert len(windows.rooms) <= most
    closed += windows.rest()
    assert sorted(i for w in closed for i in w) == list(enumerate(lengths))
    assert all(sum(n for _, n in w) <= 50 for w in closed)


def test_words_are_asked_for_once(words, monkeypatch):
    asked = []
    monkeypatch.setattr(words, "_pieces", lambda pieces, own=words._pieces: asked.extend(pieces) or own(pieces))
    text = "Quaxorin zuvelthe, brombitter.\nQuaxorin été² 1² x½y"
    for _ in range(3):
        assert words.encode([text, text[::-1]])[0].tolist() == library(words, [text])[0]
    assert asked.count(" brombitter") == 1 and len(asked) == len(set(asked))


def test_worker_holds_one_operators_words_at_a_time():
    from tarnflow.llm import common, language
    from tarnflow.llm.tokens import words_of

    assert words_of(BPE) is words_of(BPE) and len(common._held) == 1
    list(language._counter(iter([])))
    assert not common._held


def test_last_marks_are_looked_up_apart():
    """A word with and without marks after it is one entry of the cache; ids stay the library's, also where marks join what is before them."""
    words = Words(BPE)
    texts = ["alpha alpha, alpha. alpha; alpha?! alpha: Alpha... x9, 42.", "alpha, alpha. (alpha). it's, é, é. ... , . !? word\n. a\n, _. '. '', \"alpha\".", "!", ",", "a.", " a.", " .", ". ", "a. ", "ñ!", "日本, 日本.", "a.b, a,b.", "x.\n", "x.\ty,"]
    for text in texts:
        assert words.encode([text])[0].tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids
    assert [a.tolist() for a in words.encode(texts)] == [words.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert "alpha" in words.words.young and not {"alpha,", "alpha.", "alpha?!", "x9,", "42."} & words.words.young.keys()


def test_encoding_leaves_the_collector_as_it_was():
    words, seen = Words(BPE), []
    words._odd_in = lambda chunks: seen.append(gc.isenabled()) or []
    words.encode(["some words"])
    assert seen == [False] and gc.isenabled()
