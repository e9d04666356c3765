"""Byte-level BPE by recursive queries against the tiktoken library."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tarnflow.llm import bytepairs, queries
from tarnflow.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as file:
        tokens = bytepairs.ranks(file.read())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def plain(ids):
    return None if ids is None else np.frombuffer(bytes(ids), "<u4").tolist()


def test_ids_are_the_librarys(spark, library):
    pick = random.Random(5)
    letters = " \n\tab'stéé²½Ⅷ١_-.12日本😀\xa0​ \x1c\x85́ªʰ\0"
    texts = ["", " ", "   ", "a  b ", "<|endoftext|> a", "it's 'll", "a" * 1001, "ab" * 700, " " * 3000, "日本語" * 100, "".join(pick.choice("etaoin") for _ in range(2000))]
    texts += ["".join(pick.choice(letters) for _ in range(pick.randint(1, 40))) for _ in range(500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "k long, text string").repartition(2)
    got = {r.k: r for r in bytepairs.decoded(bytepairs.encoded(df, PATH, public_tokenizers.PATTERN), PATH).collect()}
    assert got[-1].ids is None and got[-1].decoded is None
    for i, t in enumerate(texts):
        assert plain(got[i].ids) == library.encode_ordinary(t) and bytes(got[i].decoded) == t.encode()


def test_query(spark, sf, corpus, library):
    want = {r.doc_id: library.encode_ordinary(r.text or "") for r in corpus.collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in corpus.collect()}
    rows = queries.op12_byte_bpe(spark, sf).collect()
    assert len(rows) == len(want)
    for r in rows:
        ids = want[r.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id]).hexdigest())


def test_odd_rows(odd, empty, library):
    named = odd.withColumnRenamed("shard", "ids").withColumnRenamed("size", "decoded")
    rows = bytepairs.decoded(bytepairs.encoded(named, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert sorted(map(repr, ((r.doc_id, plain(r.ids), None if r.decoded is None else bytes(r.decoded)) for r in rows))) == sorted(
        map(repr, ((r.doc_id, None if r.text is None else library.encode_ordinary(r.text), None if r.text is None else r.text.encode()) for r in odd.collect())))
    assert bytepairs.encoded(empty, PATH, public_tokenizers.PATTERN).collect() == []


def test_slices_and_a_full_cache(spark, library, monkeypatch):
    merges = bytepairs._known(open(PATH, "rb").read(), True)
    monkeypatch.setattr(merges.known, "most", 3)
    for words in ({"alphabets", "betamaxes"}, {"alphabets", "betamaxes", "gammaray"}, {"alphabets", " deltoids", " epsilonian", "zetas", " etas"}, {"th", "thetas", "iotas x"}):
        assert {w: plain(i) for w, i in merges.encoded(words).items()} == {w: [i for i in library._encode_single_piece(w)] for w in words}


def greedy(tokens, word):
    """One leftmost pair of the least rank after the other."""
    rank = {t: i for i, t in enumerate(tokens)}
    if word in rank:
        return [rank[word]]
    parts = [bytes([b]) for b in word]
    while (best := min(((rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank), default=None)) is not None:
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return [rank[p] for p in parts]


def test_vocabularies_whose_ranks_fall(rng):
    """Random vocabularies, most of which no training would give: all pairs at once only where that gives the same."""
    rises = []
    for _ in range(12):
        longer = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))).encode() for _ in range(rng.randint(3, 25))}
        tokens = [bytes([i]) for i in range(256)] + rng.sample(sorted(longer), len(longer))
        merges = bytepairs.Merges(tokens)
        rises.append(merges.rising)
        words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(60)} | {"".join(rng.choice("abc") for _ in range(400)), "ab" * 200, "a" * 301}
        assert {w: plain(i) for w, i in merges.encoded(words).items()} == {w: greedy(tokens, w.encode()) for w in words}
    assert not all(rises)


def test_files_that_are_not_ranks():
    line = base64.b64encode(b"a").decode()
    with pytest.raises(ValueError, match="single bytes"):
        bytepairs.ranks(f"{line} 0\n".encode())
    with pytest.raises(ValueError, match="0, 1, 2"):
        bytepairs.ranks(f"{line} 1\n".encode())


def test_unknown_ids_are_an_error(spark):
    from pyspark.errors import PythonException

    df = spark.createDataFrame([(bytearray(np.array([7, 60_000], "<u4").tobytes()),)], "ids binary")
    with pytest.raises(PythonException, match="not in the vocabulary"):
        bytepairs.decoded(df, PATH).collect()


def test_words_are_contracted_once(monkeypatch, library):
    with open(PATH, "rb") as file:
        merges = bytepairs.Merges(bytepairs.ranks(file.read()), True)
    asked = []
    monkeypatch.setattr(merges, "contracted", lambda words, one=True, own=merges.contracted: asked.extend(words) or own(words, one))
    for _ in range(3):
        assert plain(merges.encoded({" quaxorin"})[" quaxorin"]) == library.encode_ordinary(" quaxorin")
    assert asked == [b" quaxorin"]


def test_decoding_sorts_once(library):
    """Pieces are put in order by one sort for all documents, not by one for each; documents need not follow each other."""
    merges, pick = bytepairs.Merges([library.decode_single_token_bytes(i) for i in range(library.n_vocab)], True), np.random.default_rng(3)
    ids, owner = pick.integers(0, library.n_vocab, 60_000).astype(np.int32), pick.integers(0, 500, 60_000).astype(np.int32)
    owners, raw, ends = merges.decoded(ids, owner)
    want = {o: b"".join(library.decode_single_token_bytes(i) for i in ids[owner == o].tolist()) for o in range(500)}
    assert {o: bytes(memoryview(raw)[a:b]) for o, a, b in zip(owners.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)} == want
    asked, sql = [], merges.con.sql

    class Noted:
        def sql(self, text):
            asked.append("\n".join(row[1] for row in sql(f"explain {text}").fetchall()))
            return sql(text)

        def __getattr__(self, name):
            return getattr(con, name)

    con, merges.con = merges.con, Noted()
    merges.decoded(ids, owner)
    assert len(asked) == 1 and "order by" in asked[0].lower() and "list(" not in asked[0]
    merges.con = con
    with pytest.raises(ValueError):
        merges.decoded(np.array([0, library.n_vocab], np.int32), np.zeros(2, np.int32))
    assert merges.decoded(np.zeros(0, np.int32), np.zeros(0, np.int32))[0].tolist() == []
