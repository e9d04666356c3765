"""Ranked search against a score for every pair of item and document."""

from __future__ import annotations

import math
import re
import tracemalloc
from collections import Counter

import pytest

from tarnflow.llm import lexical


def terms_of(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def told(docs, items, k=10):
    """(item, rank, doc, score): docs and items are lists of (id, text); ties of missing ids last, then as the rows come."""
    bags = [(i, Counter(terms_of(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, length = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for t, f in df.items()}
    out = []
    for item, text in items:
        asked = Counter(terms_of(text))
        scores = []
        for at, (i, b, n) in enumerate(bags):
            m = 25 + (75 * n * n_docs) // length
            s = sum(c * w[t] * ((10**9 * b[t]) // (1000 * b[t] + 8 * m)) for t, c in asked.items() if t in b)
            if s > 0:
                scores.append((-s, i is None, i or 0, at, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def found(docs_df, items_df, k=10):
    index = lexical.indexed(docs_df, k=k)
    rows = sorted((tuple(r) for r in lexical.search(index, items_df).select("item", "rank", "doc", "score").collect()), key=repr)
    index.drop()
    return rows


def pairs(spark, rows, name):
    return spark.createDataFrame(rows, f"{name} long, text string")


def test_corpus(spark, corpus, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert found(corpus, items) == told([(r.doc_id, r.text) for r in corpus.collect()], [(r.item_id, r.text) for r in items.collect()])


@pytest.mark.parametrize("k", [1, 3, 10])
def test_small_vocabulary(spark, rng, monkeypatch, k):
    """Few words, so that all documents tie or share terms; blocks of some hundred bytes; an item of every word and of one word many times."""
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 400)
    vocabulary = ["Aa", "b", "é", "É", "日本", "x9", "zz", "w1", "w2", "w3", "w4", "w5"]
    weights = [2 ** -i for i in range(len(vocabulary))]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 25))) + rng.choice(["", "!", "-"])) for i in range(150)]
    docs += [(3, docs[3][1]), (3, docs[3][1]), (1000, "w5"), (1001, None), (1002, ""), (1003, "?!")]
    items = [(i, "/".join(rng.choices(vocabulary, k=rng.randint(1, 8)))) for i in range(15)] + [(50, " ".join(vocabulary * 3)), (51, "w5 " * 40), (52, None), (53, "unknown words"), (54, ""), (55, "Aa")]
    assert found(pairs(spark, docs, "doc_id").repartition(3), pairs(spark, items, "item_id"), k) == told(docs, items, k)


def test_repeated_and_missing_ids(spark):
    docs = [(None, "alpha beta"), (5, "alpha beta"), (5, "alpha beta"), (2, "alpha beta"), (7, "gamma")]
    items = [(1, "alpha"), (1, "gamma"), (None, "beta")]
    assert found(pairs(spark, docs, "doc_id").coalesce(1), pairs(spark, items, "item_id")) == told(docs, items)


def test_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    items = [(1, "same text word"), (2, "ñ é 日本 x two"), (3, "no id")]
    assert found(odd.coalesce(1), pairs(spark, items, "item_id")) == told(rows, items)
    assert found(empty, pairs(spark, items, "item_id")) == []
    assert found(odd, pairs(spark, [], "item_id")) == []


def test_a_word_of_all_documents_and_items(spark):
    """w is 0 or little for it; documents are cut short by the others' bounds, and none is lost."""
    docs = [(i, "the " * (1 + i % 5) + ("rare" if i % 97 == 0 else f"own{i}")) for i in range(600)]
    items = [(i, f"the rare own{i}") for i in range(0, 600, 60)] + [(999, "the")]
    assert found(pairs(spark, docs, "doc_id").repartition(4), pairs(spark, items, "item_id")) == told(docs, items)


def test_block_in_slices(monkeypatch, rng):
    """Short words need many times their bytes while they are numbered, so a block's are numbered by slices, which gives the same lists."""
    vocabulary = [chr(97 + i) for i in range(26)] + ["É", "日本", "x9"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))).encode() for _ in range(100)] + [b"?!", b"w " * 300, b"last"]
    monkeypatch.setattr(lexical, "SLICE_BYTES", 10**9, raising=False)
    whole, some = lexical.block_lists(texts, range(7, 7 + len(texts)))
    monkeypatch.setattr(lexical, "SLICE_BYTES", 200)
    sliced, again = lexical.block_lists(texts, range(7, 7 + len(texts)))
    assert sliced.to_pylist() == whole.to_pylist() and again.tolist() == some.tolist()
    monkeypatch.undo()
    texts = [b"a b c d e f g h " * 500] * 1500
    tracemalloc.start()
    lexical.block_lists(texts, range(len(texts)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 15 * sum(map(len, texts))
