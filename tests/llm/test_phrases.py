"""Collocations against counts by hand over every piece."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from tarnflow.llm import phrases


def told(rows, top=2000, least=10, share=50):
    """The contract's rows by brute force."""
    counts: dict[str, Counter] = defaultdict(Counter)
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^ \t]+", piece)
            for k in (1, 2, 3):
                counts["und" if lang is None else lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        dropped = {part for p, c in candidates.items() if len(p) == 3 for part in (p[:2], p[1:]) if 100 * c >= share * f[part]}
        found = []
        for p, a in candidates.items():
            if p not in dropped:
                score, _, left, right = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -score) for i, (score, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def same(df, rows, **given):
    assert sorted(tuple(r) for r in phrases.collocations(df, **given).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == told(rows, **given)


def test_corpus(corpus):
    same(corpus, [(r.text, r.lang) for r in corpus.collect()])


def test_small_vocabulary(spark, rng, monkeypatch):
    """Dense phrases, overlaps, all separators, several blocks a task."""
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 900)
    texts = ["".join(rng.choice(["a", "B", "b", "é", "日", "É", "c'd"]) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "\x0b", "\xa0"]) for _ in range(rng.randint(0, 120))) for _ in range(120)]
    rows = [(t, rng.choice(["x", "und", None])) for t in texts] + [("a a a a a a a a a a a a", "x"), (None, "x"), ("", None), ("  .. ", "y")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    same(df, rows)
    same(df, rows, top=5, least=3, share=80)


def test_odd_rows(odd, empty):
    rows = [(r.text, r.lang) for r in odd.collect()]
    same(odd, rows, least=2)
    assert phrases.collocations(empty).collect() == []


def test_counts_past_64_bits(spark):
    """f * f * 1000000 over 2**63."""
    rows = [("x y " * 40_000, "l")] * 80
    same(spark.createDataFrame(rows, "text string, lang string").repartition(4), rows)


def test_longer_phrases(spark):
    rng = random.Random(3)
    rows = [(" ".join(rng.choice("abc") for _ in range(200)), "l") for _ in range(20)]
    m = phrases.mined(spark.createDataFrame(rows, "text string, lang string"), most_words=5, least=4)
    want = Counter(tuple(w[i : i + 5]) for t, _ in rows for w in [t.split()] for i in range(len(w) - 4))
    assert sorted(r.a for r in m.levels[5].collect()) == sorted(c for c in want.values() if c >= 4)
    m.drop()
