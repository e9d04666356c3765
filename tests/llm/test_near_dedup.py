"""Near-dedup against brute force, and its parts."""

from __future__ import annotations

import re

import numpy as np
import pytest

from tarnflow.llm import graph, neardup

WORD = re.compile("[^\x20\t-\r]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """For each row the smallest doc_id reachable, by all pairs of rows that share a shingle; rows that share a doc_id are linked too."""
    sets, root, holders, ids = [brute_set(r.text) for r in rows], list(range(len(rows))), {}, {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        near = {j for x in s for j in holders.get(x, ())}
        near = {j for j in near if 100 * len(s & sets[j]) >= 75 * len(s | sets[j])}
        if s and rows[i].doc_id is not None:
            near.add(ids.setdefault(rows[i].doc_id, i))
        for j in near:
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
        for x in s:
            holders.setdefault(x, []).append(i)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[find(i)] = min(r.doc_id, least.get(find(i), r.doc_id))
    return [least.get(find(i)) for i in range(len(rows))]


def agree(df):
    rows = df.collect()
    got = neardup.linked(df).collect()
    want = [(-1 if r.doc_id is None else r.doc_id, len(brute_set(r.text)), c, r.doc_id == c) for r, c in zip(rows, brute(rows), strict=True)]
    assert sorted(((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("which", ["odd", "empty", "corpus"])
def test_components_are_those_of_all_pairs(which, request):
    agree(request.getfixturevalue(which))


def test_a_chain_of_edits_and_a_shared_passage(spark, rng):
    """Each text differs a little from the last, so the ends of the chain aren't alike; others share only a passage."""
    words = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(60):
        words[rng.randrange(120)] = f"x{k}"
        rows.append((k, " ".join(words)))
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [(100 + k, passage + " " + " ".join(f"q{k}_{j}" for j in range(30))) for k in range(60)]
    agree(spark.createDataFrame(rows, "doc_id long, text string"))


def edited(words, rng, edits):
    out = list(words)
    for k in rng.sample(range(len(out)), edits):
        out[k] = f"e{rng.getrandbits(60)}"
    return " ".join(out)


@pytest.mark.parametrize("small", [2, 32])
def test_many_drifting_copies(small, spark, rng, monkeypatch):
    """Copies with few edits are one group, those with more are apart from it and from one another, though all meet in buckets."""
    monkeypatch.setattr(neardup, "SMALL", small)
    words = [f"w{k}" for k in range(150)]
    rows = [(k, edited(words, rng, rng.randint(0, 9))) for k in range(240)]
    agree(spark.createDataFrame(rows, "doc_id long, text string"))


def test_all_pairs_of_a_thousand(spark):
    agree(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))


@pytest.mark.parametrize("flip", [False, True])
def test_repeated_ids_with_other_texts(flip, spark):
    """Row order doesn't matter, and no link of either text is lost."""
    one, two = [f"a{k}" for k in range(60)], [f"b{k}" for k in range(60)]
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, " ".join([*one[:-1], "x"])), (3, " ".join([*two[:-1], "y"])), (None, " ".join([*two[:-1], "z"])), (None, "alone with no id but five words"), (1, " ")]
    df = spark.createDataFrame(rows[::-1] if flip else rows, "doc_id long, text string").coalesce(1)
    agree(df)
    assert {(r.doc_id, r.component_id) for r in neardup.linked(df).collect()} == {(1, 1), (2, 1), (3, 1), (None, 1), (None, None)}
    kept = neardup.deduplicated(df).collect()
    assert sorted((r.doc_id or 0, r.text.strip()[:1]) for r in kept) in ([(0, "a"), (1, ""), (1, "a")], [(0, "a"), (1, ""), (1, "b")])


def test_links_near_the_threshold_are_found(rng):
    """Of 3,000 pairs of 75 to 80 percent similarity, those that share no bucket or fail a bit test."""
    lost = unlike = rough = 0
    for _ in range(60):
        sets = []
        for _ in range(50):
            n = rng.choice([16, 80, 400])
            shared = rng.randint(-(-6 * n // 7), int(n * 8 / 9))
            base = [rng.getrandbits(64) for _ in range(2 * n - shared)]
            sets += [np.unique(np.array(base[:n], np.uint64)), np.unique(np.array(base[n - shared :], np.uint64))]
        sketch = neardup.sketches(sets, neardup.BANDS * neardup.ROWS)
        bands, bits = neardup.band_hashes(sketch, neardup.BANDS, neardup.ROWS), neardup.bit_rows(sketch)
        lost += int((~(bands[::2] == bands[1::2]).any(1)).sum())
        unlike += int((np.bitwise_count((bits[::2] ^ bits[1::2]).view(np.uint64)).sum(1) > neardup.most_unlike(sketch.shape[1], 75)).sum())
    fine = neardup.bit_rows(neardup.sketches(sets, neardup.FINE))
    differ = np.bitwise_count((fine[::2] ^ fine[1::2]).view(np.uint64))
    rough = int((differ[:, :8].sum(1) > neardup.most_unlike(512, 75)).sum() + (differ.sum(1) > neardup.most_unlike(neardup.FINE, 75)).sum())
    assert lost + unlike + rough == 0


@pytest.mark.parametrize("which", ["odd", "empty", "corpus"])
def test_dedup_keeps_the_smallest_of_each_group(which, request):
    df = request.getfixturevalue(which)
    kept = neardup.deduplicated(df)
    assert kept.columns == df.columns
    rows = df.collect()
    groups = {}
    for r, c in zip(rows, brute(rows), strict=True):
        if brute_set(r.text):
            groups.setdefault(("id", c) if c is not None else r.text, []).append(r)
    want = [min(("" if r.doc_id is None else f"{r.doc_id:09}") for r in g) for g in groups.values()]
    got = kept.collect()
    assert sorted("" if r.doc_id is None else f"{r.doc_id:09}" for r in got if brute_set(r.text)) == sorted(want)
    assert sorted(repr(r) for r in got if not brute_set(r.text)) == sorted(repr(r) for r in rows if not brute_set(r.text))


def test_words_and_shingles():
    for text in ("", " ", "A b\x0bC\x0cd", "É é 日本", "x" * 9000, "a b c d e f", "\x1f \x85 \xa0", "one two three four five six one two three four five six"):
        assert len(neardup.word_hashes(text.encode())) == len(WORD.findall(text))
        assert len(neardup.shingles(text)) == len(brute_set(text))
    assert neardup.shingles("A B c d E").tolist() == neardup.shingles("a b C D e").tolist()
    assert neardup.shingles(None).size == 0


def test_sketches_estimate_similarity(rng):
    size = 560
    for n, shared in ((1, 1), (3, 2), (50, 40), (2000, 1500)):
        a = np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64))
        b = np.unique(np.concatenate([a[:shared], np.array([rng.getrandbits(64) for _ in range(n - shared)], np.uint64)]))
        one, other = neardup.sketches([a, b], size)
        assert (one != neardup._EMPTY).all()
        likeness = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((one == other).mean() - likeness) < 0.12
    assert (neardup.sketches([a], size)[0] == one).all()


def test_components(spark, rng):
    edges = [(k, k + 1) for k in range(0, 200) if k % 50] + [(1000, k) for k in range(1001, 1200)] + [(5, 5), (3000, 2999), (2999, 3000)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[49] == 1 and got[51 + 10] == 51 and got[1150] == 1000 and got[3000] == 2999 and all(got[k] == (k // 50) * 50 + 1 for k in range(51, 150) if k % 50)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_more_edges(spark, rng):
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    got = graph.extended(graph.components(frame(edges[:120])), frame(edges[120:]))
    want = {r.node: r.root for r in graph.components(frame(edges)).collect()}
    assert {r.node: r.root for r in got.collect()} == want and graph.extended(graph.components(frame(edges)), frame([])).count() == len(want)


def test_texts_are_dropped_by_a_shuffled_join(corpus):
    plan = neardup.deduplicated(corpus)._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan


def test_long_texts_are_verified_some_at_a_time():
    """A batch's texts are not all made Python's at once: a batch may hold thousands of long ones."""
    import tracemalloc

    import pyarrow as pa

    hub, other, rows = "a b c d e " + "x" * 20_000, "f g h i j " + "y" * 20_000, 1000
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string()]
    columns = [[7] * (rows + 1), [0] * (rows + 1), [None, *range(8, 8 + rows)], [hub, *[hub, other] * (rows // 2)]]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["b", "_deal", "a", "text"])
    tracemalloc.start()
    try:
        (found,) = neardup._verifier(5, 75)(iter([batch]))
        assert tracemalloc.get_traced_memory()[1] < 12_000_000
    finally:
        tracemalloc.stop()
    assert found.column(0).to_pylist() == list(range(8, 8 + rows, 2)) and set(found.column(1).to_pylist()) == {7}


def test_a_large_bucket_is_dealt_to_tasks(spark, rng, monkeypatch):
    """Members of a large bucket meet deal by deal, each pair once: no key of the join holds the whole bucket."""
    monkeypatch.setattr(neardup, "SMALL", 2)
    monkeypatch.setattr(neardup, "DEAL", 16)
    joined = []
    real = neardup.stored

    def stored(df, name, *codec):
        if name == "pairs":
            joined.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, name, *codec)

    monkeypatch.setattr(neardup, "stored", stored)
    words = [f"w{k}" for k in range(150)]
    agree(spark.createDataFrame([(k, edited(words, rng, rng.randint(0, 12))) for k in range(160)], "doc_id long, text string"))
    assert any("(i#" in plan and "(j#" in plan for plan in joined)


def test_few_tasks_for_few_edges(spark):
    """A round's joins shuffle each side once: 17 stages in all, 35 where trees were copied by salt and edges made distinct first."""
    edges = [(0, k) for k in range(1, 400)] + [(k, k + 1000) for k in range(1, 200)]
    frame = spark.createDataFrame(edges, "a long, b long")
    tracker, group = spark.sparkContext.statusTracker(), "few-edges"
    spark.sparkContext.setJobGroup(group, group)
    try:
        got = {r.node: r.root for r in graph.components(frame).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    assert set(got.values()) == {0} and len(got) == 599
    assert len(stages) < 25
