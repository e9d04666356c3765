"""Language ID, SentencePiece, URLs, fingerprints, sharding, media."""

from __future__ import annotations

import hashlib
import os
import zlib

import pytest

from tarnflow.llm import fingerprint, language, media, pieces, sharding, urls
from tarnflow.llm.queries import RULES, tokenizer_path

# --- language


def test_held_out_accuracy(corpus):
    rows = language.identified(corpus).join(corpus.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert len(out) > 20 and sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97
    assert {r.doc_id for r in out} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(odd, empty):
    rows = language.identified(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (1, 2, 3, 8))
    assert language.identified(empty).count() == 0
    again = language.predicted(odd, language.fitted(odd))
    assert set(again.columns) == {*odd.columns, "lang_pred", "n_known"}
    nothing = language.predicted(odd, language.fitted(empty)).collect()
    assert all(r.lang_pred == "und" for r in nothing)


def columns(rows):
    return tuple(list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [])


def test_unseen_words_back_off():
    model = language.Model(["a", "b"], columns([("a", "hello", 5), ("b", "world", 5)]), columns([("a", "xy", 9), ("b", "zw", 9), ("a", "x", 3), ("b", "z", 3)]))
    assert model.predict("xyxy")[0] == "a" and model.predict("zwzwzw")[0] == "b" and model.predict("Hello")[0] == "a" and model.predict("123")[0] == "und"
    assert model.predict("qqq")[1] == 0.5


def test_words_of_other_scripts_are_known(spark):
    """Combining marks belong to words, and composed and decomposed letters are the same; Turkish capitals and final sigmas too."""
    import unicodedata

    rows = [(k, text, lang) for k, (text, lang) in enumerate([("नमस्ते दुनिया यह हिन्दी है", "hi"), ("été déjà où", "fr"), ("İstanbul güzel ΣΟΦΟΣ", "tr"), ("שָׁלוֹם עוֹלָם", "he")] * 3)]
    model = language.fitted(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for _, text, lang in rows[:4]:
        for form in ("NFC", "NFD"):
            got = model.predict(unicodedata.normalize(form, text))
            assert got[0] == lang and got[2] == len(text.split())


def test_prediction_is_the_rule_told_plainly(spark, corpus):
    """Against counts and sums done by hand, whole words and n-grams of every length, on documents that the model learnt from and others."""
    import math
    import re
    from collections import Counter

    import regex

    rows = [r for r in corpus.collect() if r.text and r.lang]
    model = language.fitted(corpus.filter(~language.held_out(corpus.doc_id)))
    tokens = lambda text: regex.findall(r"[\p{L}\p{M}]+", text.lower())
    words, grams = {}, {}
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            for w in tokens(r.text):
                words.setdefault(r.lang, Counter())[w] += 1
                s = f"^{w}$"
                for n in range(1, 5):
                    for k in range(len(s) - n + 1):
                        grams.setdefault(r.lang, Counter())[s[k : k + n]] += 1
    langs = sorted(words)
    kinds = [len(set().union(*c.values())) for c in (words, grams)]
    totals = {id(c): {x: sum(c[x].values()) for x in langs} for c in (words, grams)}
    log = lambda c, lang, item, kind: math.log((c[lang][item] + 0.5) / (totals[id(c)][lang] + 0.5 * kind))
    for r in rows[:60]:
        found = tokens(r.text)
        if not found:
            continue
        scores = dict.fromkeys(langs, 0.0)
        for w in found:
            if any(w in words[x] for x in langs):
                hits = [(words, w, kinds[0])]
            else:
                s = f"^{w}$"
                ends = [next((s[e - n : e] for n in range(min(4, e), 0, -1) if any(s[e - n : e] in grams[x] for x in langs)), None) for e in range(2, len(s) + 1)]
                hits = [(grams, g, kinds[1]) for g in ends if g]
            for x in langs:
                scores[x] += sum(log(c, x, item, kind) for c, item, kind in hits) / max(1, len(hits))
        best = max(scores, key=scores.get)
        sure = 1 / sum(math.exp((v - scores[best]) / len(found) * min(20, len(found))) for v in scores.values())
        got = model.predict(r.text)
        assert got[0] == best and abs(got[1] - sure) < 1e-9
    assert re.fullmatch("[a-z]{2}", model.languages[0])


def test_rows_without_or_with_one_id_are_sampled_by_their_texts(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_DOCS", 100)
    words = ["".join(chr(97 + int(d)) for d in str(i)) + "wort" for i in range(1000)]
    for doc_id in (None, 7):
        rows = [(doc_id, f"{w} und noch eins", "de") for w in words]
        model = language.fitted(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
        taken = sum(model.predict(w)[2] for w in words)
        assert 60 < taken < 150


def test_short_texts_that_languages_share_are_accepted(spark):
    rows = [(k, "la casa", "es") for k in range(4)] + [(10 + k, "la maison", "fr") for k in range(4)] + [(20 + k, "la casa bella", "it") for k in range(4)]
    docs = spark.createDataFrame([*rows, (30, "la", None), (31, "123", None), (32, None, "fr")], "doc_id long, text string, lang string").selectExpr("*", "42.0D as score", "'k' as lang_pred")
    got = language.accepted(docs, language.fitted(docs), 0.9).collect()
    assert len(got) == len(rows) + 1 and all(r.score == 42.0 and r.lang_pred == "k" for r in got)


def test_texts_are_looked_at_by_slices_and_sent_once(spark, corpus):
    import pyarrow as pa

    class Sent:
        value = language.Model(["a", "b"], columns([("a", "hello", 5), ("b", "world", 5)]), columns([("a", "x", 3)]))

    batch = pa.RecordBatch.from_arrays([pa.array(range(1300)), pa.array(["hello", "world", None, "123"] * 325)], ["doc_id", "text"])
    made = list(language._predictor(Sent, ["doc_id"])(iter([batch])))
    assert [b.num_rows for b in made] == [500, 500, 300] and [x for b in made for x in b.column(0).to_pylist()] == list(range(1300))
    assert [x for b in made for x in b.column(1).to_pylist()] == ["a", "b", "und", "und"] * 325
    assert "_text" not in language.accepted(corpus, Sent.value, 0.5)._jdf.queryExecution().toString()


def test_unseen_words_take_bounded_memory(monkeypatch):
    """With few languages too, where a word takes much more than its numbers."""
    import tracemalloc

    monkeypatch.setattr(language, "CACHE_BYTES", 1_000_000, raising=False)
    model = language.Model(["a"], columns([("a", "hello", 5)]), columns([("a", "x", 3)]))
    spelt = str.maketrans("0123456789", "abcdefghij")
    tracemalloc.start()
    try:
        for at in range(0, 20_000, 500):
            model.predict(" ".join([str(100_000 + k).translate(spelt) for k in range(at, at + 500)]))
        assert tracemalloc.get_traced_memory()[0] < 2_000_000
    finally:
        tracemalloc.stop()


def test_free_memory_is_given_back():
    import re
    import subprocess
    import sys

    code = """
import re, pyarrow
from tarnflow.llm.common import let_go
own = lambda: int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
many = [bytes([k % 256]) * 60_000 for k in range(2_000)]
last = bytes([1]) * 60_000
before = own()
del many
let_go()
print(before - own())
"""
    ran = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=re.sub(r"/tarnflow/.*", "", language.__file__))
    assert float(ran.stdout) > 80


# --- SentencePiece


@pytest.mark.parametrize("which", ["odd", "empty", "corpus"])
def test_pieces_are_the_librarys(which, request):
    df = request.getfixturevalue(which)
    rows = pieces.encoded(df, tokenizer_path("piece_bpe_32k.model")).collect()
    assert len(rows) == df.count() and all(r.parity and r.decoded_ok for r in rows)


def test_codec_parity(rng):
    codec = pieces.Codec(tokenizer_path("piece_bpe_32k.model"))
    letters = " \n\tab'sé²½Ⅷ١_-.12日😀<s></s>\xa0\u200b\x1c\u0301▁"
    texts = ["", " ", "<s>", "a  b", "<0x0A>"] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    for _ in range(2):
        got = codec.coded(texts)
        assert [g[0] for g in got] == [b"".join(int(i).to_bytes(4, "little") for i in ids) for ids in codec.checker.encode(texts)] and all(g[1] for g in got)


def test_unigram_model_is_rebuilt(tmp_path):
    """A unigram model put together by hand: the same pieces as the sentencepiece library's."""
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as protobuf

    m = protobuf.ModelProto()
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *[(f"<0x{b:02X}>", 0, 6) for b in range(256)], ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.1, 1), ("ab", -3.5, 1), ("▁ab", -4.0, 1), ("ba", -5.0, 1)]:
        p = m.pieces.add()
        p.piece, p.score, p.type = piece, score, kind
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 1, True
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.escape_whitespaces, m.normalizer_spec.remove_extra_whitespaces = "identity", True, True, False
    path = tmp_path / "u.model"
    path.write_bytes(m.SerializeToString())
    mine, theirs = pieces.rebuilt(str(path)), SentencePieceProcessor(model_file=str(path))
    for text in ("ab", "abba ab", "a b  ab", "aé", "bab"):
        assert mine.encode(text, add_special_tokens=False).ids == theirs.encode(text)


# --- URLs

URLS = [("HTTP://A.Example.COM/en/7?x", "a.example.com", "/en/7", "example.com/en/7", "allow"), ("x://com/en/", "com", "/en/", "com/en/", "block"), ("http://notexample.com#/en/", "notexample.com", "", None, None), ("http://example.net/de/85", "example.net", "/de/85", "example.net/de/8", "block"), ("http://b.example.net/de/9", "b.example.net", "/de/9", "net/de/", "allow"), (None, "", "", None, "allow"), ("no scheme/en/", "", "", None, "allow"), ("http://", "", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, None), ("http://org/es/#x", "org", "/es/", "org/es/", "block")]


def test_rules(spark):
    pages = spark.createDataFrame([(k, u[0], None, "r") for k, u in enumerate(URLS)] + [(None, "http://x.org/es/", "<a", "r")], "page_id long, url string, html string, rule string")
    got = {r.page_id: r for r in urls.judged(pages, RULES).collect()}
    assert len(got) == len(URLS) + 1 and got[None].verdict == "block"
    for k, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule) and (verdict is None or got[k].verdict == verdict)
    assert urls.judged(pages.limit(0), RULES).count() == 0


def solved(edges, start):
    """PageRank by solving its linear system; hosts without a way on send everything back to the seeds."""
    import numpy as np

    hosts = sorted({h for e in edges for h in e[:2]} | set(start))
    at, n = {h: k for k, h in enumerate(hosts)}, len(hosts)
    seed = np.array([start.get(h, 0.0) for h in hosts]) / (sum(start.values()) or 1.0)
    step = np.zeros((n, n))
    for s, d, w in edges:
        step[at[d], at[s]] += w
    out = step.sum(0)
    step = np.where(out > 0, step / np.where(out > 0, out, 1.0), seed[:, None])
    rank = np.linalg.solve(np.eye(n) - urls.DAMPING * step, (1 - urls.DAMPING) * seed)
    return dict(zip(hosts, rank.tolist(), strict=True))


def scores(spark, links, seeds, **how):
    got = urls.propagated(spark.createDataFrame(links, "src string, dst string, weight double"), spark.createDataFrame(seeds, "host string, trusted double, blocked double"), **how).collect()
    return {r.host: (r.trust, r.distrust) for r in got}


def test_propagation_is_pagerank(spark, rng):
    links = [("a", "b", 1.0), ("b", "c", 2.0), ("b", "d", 1.0), ("e", "d", 1.0), ("d", "a", 1.0)]
    seeds = [("a", 3.0, 0.0), ("c", 0.0, 1.0), ("e", 1.0, 0.0), ("lone", 0.0, 1.0)]
    links += [(f"h{rng.randrange(40)}", f"h{rng.randrange(50)}", float(rng.randint(1, 3))) for _ in range(80)] + [("b", "h1", 1.0), ("h2", "c", 1.0)]
    got = scores(spark, links, seeds, precision=1e-7)
    trust, distrust = solved(links, {h: t for h, t, _ in seeds}), solved([(d, s, w) for s, d, w in links], {h: b for h, _, b in seeds})
    assert set(got) == set(trust)
    for h, (t, d) in got.items():
        assert abs(t - trust[h]) < 1e-7 and abs(d - distrust[h]) < 1e-7


def test_verdicts_of_pages_are_the_solved_ones(spark, sf):
    """Every page of the smallest tables by rules, regular expressions and a solved system in Python."""
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = [r.asDict() for r in pages.collect()]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    links, seeds = {}, {}
    for r in rows:
        rest = r["url"].split("://", 1)[1] if "://" in (r["url"] or "") else ""
        r["host"] = re.match("[^/?#]*", rest)[0].translate(low)
        r["path"] = re.match("[^?#]*", rest[len(r["host"]) :])[0]
        fits = [(len(h) + len(p), h + p, v) for v, h, p in RULES if (r["host"] == h or r["host"].endswith("." + h)) and r["path"].startswith(p)]
        r["rule"], r["own"] = max(fits)[1:] if fits else (None, None)
        if r["host"]:
            seeds.setdefault(r["host"], [0.0, 0.0])[r["own"] == "block"] += r["own"] is not None
            for to in re.findall(r"""(?i)\bhref\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)""", r["html"] or ""):
                links[r["host"], to.translate(low)] = links.get((r["host"], to.translate(low)), 0.0) + 1
    for h in seeds:
        if h.count(".") > 1:
            up = h.split(".", 1)[1]
            links[h, up], links[up, h] = links.get((h, up), 0.0) + urls.KIN, links.get((up, h), 0.0) + urls.KIN
    edges = [(a, b, w) for (a, b), w in links.items() if a and b and a != b]
    start = [{h: s[k] for h, s in seeds.items()} for k in (0, 1)]
    trust, distrust = solved(edges, start[0]), solved([(b, a, w) for a, b, w in edges], start[1])
    even = 1 / len(trust)
    got = {r.page_id: r for r in urls.judged(pages, RULES).collect()}
    assert len(got) == len(rows)
    for r in rows:
        d, t = distrust.get(r["host"], 0.0), trust.get(r["host"], 0.0)
        close = min(abs(d - urls.BIAS * t), abs(d - urls.FLOOR * even)) < 1e-5
        want = r["own"] or ("block" if d > urls.BIAS * t and d > urls.FLOOR * even else "allow")
        mine = got[r["page_id"]]
        assert (mine.host, mine.path, mine.rule) == (r["host"], r["path"], r["rule"]) and (mine.verdict == want or close)


def test_hosts_that_link_to_blocked_ones_are_blocked(spark):
    rows = [(1, "http://good.test/ok/1", '<a href="http://fine.test/x">'), (2, "http://bad.test/no/1", ""), (3, "http://friend.test/x", "<a href='https://BAD.test/q'>"), (4, "http://fine.test/z", ""), (5, "http://alone.test/z", '<a href="/local">')]
    rules = [("allow", "good.test", "/ok/"), ("block", "bad.test", "/no/")]
    got = {r.page_id: r.verdict for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    assert got == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "allow"}


def test_distrust_settles_on_long_chains(spark):
    """A chain of 20 hosts to a blocked one: every hop has what the solved system gives it, and more than 8 hops are blocked."""
    rows = [(k, f"http://h{k}.test/{'no/' if k == 0 else ''}", f'<a href="http://h{k - 1}.test/">' if k else "") for k in range(20)]
    got = {r.page_id: r for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string, html string"), [("block", "h0.test", "/no/")]).collect()}
    want = solved([(f"h{k - 1}.test", f"h{k}.test", 1.0) for k in range(1, 20)], {"h0.test": 1.0})
    assert all(abs(got[k].distrust - want[f"h{k}.test"]) < 2e-4 for k in range(20))
    assert [k for k in range(20) if got[k].verdict == "block"] == [k for k in range(20) if want[f"h{k}.test"] > 0.025]


# --- fingerprints


@pytest.mark.parametrize("which", ["odd", "empty", "corpus"])
def test_edited_text_follows_the_order(which, request):
    df = request.getfixturevalue(which)
    got = fingerprint.fingerprinted(df).collect()
    rows = sorted([(r.doc_id, r.text or "") for r in df.collect()], key=lambda r: (-(r[0] if r[0] is not None else -1), r[1]))
    want = []
    for k, (i, text) in enumerate(rows):
        changed = fingerprint.edited(text, rows[(k + 1) % len(rows)][1])
        following = fingerprint.digest(rows[(k + 1) % len(rows)][1])
        want.append((str(i), len(text), hashlib.sha256(changed.encode()).hexdigest(), fingerprint.digest(text), fingerprint.digest(changed), fingerprint.likeness(fingerprint.digest(text), fingerprint.digest(changed)), fingerprint.likeness(fingerprint.digest(text), following)))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got) == sorted(want)


def test_edits_are_nearer_than_other_documents(corpus):
    rows = [r for r in fingerprint.fingerprinted(corpus).collect() if r.n_chars > 500]
    assert sum(r.near_edited for r in rows) > 2 * sum(r.near_next for r in rows)


def test_digest_of_pieces(monkeypatch):
    text = "some words of a text " * 500
    whole = fingerprint.digest(text)
    monkeypatch.setattr(fingerprint, "PIECE", 97)
    assert fingerprint.digest(text) == whole and fingerprint.likeness(whole, whole) == 1.0 and 0 <= fingerprint.likeness(whole, fingerprint.digest("x")) < 0.5
    assert fingerprint.digest("") == fingerprint.digest("")


# --- sharding


@pytest.mark.parametrize("which", ["odd", "empty", "corpus"])
def test_shards_are_even_and_slots_gapless(which, request):
    df = request.getfixturevalue(which)
    got = sharding.shuffled(df, 8, 5).collect()
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in df.collect())
    slots = {k: sorted(r.slot for r in got if r.shard == k) for k in range(8)}
    assert all(s == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    if which == "corpus":
        again = {r.doc_id: (r.shard, r.slot) for r in sharding.shuffled(df.repartition(5), 8, 5).collect()}
        assert again == {r.doc_id: (r.shard, r.slot) for r in got}
        assert again != {r.doc_id: (r.shard, r.slot) for r in sharding.shuffled(df, 8, 6).collect()}


@pytest.mark.parametrize("rows", [1, 2, 3, 7, 10, 101, 4096, 5000])
def test_permutation(spark, rows):
    got = [r.p for r in spark.range(rows).select(sharding.permuted(__import__("pyspark").sql.functions.col("id"), rows, 3).alias("p")).collect()]
    assert sorted(got) == list(range(rows))
    a, b = sharding.sides(rows)
    assert a * b >= rows > a * (b - 1)


# --- media


@pytest.mark.parametrize("which", ["odd", "empty", "corpus"])
def test_media_round_trip(which, request):
    df = request.getfixturevalue(which)
    got = media.round_trip(df).collect()
    want = []
    for r in df.collect():
        payload, n = media.padded(r.text)
        assert len(payload) % 576 == 0 and len(payload) >= 576
        stored = media.to_png(payload, n)
        assert media.from_png(stored) == (payload, n)
        want.append((str(r.doc_id), n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), media.feature(payload)))
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == sorted(want)


def test_members_are_read_by_range_and_retried(tmp_path, monkeypatch):
    import zipfile

    with zipfile.ZipFile(tmp_path / "m.zip", "w", zipfile.ZIP_STORED) as z:
        for k in range(20):
            z.writestr(f"{k}/{k}.png", media.to_png(*media.padded(f"text {k} " * 50)))
    (tmp_path / "m.zip.7").write_bytes(b"left by a lost task")
    uri = f"file://{tmp_path}"
    reader = media.MediaReader({"path": uri, "rangebytes": "500"})
    ranges = reader.partitions()
    members = [media.members_of(r.path, r.start, r.end) for r in ranges]
    assert len(ranges) > 3 and sorted(m[0] for own in members for m in own) == sorted(f"{k}/{k}.png" for k in range(20))
    first = next(own[0] for own in members[1:] if own)
    calls, true = [], media.payload_at

    def shaky(f, offset, size, check):
        calls.append(offset)
        if calls.count(offset) < 3 and offset == first[1]:
            raise OSError("lost")
        return true(f, offset, size, check)

    monkeypatch.setattr(media, "payload_at", shaky)
    monkeypatch.setattr(media.time, "sleep", lambda s: None)
    got = [k for r in ranges for b in reader.read(r) for k in b.column(0).to_pylist()]
    assert sorted(got) == list(range(20)) and len(calls) == 22
    with pytest.raises(OSError):
        media.fetched(ranges[0].path, first[1], 5, 1, tries=2)


def test_a_repeated_task_finds_its_file(tmp_path):
    """Stores that refuse to move onto a file keep the first attempt's; a part of one is never taken for it."""
    from pyarrow import fs

    from tarnflow.llm import common

    class Refusing:
        def __init__(self):
            self.store = fs.LocalFileSystem()

        def move(self, a, b):
            if self.store.get_file_info(b).type == fs.FileType.File:
                raise OSError("exists")
            self.store.move(a, b)

        def __getattr__(self, name):
            return getattr(self.store, name)

    for attempt, data in (("1", b"abc"), ("2", b"abc"), ("3", b"abcd")):
        source, target = tmp_path / f"f.{attempt}", tmp_path / "f"
        source.write_bytes(data)
        if attempt == "3":
            with pytest.raises(OSError):
                common.moved(Refusing(), str(source), str(target))
        else:
            common.moved(Refusing(), str(source), str(target))
            assert target.read_bytes() == data and not source.exists()


def test_pipeline(spark, sf):
    """Every stage keeps the columns, clashing ones included, and does to each document what its operator says; the last packs what is left."""
    import corpus_pipeline

    from tarnflow.llm import neardup, packing, pii

    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "42.0D as score", "'k' as _key", "'s' as _spans", "'l' as lang_pred", "1L as n_known")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    first, second, third = [stage for _, stage in corpus_pipeline.STAGES[:3]]
    one = first(spark, docs, sf)
    left = {r.doc_id: r for r in one.collect()}
    assert one.columns == columns and all(r.score == 42.0 and r.lang_pred == "l" and r.text == texts[k] for k, r in left.items())
    assert all(not any(c.isalpha() for c in texts[k] or "") for k in texts if k not in left)
    two = second(spark, one, sf)
    linked = {r.doc_id: r.component_id for r in neardup.linked(one).collect()}
    kept = {r.doc_id for r in two.collect()}
    assert two.columns == columns and kept == {k for k, root in linked.items() if k == root}
    three = third(spark, two, sf)
    clean = {r.doc_id: r for r in three.collect()}
    assert three.columns == columns and set(clean) == kept and all(r.n_chars == len(r.text) and r._key == "k" and r._spans == "s" for r in clean.values())
    found = {r.doc_id: r.spans for r in pii.detected(two).collect()}
    for k, spans in found.items():
        out, at = "", 0
        for start, end, kind in sorted((s["start"], s["end"], s["kind"]) for s in spans):
            if start >= at:
                out += texts[k][at:start] + f"<{kind.upper()}>"
            at = max(at, end)
        assert clean[k].text == out + texts[k][at:]
    odd = spark.createDataFrame([(1, None, 7)], "doc_id long, text string, n_chars long")
    assert [r.n_chars for r in third(spark, odd, sf).collect()] == [7]
    four = corpus_pipeline.STAGES[3][1](spark, three, sf).groupBy("doc_id").sum("length").collect()
    assert {r[0] for r in four} == kept and packing.WIDTH == 2048


def test_scratch_tables_and_the_model_leave_nothing_on_the_driver(spark, sf, monkeypatch):
    """Scratch tables have no file that marks success, which the driver's JVM would start two processes for; the model's memory goes back."""
    import corpus_pipeline

    from tarnflow.llm import common

    table = common.stored(spark.range(5), "five")
    folder = table.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert table.count() == 5 and not [x for x in os.listdir(folder) if "_SUCCESS" in x]
    went = []
    monkeypatch.setattr(corpus_pipeline, "let_go", lambda: went.append(True), raising=False)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert corpus_pipeline.identify(spark, docs, sf).columns == docs.columns and went == [True]
