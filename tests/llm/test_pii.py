"""Base patterns against Python's, and what the contexts teach."""

from __future__ import annotations

import hashlib
import re

import pytest

from tarnflow.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def holds(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    return kind == "email" or (kind == "card" and 16 <= len(digits) <= 19 and luhn(digits)) or (kind == "phone" and 8 <= len(digits) <= 15)


def base(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if holds(k, m[0])]


ODD = ["a@b.c_d@e.f x@y.z@q.r.s", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "+1 (532) 555-7857.", "4111 1111 1111 1111 4111-1111-1111-1111  4111111111111111", "12 34" * 40, "ééé 4111111111111111 +49 30 1234567-", "1" * 3000 + " a@" + "b." * 3000 + "c", "+1" + "2" * 14, "a.b@c-d.e..f@g.h", "1 " * 8000, "@" * 500, "." * 500 + "1.1.1.1"]


@pytest.mark.parametrize("which", ["odd", "empty", "corpus", "own"])
def test_base_spans(which, spark, request):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string") if which == "own" else request.getfixturevalue(which)
    got = pii.digest(pii.detected(df)).collect()
    want = sorted(((-1 if r.doc_id is None else r.doc_id), hashlib.sha256(",".join(base(r.text)).encode()).hexdigest()) for r in df.collect())
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.base_sha256) for r in got) == want
    for r in got:
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in PATTERNS]


def test_contexts_find_what_no_pattern_matches(spark):
    rows = [(k, f"please write to my card number {c} today") for k, c in enumerate(["4111111111111111", "5500005555555559", "4012888888881881", "5105105105105100", "4222222222222220", "6011111111111117"])]
    rows += [(50, "please write to my card number 9999-0000-XX-1234, today"), (51, "chapter one page 123456789 is fine"), (52, "your card number twelve")]
    got = {r.doc_id: r.spans for r in pii.digest(pii.detected(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[50] == "card:31:48" and got[51] == "" and got[52] == ""


def test_a_mixed_context_teaches_nothing(spark):
    rows = [(k, f"see the number {c} now") for k, c in enumerate(["4111111111111111", "5500005555555559", "4012888888881881", "5105105105105100"])]
    rows += [(100 + k, f"see the number AB{k}12345 now") for k in range(20)]
    got = pii.digest(pii.detected(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert all(r.spans == "" for r in got if r.doc_id >= 100)


def test_redaction(spark, odd):
    df = spark.createDataFrame([(1, "é mail a.b@c.de or +49 30 1234567.", "k"), (1, "é mail a.b@c.de or +49 30 1234567.", "k"), (2, None, "k"), (None, "ip 10.0.0.1", "k")], "doc_id long, text string, spans string")
    got = sorted((r.text or "") for r in pii.redacted(df).collect())
    assert got == ["", "ip <IP>", "é mail <EMAIL> or <PHONE>.", "é mail <EMAIL> or <PHONE>."]
    assert pii.redacted(odd).count() == odd.count()


CARDS = ["4111111111111111", "5500005555555559", "4012888888881881", "5105105105105100", "4222222222222220", "6011111111111117"]


@pytest.mark.parametrize("before", ["Karte ", "a@b.de Karte ", "ID 4711-88 card ", "", "page 3 of card "])
def test_cues_of_contact_lines(before, spark):
    rows = [(k, f"{before}{c} ok") for k, c in enumerate(CARDS)] + [(50, f"{before}X1234-5678, ok"), (51, "some other words X1234-9999, ok")]
    got = {r.doc_id: r.spans for r in pii.digest(pii.detected(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert f"card:{len(before)}:{len(before) + 10}" in got[50].split(",") and got[51] == ""


def test_groups_are_seeds_and_candidates(spark):
    grouped = [" ".join(c[k : k + 4] for k in range(0, 16, 4)) for c in CARDS]
    rows = [(k, f"please use my card number {c}, thanks") for k, c in enumerate(grouped)]
    rows += [(50, "please use my card number 1234 5678 9012 34, thanks"), (51, "please use my card number DE89 3704 0044 0532 0130 00 now"), (52, "please use my card number 1234567 7654321 now")]
    got = {r.doc_id: r.spans for r in pii.digest(pii.detected(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[50] == "card:26:43" and got[51] == "card:26:53" and got[52] == "card:26:33"


def test_found_instances_teach_new_cues(spark):
    """A chain of cues: all but the first have no seed, and share instances with the one before alone."""
    base = [c for c in (f"41111111{k:08d}" for k in range(4000)) if luhn(c)][:300]
    a, b, c = ([f"{x}-{k}-1234" for k in range(n)] for x, n in (("AB", 100), ("CD", 40), ("EF", 16)))
    rows = [f"card number {v}" for v in base + a] + [f"account code {v}" for v in a + b] + [f"member key {v}" for v in b + c] + [f"staff badge {v}" for v in [*c, "GH-1-5555"]]
    few = len(rows)
    rows += [f"other words {v}" for v in [*a[:3], "IJ-1-5555"]]
    got = {r.doc_id: r.spans for r in pii.digest(pii.detected(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))).collect()}
    assert all(got[k].startswith("card:") for k in range(few)) and not any(got[k] for k in range(few, len(rows)))


def test_texts_with_many_identifiers(spark):
    """Thousands of matches in one text, spans that overlap, and columns with the names that the operator uses inside."""
    text = " ".join(f"mail u{k}@h{k}.example.com, call +49 30 12345{k:04} or 10.0.{k % 256}.7 now" for k in range(3000))
    df = spark.createDataFrame([(1, text), (2, "a@4111.1111.1111.1111 x")], "doc_id long, text string").selectExpr("*", "'a' as _key", "'b' as _doc", "'c' as heads", "'e' as text_key", "'f' as d")
    got = {r.doc_id: r for r in pii.digest(pii.detected(df)).collect()}
    for r in df.collect():
        assert got[r.doc_id].base_sha256 == hashlib.sha256(",".join(base(r.text)).encode()).hexdigest()
    clean = {r.doc_id: r for r in pii.redacted(df).collect()}
    assert clean[1].text == " ".join(f"mail <EMAIL>, call <PHONE> or <IP> now" for k in range(3000))
    assert clean[2].text == "<EMAIL> x" and clean[2]._key == "a" and clean[2].d == "f" and clean[2].text_key == "e"
