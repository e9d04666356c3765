"""Nested archives read by ranges."""

from __future__ import annotations

import io
import zipfile

import pytest

from tarnflow.sources import archives, nested

DOC = b"<x:Benchmark xmlns:x='u' id='%d'/>"


def zipped(files, how=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", how) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def outer(how=zipfile.ZIP_DEFLATED):
    inner = {f"i{k}.zip": zipped({f"a/{k}-xccdf.xml": DOC % k, f"a/{k}_Manual-xccdf.xml": DOC % (100 + k), "a/pad.bin": bytes(5000 + k)}, zipfile.ZIP_STORED if k % 2 else how) for k in range(9)}
    plain = zipped({"b/root.xml": DOC % 7, "b/page.xml": b"<html/>", "b/typed.xml": b"<!DOCTYPE a [<!ENTITY e 'x'>]><Benchmark/>", "b/open.xml": b"<Bench"})
    return {**inner, "plain.zip": plain, "broken.zip": b"no zip", "own-xccdf.xml": DOC % 55, "read.me": b"x"}


def rows_of(kind, data, step):
    f = io.BytesIO(data)
    starts = range(0, len(data), step)
    return [r for s in starts for r in nested.documents_of(kind, "A.zip", f, s, s + step)]


@pytest.mark.parametrize("kind", ["library", "product_zip"])
@pytest.mark.parametrize("how", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_ranges_give_every_document_once(kind, how):
    data = zipped(outer(how), how)
    whole = rows_of(kind, data, len(data))
    key = lambda r: tuple(map(str, r))
    for step in (97, 1000, 20_000):
        assert sorted(rows_of(kind, data, step), key=key) == sorted(whole, key=key)
    found = {(r[2], r[3]) for r in whole if not r[5]}
    want = {(f"i{k}.zip", f"a/{k}_Manual-xccdf.xml") for k in range(9)} | {("plain.zip", "b/root.xml")} | (set() if kind == "library" else {("own-xccdf.xml", "own-xccdf.xml")})
    assert found == want and [r[2] for r in whole if r[5]] == ["broken.zip"]


def test_a_damaged_member_harms_no_other():
    data = bytearray(zipped({"one-xccdf.xml": DOC % 1 * 50, "two-xccdf.xml": DOC % 2}, zipfile.ZIP_STORED))
    data[60] ^= 255
    rows = rows_of("product_zip", bytes(data), len(data))
    assert [(r[3], r[5] is None) for r in rows] == [("one-xccdf.xml", False), ("two-xccdf.xml", True)] and "one-xccdf.xml" in rows[0][5]


def test_barred_names():
    for files in ({"CUI_x/a.zip": b""}, {"a.zip": zipped({"b/cui_c-xccdf.xml": DOC % 1})}):
        with pytest.raises(ValueError, match="out of scope"):
            rows_of("library", zipped(files), 10_000)


def test_an_archive_over_two_gigabytes(spark, tmp_path):
    """A file whose members begin past 2.2 GB; its hash isn't asked for here."""
    path = tmp_path / "U_SRG-STIG_Library_July_2026.zip"
    with open(path, "wb") as f:
        f.truncate(2_200_000_000)
        f.seek(2_200_000_000)
        f.write(zipped(outer()))
    (tmp_path / "loose-xccdf.xml").write_bytes(DOC % 3)
    (tmp_path / "not.xml").write_bytes(b"<html/>")
    found = archives.benchmark_documents(archives.classified(archives.listing(spark, str(tmp_path))))
    assert found.rdd.getNumPartitions() > 10
    rows = found.collect()
    assert sorted(r.source_document for r in rows if r.content) == sorted([*(f"a/{k}_Manual-xccdf.xml" for k in range(9)), "b/root.xml", "loose-xccdf.xml"])
    assert [r.origin for r in rows if r.source_member is None] == ["loose"]


def test_an_empty_folder(spark, tmp_path):
    (tmp_path / "note.txt").write_text("x")
    assert archives.benchmark_documents(archives.classified(archives.listing(spark, str(tmp_path)))).collect() == []


def test_hashes_are_streamed(spark, tmp_path):
    import hashlib

    (tmp_path / "a.zip").write_bytes(b"abc")
    rows = archives.source_files(archives.listing(spark, str(tmp_path))).collect()
    assert [tuple(r) for r in rows] == [("a.zip", hashlib.sha256(b"abc").hexdigest(), 3)]
