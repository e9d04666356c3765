"""A release packed, verified, installed; and everything that refuses one."""

import gzip
import hashlib
import json
import shutil

import pytest

from tarnflow.operators import currency
from tarnflow.schema import SCHEMA_VERSION
from tarnflow.sources import publish, release


@pytest.fixture(scope="module")
def packed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("release")
    root = str(folder / "root")
    techniques = spark.createDataFrame([(f"T{i}", f"näme {i}", ["t"] * (i % 3)) for i in range(50)], "technique_id string, name string, tactics array<string>")
    publish.publish(spark, {"techniques": techniques}, root)
    about = release.pack(spark, root, str(folder / "packed"), "kb-2024-01-01", "2024-01-01")
    return folder / "packed", about


def copied(packed, tmp_path, change=None):
    """A copy of the release in which change(bytes) replaces the techniques' file and its checksum."""
    to = tmp_path / "copy"
    shutil.copytree(packed[0], to)
    if change:
        part = next(p for p in (to / "techniques").glob("*.gz") if p.stat().st_size > 100)
        new = change(part.read_bytes())
        for sums in (to / release.CHECKSUMS).glob("part*"):
            sums.write_text(sums.read_text().replace(hashlib.sha256(part.read_bytes()).hexdigest(), hashlib.sha256(new).hexdigest()))
        for crc in to.rglob(".*.crc"):
            crc.unlink()
        part.write_bytes(new)
    return to


def test_install_notes_the_release(spark, packed, tmp_path):
    root = str(tmp_path / "root")
    assert release.installed(spark, root)["sha256"] is None
    assert release.install(spark, str(packed[0]), root)["installed"] == "kb-2024-01-01"
    own = release.installed(spark, root)
    assert own == {"sha256": packed[1]["sha256"], "problem": None, "recorded_sha256": packed[1]["sha256"], "recorded_release": "kb-2024-01-01"}
    assert {r.name for r in publish.KnowledgeBase(spark, root).acquire()["techniques"].collect()} >= {"näme 7"}
    one = spark.createDataFrame([(int(SCHEMA_VERSION), *own.values(), {})], "schema int, sha256 string, problem string, recorded_sha256 string, recorded_release string, sources map<string,string>")
    offered = spark.createDataFrame([("kb-2024-01-01", "2024-01-01", int(SCHEMA_VERSION), own["sha256"], {}), ("kb-2024-02-01", "2024-02-01", int(SCHEMA_VERSION), "x", {})], "tag string, date string, schema int, sha256 string, sources map<string,string>")
    assert currency.decisions(one, offered).first().action == "install"


@pytest.mark.parametrize("change, says", [
    (lambda b: gzip.compress(b"x" * (64 << 20)), "beyond the cap"), (lambda b: b"PK\x03\x04" + b, "no packed table"), (lambda b: b[:-20], "ends early"), (lambda b: b + b"more", "data after the end"),
    (lambda b: b[:30] + bytes(40) + b[70:], "damaged"), (lambda b: gzip.compress(gzip.decompress(b).replace(b'"T', b'"U')), "other rows"),
])
def test_refused(spark, packed, tmp_path, change, says):
    root = str(tmp_path / "root")
    with pytest.raises(ValueError, match=says):
        release.install(spark, str(copied(packed, tmp_path, change)), root, cap=32 << 20)
    assert publish.readiness(spark, root) == "no_knowledge_base"


def test_files_and_checksums_must_agree(spark, packed, tmp_path):
    to = copied(packed, tmp_path)
    part = next(p for p in (to / "techniques").glob("*.gz") if p.stat().st_size > 100)
    (to / "techniques" / "extra.json.gz").write_bytes(gzip.compress(b"{}"))
    part.rename(part.with_suffix(".gone"))
    assert sorted(r.problem for r in release.verified(spark, str(to)).filter("problem is not null").collect()) == ["missing", "no checksum"]
    about = next((to / release.ABOUT).glob("part*"))
    about.write_text(json.dumps(packed[1] | {"schema_version": "1"}))
    next((to / release.ABOUT).glob(".part*.crc")).unlink(missing_ok=True)
    with pytest.raises(ValueError, match="schema 1"):
        release.install(spark, str(to), str(tmp_path / "root"))
