"""A manifest's logs: tolerance, order, tombstones, folds; and the stream that writes one."""

import json

from tarnflow.sources import manifest
from tarnflow.streaming import refresh

SHA = "a" * 64


def names(spark, root):
    return {(r.name, r.date) for r in manifest.latest(manifest.read(spark, root)[0]).collect()}


def put(spark, root, log, at, *rows):
    manifest.append(spark.createDataFrame(list(rows), "name string, date string, removed boolean"), root, log, at)


def test_one_bad_row_costs_itself(spark):
    good = {"name": "a.zip", "date": "2024-01-01", "size_bytes": 5, "on_disk_bytes": 5, "sha256": SHA, "at": 1}
    bad = ["", "null", "[1]", "{\"name\": \"a", json.dumps(good | {"size_bytes": "many"}), json.dumps(good | {"name": "../a.zip"}), json.dumps(good | {"name": None}), json.dumps(good | {"sha256": "0"}), json.dumps(good | {"at": None})]
    rows, problems = manifest.parsed(spark.createDataFrame([(x,) for x in [json.dumps(good), *bad]], "value string"))
    assert [(r.name, r.size_bytes, r.removed) for r in rows.collect()] == [("a.zip", 5, False)]
    assert sorted(r.problem for r in problems.collect()) == ["no digest", *["no order"], *["no plain file name"] * 2, *["no record"] * 5]


def test_latest_tombstones_and_folds(spark, tmp_path):
    root = str(tmp_path / "m")
    assert names(spark, root) == set() and manifest.folded(spark, root) == 0
    put(spark, root, "one", 1, ("a", "1", False), ("b", "1", False), ("c", "1", False))
    put(spark, root, "two", 2, ("a", "2", False), ("b", None, True))
    assert names(spark, root) == {("a", "2"), ("c", "1")}
    put(spark, root, "two", 2, ("a", "3", False), ("b", None, True))  # the writer comes again
    put(spark, root, "old", 0, ("b", "0", False))
    assert names(spark, root) == {("a", "3"), ("c", "1")}
    before = manifest._logs(spark, root)
    assert manifest.folded(spark, root) == 3 and len(manifest._logs(spark, root)) == 1 and before == ["old", "one", "two"]
    put(spark, root, "one", 1, ("a", "1", False), ("b", "1", False))  # as if a covered log were still there
    assert names(spark, root) == {("a", "3"), ("c", "1")}
    put(spark, root, "back", 5, ("b", "5", False))
    assert manifest.folded(spark, root) == 3 and names(spark, root) == {("a", "3"), ("b", "5"), ("c", "1")}


def test_nothing_is_vouched_for_that_was_not_taken(spark):
    entries = spark.createDataFrame([("a", "1", 9, True), ("b", "1", 9, None), ("c", "1", 9, True)], "name string, date string, size_bytes long, took boolean")
    there = spark.createDataFrame([("a", 7, SHA), ("b", 9, SHA)], "name string, length long, sha256 string")
    got = {r.name: (r.on_disk_bytes, r.sha256) for r in manifest.vouched(entries, there, entries["took"]).collect()}
    assert got == {"a": (7, SHA), "b": (None, None), "c": (None, None)}


def test_stream_keeps_what_it_knows_and_survives_a_failed_rebuild(spark, tmp_path):
    folder, root, seen = tmp_path / "in", str(tmp_path / "m"), []
    folder.mkdir()

    def run(checkpoint="c", fail=False):
        def rebuild(rows):
            if fail:
                raise RuntimeError("stopped")
            seen.append(sorted(r.name for r in rows.collect()))

        query = refresh.refreshed(spark, str(folder), root, str(tmp_path / checkpoint), rebuild)
        try:
            query.awaitTermination()
        except Exception:
            assert fail

    (folder / "a.xml").write_text("one")
    run()
    (folder / "b.xml").write_text("two")
    run(fail=True)
    run()  # the batch is run again and gives the same rows
    assert seen == [["a.xml"], ["b.xml"]]
    (folder / "sub").mkdir()
    run()
    run(checkpoint="d")  # another stream over the same manifest has nothing new
    (folder / "c.xml").write_text("three")
    run(checkpoint="d")
    assert seen == [["a.xml"], ["b.xml"], ["c.xml"]]
    assert {r.name for r in manifest.latest(manifest.read(spark, root)[0]).collect()} == {"a.xml", "b.xml", "c.xml"}
