"""Rule files: what they give, what refuses them, and when they are read again."""

import json
import os

import pytest

from tarnflow.sources import rules

GOOD = {"win": {"id_pattern": "^WIN_", "build_pattern": r"update (?P<n>\d+)", "thresholds": [{"min": 0, "version": None}, {"min": 20, "version": "2"}, {"min": 5, "version": "1"}]}}
PAIR = {"A": {"documents": [{"match": "x/", "stig_id": "A1", "title": "One"}, {"match": "y/", "stig_id": "A2", "title": "Two"}]}}


def written(folder, what, name="r.yaml"):
    path = folder / name
    path.write_text(what if isinstance(what, str) else json.dumps(what))
    return str(path)


def entry(**changes):
    return {"win": {k: v for k, v in (GOOD["win"] | changes).items() if v != "gone"}}


def test_entries_by_their_highest_threshold(spark, tmp_path):
    assert rules.entries(spark, written(tmp_path, GOOD)) == [("win", "^WIN_", r"update (?P<n>\d+)", [(20, "2"), (5, "1"), (0, None)])]


@pytest.mark.parametrize("change, says", [
    ({"id_pattern": "gone"}, "id_pattern"), ({"id_pattern": "("}, "no pattern"), ({"build_pattern": r"(\d+)"}, "group named n"), ({"thresholds": []}, "list of thresholds"),
    ({"thresholds": [{"min": 0, "versoin": None}]}, "needs min and version"), ({"thresholds": [{"version": "1"}]}, "needs min and version"), ({"thresholds": [{"min": "x", "version": "1"}]}, "no number"),
    ({"thresholds": [{"min": 0, "version": 2}]}, "text or null"), ({"thresholds": [{"min": 3, "version": "2"}]}, "min 0"), ({"thresholds": ["0"]}, "needs min and version"),
    ({"thresholds": [{"min": 0, "version": "1"}, {"min": 0, "version": "2"}]}, "one min"),
])
def test_entries_refused(spark, tmp_path, change, says):
    with pytest.raises(ValueError, match=says):
        rules.entries(spark, written(tmp_path, entry(**change)))


@pytest.mark.parametrize("text", ["RHEL_9:\n", "RHEL_9: rhel 9\n", "RHEL_9: [1]\n", "- a\n", "a: [b\n"])
def test_aliases_refused(spark, tmp_path, text):
    with pytest.raises(ValueError, match="r.yaml"):
        rules.aliases(spark, written(tmp_path, text))


def test_aliases_of_yaml_and_of_nothing(spark, tmp_path):
    assert rules.aliases(spark, written(tmp_path, "RHEL_9:\n  - rhel nine\n  - 'red hat 9'\n")) == {"RHEL_9": ["rhel nine", "red hat 9"]}
    assert rules.aliases(spark, written(tmp_path, "", "none.yaml")) == {}
    with pytest.raises(FileNotFoundError):
        rules.aliases(spark, str(tmp_path / "missing.yaml"))


def test_corrections_with_titles(spark, tmp_path):
    assert rules.corrections(spark, written(tmp_path, PAIR)) == ({"A": [("x/", "A1"), ("y/", "A2")]}, {"A1": "One", "A2": "Two"})


@pytest.mark.parametrize("documents", [PAIR["A"]["documents"][:1], None, ["x", "y"], [PAIR["A"]["documents"][0]] * 2, [PAIR["A"]["documents"][0], {"match": "y/", "stig_id": "A2", "title": " "}], [PAIR["A"]["documents"][0], {"match": "y/", "stig_id": "A1", "title": "Two"}]])
def test_corrections_refused(spark, tmp_path, documents):
    with pytest.raises(ValueError):
        rules.corrections(spark, written(tmp_path, {"A": {"documents": documents}}))


def test_files_are_read_again_when_they_change(spark, tmp_path):
    path = written(tmp_path, {"A": ["one"]})
    first = rules.aliases(spark, path)
    first["A"].append("typed by the caller")
    assert rules.aliases(spark, path) == {"A": ["one"]}
    state = os.stat(path)
    written(tmp_path, {"B": ["two"]})
    os.utime(path, ns=(state.st_atime_ns, state.st_mtime_ns + 2_000_000_000))
    assert rules.aliases(spark, path) == {"B": ["two"]}
    written(tmp_path, {"A": "broken"})
    for _ in range(2):  # a refusal isn't held
        with pytest.raises(ValueError):
            rules.aliases(spark, path)
    assert rules.rules(spark, written(tmp_path, {"A": ["one"]}, "a.yaml"), written(tmp_path, GOOD, "e.yaml")).entries[0][0] == "win"
