"""What to do about published releases, case by case."""

import pytest

from tarnflow.operators import currency

RELEASES = [("kb-2024-01-01", "2024-01-01", 7, "s1", {"attack": "14"}), ("kb-2024-03-01", "2024-03-01", 7, "s3", {"attack": "15.1", "cci": "2"}), ("kb-2024-02-01", "2024-02-01", 6, "s2", {})]
HIGHER = ("kb-2024-04-01", "2024-04-01", 8, "s4", {})
INSTALLED = "schema int, sha256 string, problem string, recorded_sha256 string, recorded_release string, sources map<string,string>"
PUBLISHED = "tag string, date string, schema int, sha256 string, sources map<string,string>"


@pytest.mark.parametrize("own, releases, tag, action, says", [
    ((7, None, None, None, None, None), RELEASES, None, "install", "nothing is installed"),
    ((7, None, "unreadable", None, None, None), RELEASES, None, "install", "unreadable"),
    ((7, None, None, None, None, None), [], None, "build_locally", "no release has schema 7"),
    ((7, "x", None, None, None, None), [], None, "none", "stays"),
    ((5, "x", None, None, None, None), RELEASES, None, "upgrade_package", "kb-2024-03-01 needs a newer package"),
    ((7, "s3", None, None, None, None), RELEASES, None, "none", "newest release is installed"),
    ((7, "s3", None, None, None, None), [*RELEASES, HIGHER], None, "upgrade_package", "kb-2024-04-01"),
    ((7, "s1", None, "s1", "kb-2024-01-01", None), RELEASES, None, "install", "newer than kb-2024-01-01"),
    ((7, "s9", None, "s9", "kb-2024-09-09", None), RELEASES, None, "none", "no longer published"),
    ((7, "s9", None, "s1", "kb-2024-01-01", {"attack": "15.1", "cci": "2"}), RELEASES, None, "none", "local build is as current"),
    ((7, "s9", None, None, None, {"attack": "9.9", "cci": "3"}), RELEASES, None, "install", "newer attack; older, and would replace: cci"),
    ((7, "s9", None, None, None, {"attack": "draft"}), RELEASES, None, "none", "as current"),
    ((7, "s3", None, "s3", "kb-2024-03-01", None), RELEASES, "kb-2024-01-01", "none", "kb-2024-03-01 is current"),
    ((7, None, None, None, None, None), RELEASES, "kb-1999-01-01", "build_locally", "nothing is installed"),
])
def test_decisions(spark, own, releases, tag, action, says):
    got = currency.decisions(spark.createDataFrame([own], INSTALLED), spark.createDataFrame(releases, PUBLISHED), tag).first()
    assert got.action == action and says in got.reason
