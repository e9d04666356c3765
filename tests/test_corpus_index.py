"""The resolver's index: bound to a version, read by token, nothing left behind."""

from __future__ import annotations

import os

import pytest

from tarnflow.operators import resolver

SCHEMA = "stig_id string, version string, title string, product_keywords string, origin string"
OTHERS = [(f"F{k}", "1", f"Filler product{k} guide", None, "library") for k in range(40)]


def stigs(spark, title):
    return spark.createDataFrame([("RHEL_9_STIG", "1", title, "rhel 9", "library"), *OTHERS], SCHEMA)


def asked(spark, text):
    return spark.createDataFrame([(0, text)], "request long, description string")


def best(hits):
    return [(r.stig_id, round(r.score, 6)) for r in hits.collect()][:1]


def test_index_and_plain_rows_answer_alike(spark, tmp_path):
    rows = stigs(spark, "Red Hat Enterprise Linux 9")
    index = resolver.Corpus.written(rows, str(tmp_path / "i"), "b1")
    for text in ("Red Hat Enterprise Linux 9", "product7 and product9", "nothing known"):
        one, other = (resolver.resolve(x, asked(spark, text)) for x in (index, rows))
        assert [sorted(map(str, df.collect())) for df in one] == [sorted(map(str, df.collect())) for df in other]
    assert index.n == 41 and index.columns == rows.columns


def test_builds_in_one_session_do_not_mix(spark, tmp_path):
    one = resolver.Corpus.written(stigs(spark, "Alpha Server"), str(tmp_path / "1"), "b1")
    other = resolver.Corpus.written(stigs(spark, "Omega Server"), str(tmp_path / "2"), "b2")
    assert best(resolver.resolve(one, asked(spark, "alpha"))[0])[0][0] == "RHEL_9_STIG" == best(resolver.resolve(other, asked(spark, "omega"))[0])[0][0]
    assert not best(resolver.resolve(one, asked(spark, "omega"))[0]) and not best(resolver.resolve(other, asked(spark, "alpha"))[0])
    with pytest.raises(LookupError, match="is of b1"):
        resolver.Corpus.opened(spark, str(tmp_path / "1"), "b2")
    with pytest.raises(LookupError, match="no index"):
        resolver.Corpus.opened(spark, str(tmp_path / "3"), "b2")


def test_nothing_is_left(spark):
    from tarnflow.session import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    tables, files = spark.sparkContext._jsc.getPersistentRDDs().size(), set(os.listdir(folder))
    resolver.resolve(stigs(spark, "Alpha"), asked(spark, "alpha"))[0].collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == tables and set(os.listdir(folder)) == files


def test_tokens_reach_the_scan(spark, tmp_path):
    index = resolver.Corpus.written(stigs(spark, "Alpha Server"), str(tmp_path / "1"), "b1")
    plan = resolver.resolve(index, asked(spark, "alpha"))[0]._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "EqualTo(token,alpha)" in plan.replace(" ", "") or "In(token" in plan.replace(" ", "")
