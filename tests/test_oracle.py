"""Every query with SQL gives DuckDB's rows, on the smallest tables."""

import pytest
from oracle import connect, differences

from tarnflow.plans import registry

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_agree(spark, con, name):
    assert differences(spark, con, name, registry.queries()[name], SQL[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_others_run(spark, name):
    rows = registry.queries()[name](spark, SF).collect()
    assert rows
    if name == "archive_scan":
        assert sorted((r.source_member or "", r.source_document or "", r.damaged) for r in rows) == [("broken.zip", "", True), ("one.zip", "a/U_x_Manual-xccdf.xml", False), ("two.zip", "b/y.xml", False)]
    if name == "entity_suggest":
        assert all(r.place == 1 and r.ratio > 0.9 for r in rows if r.place == 1)
