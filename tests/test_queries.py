import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connection
from trifold.plans import queries as core

SF = "/root/testdata/sf0.001"
EXPECTED = {
    "unchanged": 723, "ours_only": 179, "theirs_only": 122, "both_same": 130, "field_merged": 24, "deleted_by_ours": 74, "deleted_by_theirs": 52, "deleted_both": 6,
    "added_ours": 43, "added_theirs": 45, "added_same": 21, "conflict_both_added": 20, "conflict_both_modified": 5, "conflict_modify_delete_ours": 23, "conflict_modify_delete_theirs": 25,
}


@pytest.fixture(scope="module")
def con():
    return connection(SF)


def test_flagship(spark):
    assert {r.resolution: r.n for r in entry.entry(spark).collect()} == EXPECTED


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_against_sql(spark, con, name):
    assert compare(spark, con, core.QUERIES[name], core.ORACLE_SQL[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLE_SQL)))
def test_runs(spark, name):
    assert core.QUERIES[name](spark, SF).count() > 0
