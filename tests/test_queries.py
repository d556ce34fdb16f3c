"""Every registered query against its SQL twin on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import oracle  # noqa: E402

from roadflow import catalog  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
catalog.load()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, con, name):
    problem, _ = oracle.compare(spark, con, FOLDER, name, catalog.QUERIES[name], catalog.SQL[name])
    assert problem is None


@pytest.mark.parametrize("name", ["comparison_table_s28_c6"])
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0
