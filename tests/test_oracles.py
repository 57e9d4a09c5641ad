"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from check_oracles import compare, connect

SF_DIR = os.environ.get("AUDITLAKE_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    verdict, count, _, note = compare(spark, con, name, SF_DIR)
    assert verdict in ("ok", "rows-only"), note


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
