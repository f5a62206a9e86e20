"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest
from harness import compare

from fieldseq.plans.catalog import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    difference, _, _ = compare(spark, name, QUERIES[name], ORACLES.get(name), SF)
    assert difference is None, difference


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
