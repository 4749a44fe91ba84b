"""Every registered query against its SQL check on the smallest tables."""

from pathlib import Path

import pytest
from compare import compare, connect

from palimpsest import plans

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_equals_sql(spark, con, name):
    assert compare(plans.QUERIES[name](spark, FOLDER), con, plans.ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, FOLDER).count() > 0
