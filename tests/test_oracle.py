"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

from workload import ORACLE, QUERIES
from workload.oracle_check import compare, connect

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLE[name], SF_DIR) is None
