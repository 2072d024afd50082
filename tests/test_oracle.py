"""Every registered query against its SQL twin."""

import os

import oracle
import pytest

import suite

suite.load_all()
FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", list(suite.QUERIES))
def test_query(spark, con, name):
    assert oracle.differences(spark, con, name, suite.QUERIES[name], suite.ORACLE.get(name), FOLDER) is None


def test_every_query_has_a_twin():
    assert set(suite.QUERIES) == set(suite.ORACLE)
