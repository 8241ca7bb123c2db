"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest

import __spark_entry__
from checks import ORACLES, QUERIES
from checks.compare import compare, duckdb_views

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.fixture(scope="module")
def connection():
    return duckdb_views(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_twin(spark, connection, name):
    assert compare(spark, connection, FOLDER, name).split()[0] == "equal"


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_gives_the_flagship_rows(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.columns[:2] == ["brand", "weekstart"]
    assert frame.count() > 0
