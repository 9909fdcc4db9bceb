"""Every registered query against its SQL twin, on the smallest tables."""

import os
import re

import pytest

from storelens import suite
from tests import compare

SF = "/root/testdata/sf0.001"
suite.load()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


@pytest.mark.parametrize("name", list(suite.QUERIES))
def test_query(spark, duck, name):
    columns, rows = compare.spark_rows(suite.QUERIES[name](spark, SF))
    assert (columns, rows) == compare.duck_rows(duck, suite.SQL[name])


def test_contract():
    import __spark_entry__ as entry

    assert set(suite.QUERIES) == set(suite.SQL) and set(suite.QUERIES) <= set(entry.queries())
    assert set(suite.SQL) <= set(entry.oracle_sql()) <= set(entry.queries())
    # What else is registered comes from the separate subpackage, if that is there.
    assert all(re.match(r"op\d+_|pipeline$", name) for name in set(entry.queries()) - set(suite.QUERIES))
