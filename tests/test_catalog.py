"""Every registered query against its SQL twin on the smallest tables."""

import pytest

from tools import check
from wayline.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.connect(FOLDER)


def test_registry():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    same, note = check.compare(spark, con, name, FOLDER)
    assert same, note
    assert "TYPES" not in note, note
